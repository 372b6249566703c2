import math
import re
from collections import Counter

import duckdb
import numpy as np
import pytest

from werkbank.llm import ranked

TERM = re.compile(rb"[0-9a-z\x80-\xff]+")


def terms(text):
    return TERM.findall(re.sub(rb"[A-Z]", lambda m: m[0].lower(), (text or "").encode()))


def brute(docs, items, k=50):
    counts = [(i, Counter(terms(t))) for i, t in docs]
    having = [c for _, c in counts if c]
    n, total = len(having), sum(c.total() for c in having)
    seen = Counter(t for c in having for t in c)
    wanted, out = {}, []
    for i, t in items:
        wanted.setdefault(i, set()).update(terms(t))
    for item, ts in wanted.items():
        scored = []
        for i, c in counts:
            m = 50 + 50 * c.total() * n // total if total else 0
            score = sum(math.floor(1000 * math.log((2 * n + 2) / (2 * seen[t] + 1))) * (
                10 ** 9 * c[t] // (1000 * c[t] + 20 * m)) for t in ts if c[t])
            if score > 0:
                scored.append((-score, i is None, i))
        out += [(item, r + 1, i, -s) for r, (s, _, i) in enumerate(sorted(scored, key=lambda x: (x[0], x[1], x[2] or 0))[:k])]
    return sorted(out, key=str)


def got(frame):
    return sorted(((r["item_id"], r["rank"], r["doc_id"], r["score"]) for r in frame.collect()), key=str)


@pytest.fixture
def items(spark):
    return lambda rows: spark.createDataFrame(rows, "item_id long, text string")


def test_query_equals_sql(spark, sf):
    with duckdb.connect() as con:
        for name in ("documents", "benchmark"):
            con.sql(f"create view {name} as select * from '{sf}/{name}.parquet'")
        want = sorted(con.sql(ranked.OP11_SQL).fetchall(), key=str)
    assert got(ranked.op11_ranked_search(spark, sf)) == want


@pytest.mark.parametrize("owners, shard, part, block", [(1, 64, 256, 10 ** 6), (3, 8, 2, 10 ** 6), (5, 16, 1, 40)])
def test_shards_owners_and_passes_change_nothing(spark, make, items, monkeypatch, owners, shard, part, block):
    """Rare and common words; many shards, so documents leave the bundles on the way."""
    monkeypatch.setattr(ranked, "SHARD", shard)
    monkeypatch.setattr(ranked, "PART", part)
    monkeypatch.setattr(ranked, "BLOCK", block)
    rng = np.random.default_rng(3)
    word = lambda: f"w{min(int(rng.exponential(8)), 60)}"
    docs = [(i, " ".join(word() for _ in range(rng.integers(0, 40)))) for i in range(200)]
    asked = [(i, " ".join(word() for _ in range(12))) for i in range(7)]
    assert got(ranked.ranked_search(make(docs), items(asked), 5, owners)) == brute(docs, asked, 5)


def test_many_postings_cut_a_shard(spark, make, items, monkeypatch):
    monkeypatch.setattr(ranked, "POSTINGS", 10)
    docs = [(i, " ".join(f"w{j}" for j in range(i % 9))) for i in range(40)]
    asked = [(1, "w0 w3 w7")]
    assert got(ranked.ranked_search(make(docs), items(asked))) == brute(docs, asked)


def test_odd_rows(odd, items):
    from conftest import ODD

    asked = [(1, "A b LONG grÖße"), (1, "words"), (None, "日本語 x😀 end"), (2, None), (3, ""), (4, "nowhere"), (5, "a"), (5, "a")]
    rows = got(ranked.ranked_search(odd, items(asked)))
    assert rows == brute(ODD, asked)
    assert [r[2] for r in rows if r[0] == 5] == [1, 1, 8, None]


def test_words_in_all_documents_give_nothing(make, items):
    docs = [(i, "same") for i in range(600)]
    assert ranked.ranked_search(make(docs), items([(1, "same")])).count() == 0 == len(brute(docs, [(1, "same")]))


def test_ties_and_copies(make, items):
    docs = [(i % 3, "a b") for i in range(9)] + [(None, "a b"), (7, "c")] + [(9, "d")] * 3
    rows = got(ranked.ranked_search(make(docs), items([(1, "b")])))
    assert rows == brute(docs, [(1, "b")]) and len(rows) == 10


def test_long_lengths_stay_exact():
    plan = ranked.Plan({}, 3 * 10 ** 10, 4 * 10 ** 13)
    times, sizes = np.array([1, 10 ** 7]), np.array([10 ** 9, 10 ** 9])
    want = [10 ** 9 * t // (1000 * t + 20 * (50 + 50 * 10 ** 9 * plan.documents // plan.words)) for t in times.tolist()]
    assert ranked.gains(times, sizes, plan).tolist() == want


def test_empty_tables(make, items):
    empty = make([(1, "x")]).where("false")
    for docs, asked in ((empty, [(1, "x")]), (make([(1, "x"), (2, None)]), []), (make([(1, None)]), [(1, "x")])):
        frame = ranked.ranked_search(docs, items(asked))
        assert frame.columns == ["item_id", "rank", "doc_id", "score"] and frame.count() == 0
