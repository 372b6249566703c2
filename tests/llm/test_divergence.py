from collections import Counter, defaultdict

import duckdb
import numpy as np
import pytest

from werkbank.llm import divergence


def brute(rows, least=30, top=50):
    """rows: (text, lang, source)."""
    count, seen = defaultdict(Counter), defaultdict(Counter)
    for text, lang, source in rows:
        words = (text or "").encode().translate(divergence.KEPT).decode().split()
        count[lang or "", source or ""].update(words)
        seen[lang or ""].update(set(words))
    out = []
    for lang in seen:
        kept = [t for t, n in seen[lang].items() if n >= least]
        groups = {s: [c[t] for t in kept] for (x, s), c in count.items() if x == lang}
        share = lambda c: [1 + 10 ** 9 * (x + 5) // (sum(c) + 5 * len(kept)) for x in c]
        own, whole = {s: share(c) for s, c in groups.items()}, share([sum(x) for x in zip(*groups.values())])
        for s, c in groups.items():
            pairs = [(-sum(abs(a - b) for a, b in zip(own[s], own[o])), o.encode(), o) for o in groups if o != s]
            terms = [(q - p, t.encode(), t) for t, n, p, q in zip(kept, c, own[s], whole) if n and p > q]
            for part, found in (("pair", sorted(pairs)), ("term", sorted(terms)[:top])):
                out += [(lang, s, part, x, -v, r + 1) for r, (v, _, x) in enumerate(found)]
    return sorted(out)


def got(frame):
    return sorted(tuple(r) for r in frame.select("lang", "source", "part", "item", "value", "rank").collect())


@pytest.fixture
def rows(spark):
    return lambda found: spark.createDataFrame([(i, *r, "own", "own") for i, r in enumerate(found)],
                                               "doc_id long, text string, lang string, source string, term string, number string")


def test_query_equals_sql(spark, sf):
    with duckdb.connect() as con:
        con.sql(f"create view documents as select * from '{sf}/documents.parquet'")
        want = sorted(con.sql(divergence.OP13_SQL).fetchall())
    assert got(divergence.op13_source_divergence(spark, sf)) == want


@pytest.mark.parametrize("tile, counts, held", [(64, 1 << 18, 1 << 19), (2, 20, 5)])
def test_blocks_and_tiles_change_nothing(spark, rows, monkeypatch, tile, counts, held):
    for name, value in (("TILE", tile), ("COUNTS", counts), ("HELD", held)):
        monkeypatch.setattr(divergence, name, value)
    rng = np.random.default_rng(4)
    found = [(" ".join(f"w{'abcdefghijklmnopqrstuvwxyz'[min(25, int(rng.exponential(6)))]}" for _ in range(rng.integers(0, 30))),
              str(rng.choice(["en", "de"])), f"s{min(int(rng.exponential(3)), 7)}") for _ in range(300)]
    assert got(divergence.source_divergence(rows(found), 5, 4)) == brute(found, 5, 4)


def test_odd_rows(rows):
    """Missing languages, sources and texts, groups without words, ties, repeated rows, long texts, other letters."""
    found = [("a b", None, None), ("a c", None, "s"), (None, "en", "s"), ("", "en", None), ("A1b 日本語 é", "en", "s"), ("a\x00b", "en", "t"),
             ("x " * 50_000, "en", "t"), ("x" * 100_000, "en", "é"), ("x", "en", "é"), ("x", "en", "é"), (" \n", "xx", "p"), (None, "xx", "q"),
             ("lone", "yy", "one"), ("x", "en", "~")]
    for least in (1, 2, 30):
        assert got(divergence.source_divergence(rows(found), least)) == brute(found, least)


def test_empty_table(rows):
    frame = divergence.source_divergence(rows([("x", "en", "s")]).where("false"))
    assert frame.count() == 0 and frame.columns == ["lang", "source", "part", "item", "value", "rank"]


@pytest.mark.parametrize("seed", range(6))
def test_runs_say_the_same_as_counts(seed):
    rng = np.random.default_rng(seed)
    table = rng.poisson(0.7, (40, 5))
    table[0] = 0
    term, source = np.nonzero(table)
    size, found = divergence.columns(term, source, table[term, source])
    whole = {s: np.repeat(v, np.diff(np.append(a, size))) for s, a, v in found}
    for _, a, v in found:
        assert a[0] == 0 and (np.diff(a) > 0).all() and (np.diff(v) != 0).all()
    rows = sorted(tuple(int(whole[s][i]) if s in whole else 0 for s in range(5)) for i in range(size))
    assert rows == sorted(tuple(map(int, r)) for r in table if r.any())
    for s, a, v in found:
        for t, b, w in found:
            assert divergence.apart(size, (a, v), (b, w)) == np.abs(whole[s] - whole[t]).sum()


def test_shares_are_exact(spark):
    big = [(0, 0, 3), (7, 100, 5), (10 ** 14, 10 ** 14, 10 ** 6), (123_456_789_012_345, 200_000_000_000_001, 77), (0, 10 ** 14, 10 ** 8)]
    frame = spark.createDataFrame(big, "n long, total long, size long")
    want = [1 + 10 ** 9 * (n + 5) // (t + 5 * s) for n, t, s in big]
    assert [r[0] for r in frame.select(divergence.share("n", "total", "size")).collect()] == want
    assert [int(divergence.shares(np.array([n]), t, s)[0]) for n, t, s in big] == want
