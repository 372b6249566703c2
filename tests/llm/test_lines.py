import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from werkbank.llm import lines

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def brute(text):
    text = text or ""
    words = WORD.findall(text)
    seen, copies = set(), 0
    for line in text.split("\n"):
        if WORD.search(line):
            copies += line in seen
            seen.add(line)
    windows = Counter(tuple(words[i:i + 3]) for i in range(len(words) - 2))
    again = {i + j for i in range(len(words) - 2) if windows[tuple(words[i:i + 3])] > 1 for j in range(3)}
    failed = len(words) < 50 or 100 * len(again) > 50 * len(words)
    return (len(words), sum(map(len, words)), sum(text.count(c) for c in "#*$%&|<>"), copies, len(again), failed)


BASE = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed")


def test_query_equals_brute_force(spark, sf, documents):
    rows = {r["doc_id"]: r for r in lines.op12_quality_rules(spark, sf).collect()}
    assert {i: tuple(rows[i][c] for c in BASE) for i, _, _ in documents} == {i: brute(t) for i, t, _ in documents}
    for i, text, _ in documents:
        r = rows[i]
        assert len(r["marks"]) == len((text or "").split("\n"))
        share = sum(len(WORD.findall(x)) for x, m in zip(text.split("\n"), r["marks"]) if m == "c") / max(1, r["n_words"])
        assert r["content_share"] == pytest.approx(share) and r["kept"] == (not r["base_failed"] and share >= 0.5)


def test_held_out_labels(spark):
    """Fitted on two thirds of the labels, the field tells the others apart and keeps good documents."""
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    labels = spark.read.parquet("/root/testdata/sf0.01/labels.parquet")
    out = F.col("doc_id") % 3 == 1
    found = lines.line_quality(docs, labels.where(~out)).join(labels.where(out), "doc_id")
    rows = found.select("_lines.*", "quality").where("not base_failed").collect()
    good, bad = ([r["kept"] for r in rows if r["quality"] == q] for q in (1, 0))
    assert len(good) > 50 and len(bad) > 5
    assert np.mean(good) >= 0.99 and np.mean(bad) <= 0.1


def test_gradient_equals_differences():
    rng = np.random.default_rng(1)
    rows, there = rng.normal(size=(5, 6, 3)), np.arange(6) < rng.integers(1, 7, 5)[:, None]
    marks, flat = rng.integers(0, 2, (5, 6)), rng.normal(size=9)
    value, grad = lines.risk(flat, rows, marks, there)
    for i in range(9):
        step = np.eye(9)[i] * 1e-5
        assert (lines.risk(flat + step, rows, marks, there)[0] - lines.risk(flat - step, rows, marks, there)[0]) / 2e-5 == pytest.approx(grad[i], abs=1e-6)


def test_risk_sums_all_sequences():
    rng = np.random.default_rng(2)
    rows, marks, flat = rng.normal(size=(1, 5, 3)), rng.integers(0, 2, (1, 5)), rng.normal(size=9)
    weights, steps, first = flat[:3], flat[3:7].reshape(2, 2), flat[7:]
    own = rows[0] @ weights
    score = lambda m: first[m[0]] + sum(own[i] * m[i] for i in range(5)) + sum(steps[a, b] for a, b in zip(m, m[1:]))
    every = [[n >> i & 1 for i in range(5)] for n in range(32)]
    whole = np.log(sum(np.exp(score(m)) for m in every))
    assert lines.risk(flat, rows, marks, np.ones((1, 5), bool))[0] == pytest.approx(whole - score(marks[0]))


@pytest.mark.parametrize("seed", range(8))
def test_viterbi_equals_all_sequences(seed):
    rng = np.random.default_rng(seed)
    n = int(rng.integers(1, 9))
    field = lines.Field(rng.normal(size=lines.WIDTH), rng.normal(size=(2, 2)) * 2, rng.normal(size=2))
    rows = rng.normal(size=(n, lines.WIDTH))
    own = rows @ field.weights
    score = lambda m: field.first[m[0]] + sum(own[i] * m[i] for i in range(n)) + sum(field.steps[a, b] for a, b in zip(m, m[1:]))
    every = [[x >> i & 1 for i in range(n)] for x in range(2 ** n)]
    assert lines.best_marks(field, rows.tolist()) == max(every, key=score)


@pytest.fixture
def labels(spark):
    return lambda rows: spark.createDataFrame(rows, "doc_id long, quality int, toxic int")


def test_odd_rows(odd, labels):
    from conftest import ODD

    names = ["own rows", "row", "text_", "_lines", "base_failed"]
    frame = odd.withColumns({n: F.lit("own") for n in names})
    given = labels([(1, 1, 0), (1, 0, 0), (6, 1, 0), (None, 0, 0), (2, None, 0), (77, 1, 0), (3, 0, 0)])
    found = lines.line_quality(frame, given)
    assert found.columns == [*frame.drop("_lines").columns, "_lines"]
    rows = found.collect()
    want = sorted(((i, t, *brute(t)) for i, t in ODD), key=str)
    assert sorted(((r["doc_id"], r["text"], *(r["_lines"][c] for c in BASE)) for r in rows), key=str) == want
    assert all(r[n] == "own" for r in rows for n in names if n != "_lines")
    assert all(r["_lines"]["marks"] == "" and not r["_lines"]["kept"] for r in rows if not r["text"])
    kept = lines.content_documents(frame, given)
    assert kept.columns == frame.drop("_lines").columns


def test_without_labels_every_line_is_content(make, labels):
    text = "\n".join(" ".join(f"w{i}x{j}" for j in range(20)) for i in range(5)) + "\n\n"
    found = lines.line_quality(make([(1, text), (2, "few words")]), labels([])).orderBy("doc_id").collect()
    assert [r["_lines"]["kept"] for r in found] == [True, False]
    assert found[0]["_lines"]["marks"] == "ccccc--"


def test_result_hangs_on_rows_alone(spark, sf):
    docs, given = (spark.read.parquet(f"{sf}/{n}.parquet") for n in ("documents", "labels"))
    twice = docs.unionByName(docs.where("doc_id % 2 = 0")).repartition(7)
    one = {(r["doc_id"], r["_lines"]["marks"]) for r in lines.line_quality(docs, given).select("doc_id", "_lines").collect()}
    two = {(r["doc_id"], r["_lines"]["marks"]) for r in lines.line_quality(twice, given).select("doc_id", "_lines").collect()}
    assert one == two


def test_empty_tables(make, labels):
    empty = make([(1, "x")]).where("false")
    assert lines.line_quality(empty, labels([(1, 1, 0)])).count() == 0 == lines.content_documents(empty, labels([])).count()
