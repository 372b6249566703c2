import hashlib
import re

import pytest
from pyspark.sql import functions as F

from werkbank.llm import winnowing


def plain_edit(texts):
    return [t[:len(t) - len(t) // 2] + n[:len(t) // 2] for t, n in zip(texts, texts[1:] + texts[:1])]


def words(text):
    return re.findall(r"[^\x20\x09-\x0D]{1,16}", text)


def plain_hashes(spark, texts):
    """Hashes of all runs of five words of every text, each summed up on its own."""
    every = sorted({w for t in texts for w in words(t)})
    named = {r["w"]: r["h"] % 2 ** 64 for r in spark.createDataFrame([(w,) for w in every], "w string").select(
        "w", F.xxhash64("w").alias("h")).collect()}

    def run(part):
        total = 0
        for w in part:
            total = ((total << 1 | total >> 63) ^ named[w]) % 2 ** 64
        return (total - 2 ** 64 if total >> 63 else total) >> 31

    return [[run(ws[i:i + 5]) for i in range(max(1, len(ws) - 4))] if ws else [] for ws in map(words, texts)]


def plain_prints(hashes):
    """The rightmost smallest hash of each window of eight, with its position."""
    found = set()
    for s in range(max(1, len(hashes) - 7) if hashes else 0):
        window = hashes[s:s + 8]
        at = max(k for k in range(len(window)) if window[k] == min(window))
        found.add((window[at], s + at))
    return found


def test_query(spark, sf, documents):
    rows = {r["doc_id"]: r for r in winnowing.op8_fingerprints(spark, sf).collect()}
    texts = [t or "" for _, t, _ in documents]
    same = {}
    for (i, _, _), text, edited in zip(documents, texts, plain_edit(texts)):
        r = rows[i]
        assert (r["n_chars"], r["edited_sha256"]) == (len(text), hashlib.sha256(edited.encode()).hexdigest())
        assert 0 <= r["near_edited"] <= 1 and 0 <= r["near_next"] <= 1
        assert same.setdefault(text, r["fingerprint"]) == r["fingerprint"]
    assert len(set(same.values())) > 0.95 * len(same)


def test_winnowing_against_a_plain_loop(spark, documents):
    texts = ["a b c d e f g h i j k l m n o p", "x " * 40, "one two", "", "a b c d e", "a b c d e f",
             *(" ".join(f"w{i % 97}" for i in range(n)) for n in (63, 64, 65, 67, 68, 69, 131, 132, 133, 5000)),
             *(t or "" for _, t, _ in documents[:20])]
    frame = spark.createDataFrame(list(enumerate(texts)), "i int, text string")
    rows = winnowing.with_prints(frame, "text", "p").select("i", winnowing.positions("p").alias("found")).collect()
    wanted = [plain_prints(h) for h in plain_hashes(spark, texts)]
    assert len(rows) == len(texts)
    for r in rows:
        assert {(x["hash"], x["word"]) for x in r["found"]} == wanted[r["i"]]


def test_likeness_against_plain_sets(spark, sf, documents):
    rows = {r["doc_id"]: r for r in winnowing.op8_fingerprints(spark, sf).collect()}
    texts = [t or "" for _, t, _ in documents]
    found = [plain_prints(h) for h in plain_hashes(spark, texts + plain_edit(texts))]
    prints = [{h for h, _ in f} for f in found]
    alike = lambda a, b: len(a & b) / len(a | b) if a | b else 1.0
    for k, (i, _, _) in enumerate(documents):
        r = rows[i]
        assert sorted(zip(r["hashes"], r["words"])) == sorted(found[k])
        assert r["near_edited"] == pytest.approx(alike(prints[k], prints[len(texts) + k]))
        assert r["near_next"] == pytest.approx(alike(prints[k], prints[(k + 1) % len(texts)]))


def test_a_frequent_id_is_cut_in_parts(make):
    rows = [(5, f"text {i}") for i in range(3000)] + [(i, f"other {i}") for i in range(1000)]
    ranges = winnowing.in_order(make(rows)).select("_bucket", "_order").collect()
    ranges.sort(key=lambda r: (r["_order"]["id"], r["_order"]["hash"]))
    assert [r["_bucket"] for r in ranges] == sorted(r["_bucket"] for r in ranges)
    sizes = {}
    for r in ranges:
        sizes[r["_bucket"]] = sizes.get(r["_bucket"], 0) + 1
    assert max(sizes.values()) < 200
    texts = [r["text"] for r in winnowing.edited_fingerprints(make(rows)).collect()]
    assert sorted(texts) == sorted(t for _, t in rows)


def test_shared_passage_is_found(spark):
    passage = " ".join(f"p{i}" for i in range(12))
    texts = [" ".join(f"a{i}" for i in range(50)) + " " + passage + " end", "x y " + passage + " " + " ".join(f"b{i}" for i in range(33))]
    frame = spark.createDataFrame([(t,) for t in texts], "text string")
    a, b = ({x["hash"] for x in r["p"]} for r in winnowing.with_prints(frame, "text", "q").select(winnowing.positions("q").alias("p")).collect())
    assert a & b


@pytest.mark.parametrize("n", [1, 2, 3, 40])
def test_next_document_in_a_ring(make, n):
    ids = [7 * i - 20 for i in range(n)]
    texts = [f"doc {i} " + "wörd " * (i % 5) + "😀" * (i % 3) for i in range(n)]
    rows = {r["doc_id"]: r["edited"] for r in winnowing.edited_fingerprints(make(list(zip(ids, texts))[::-1])).collect()}
    assert [rows[i] for i in ids] == plain_edit(texts)


def test_odd_rows(odd):
    rows = winnowing.edited_fingerprints(odd).collect()
    assert len(rows) == 12
    assert all(r["text"] is not None for r in rows)
    assert sum(r["text"] == "a b c d" for r in rows) == 4
    assert len({tuple(r["prints"]) for r in rows if r["text"] == "a b c d"}) == 1
    assert [len(r["prints"]) for r in rows if r["doc_id"] in (2, 3, 4)] == [0, 0, 0]
    # In order of id the last with one stands before those without; null ids come last and lead to the first.
    assert next(r["edited"] for r in rows if r["doc_id"] == 7)[:5] == "Größe"


def test_empty_table(make):
    assert winnowing.edited_fingerprints(make([(1, "x")]).where("false")).count() == 0


def test_no_python_on_rows(spark, sf):
    plan = winnowing.op8_fingerprints(spark, sf)._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Pandas|Arrow", plan)
