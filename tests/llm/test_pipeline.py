import math

import corpus_pipeline as pipeline
from test_sentencepiece import text_of
from test_suffix_array import brute
from test_simhash import brute_components, brute_print

import numpy as np
from werkbank.llm import mixing, quality
from werkbank.llm.common import stored


def test_stages_against_brute_force(spark, sf):
    """Each stage on what the one before it kept."""
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    columns = docs.columns
    assert [n for n, _ in pipeline.STAGES] == ["quality_classifier", "simhash_near_dedup", "suffix_array_dedup",
                                               "source_mixing", "sentencepiece_encoding"]
    results = [{r["doc_id"]: r for r in docs.collect()}]
    for name, stage in pipeline.STAGES[:3]:
        docs = stored(stage(spark, docs, sf), name)
        assert docs.columns == columns
        rows = docs.collect()
        results.append({r["doc_id"]: r for r in rows})
        assert len(rows) == len(results[-1])
    raw, good, single, cut = results

    scores = {r["doc_id"]: r["predicted"] for r in quality.op10_quality(spark, sf).collect()}
    assert set(good) == {i for i, p in scores.items() if p} and all(good[i] == raw[i] for i in good)

    prints = {i: brute_print(r["text"]) for i, r in good.items()}
    label = brute_components(sorted(prints), lambda a, b: (prints[a] ^ prints[b]).bit_count() <= 3)
    assert set(single) == set(label.values()) and all(single[i] == good[i] for i in single)

    ids = sorted(single)
    for i, (kept, _) in zip(ids, brute([single[i]["text"].encode() for i in ids])):
        assert cut[i]["text"] == kept.decode("utf-8", "ignore") and cut[i]["n_chars"] == len(cut[i]["text"])
        assert (cut[i]["lang"], cut[i]["source"]) == (single[i]["lang"], single[i]["source"])

    taken = {r["doc_id"]: r["_mix"] for r in mixing.mix_sources(docs).collect()}
    mixed = stored(pipeline.source_mix(spark, docs, sf), "mixed")
    assert mixed.columns == columns
    times = {r["doc_id"]: r["count"] for r in mixed.groupBy("doc_id").count().collect()}
    assert times == {i: math.ceil(m["taken"] / m["size"]) for i, m in taken.items() if m["taken"]}

    rows = pipeline.piece_ids(spark, mixed, sf).collect()
    assert len(rows) == sum(times.values())
    for r in rows:
        assert r["lossless"] and r["n_ids"] * 4 == len(r["ids"])
        assert text_of(np.frombuffer(r["ids"], "<u4").tolist()) == cut[r["doc_id"]]["text"]


def test_run(spark, sf):
    rows = pipeline.run(spark, sf)
    assert rows.columns == ["doc_id", "lang", "source", "n_chars", "ids", "n_ids", "lossless"]
    assert rows.where("not lossless").count() == 0 < rows.count()


def test_odd_documents(spark, sf, odd):
    docs = odd.select("doc_id", "text", "lang", "source", "n_chars")
    for name, stage in pipeline.STAGES:
        docs = stored(stage(spark, docs, sf), name)
    assert docs.count() > 0


def test_no_documents(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet").where("false")
    for name, stage in pipeline.STAGES:
        docs = stored(stage(spark, docs, sf), name)
    assert docs.count() == 0
