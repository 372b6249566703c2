import pytest
from pyspark.sql import functions as F

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="session")
def sf():
    return "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def documents(spark, sf):
    rows = spark.read.parquet(f"{sf}/documents.parquet").orderBy("doc_id").collect()
    return [(r["doc_id"], r["text"], r["source"]) for r in rows]


@pytest.fixture(scope="session")
def make(spark):
    """Documents from (doc_id, text) or (doc_id, text, source), with extra columns whose names the
    operators might use themselves."""

    def build(rows):
        rows = [(*r, "s")[:3] for r in rows]
        frame = spark.createDataFrame([(i, t, "en", s, len(t or "")) for i, t, s in rows], DOCS)
        return frame.withColumns({n: F.lit("own") for n in (
            "doc", "tie", "key", "size", "fingerprint", "component_id", "label", "node", "bytes", "code", "score",
            "host", "bucket", "value", "taken", "hash", "row", "lane", "mark", "runs", "label_", "copies", "_taken", "_key", "_sizes", "_goals",
            "_cut", "_copies", "_rest", "_prefix", "_doc", "_tie", "_runs", "_row", "_id", "_none", "_mark", "_copy", "_bytes",
            "_parts", "a column.name")})

    return build


#: Null ids and texts, empty and blank texts, ties, repeated rows, one id with two texts.
ODD = [(1, "a b c d"), (1, "a b c d"), (1, "other words here"), (None, "a b c d"), (None, None), (2, None), (3, ""), (4, " \n\t "),
       (5, "x" * 50_000), (6, "long " * 20_000), (7, "Größe 日本語 😀 end"), (8, "a b c d")]


@pytest.fixture
def odd(make):
    return make([(i, t, None if i in (2, None) else f"s{(i or 0) % 2}") for i, t in ODD])
