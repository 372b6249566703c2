"""A corpus from raw documents to ids: each stage calls one operator of ``werkbank.llm`` on what the stage before it
kept, and is written and read again."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from werkbank.llm import mixing, quality, repeats, sentencepieces, simhash
from werkbank.llm.common import stored, table

#: SQL cannot express these stages; they are tested against brute force.
ORACLE_SQL = None


def good_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier takes for good ones; nulls, ties and repeats as in ``quality.good_documents``, an empty
    table stays empty."""
    return quality.good_documents(docs, table(spark, sf_dir, "labels"))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group whose fingerprints (3-word shingles) lie within 3 bits; nulls, ties and repeats as in
    ``simhash.simhash_dedup``, an empty table stays empty."""
    return simhash.simhash_dedup(docs, shingle=3, distance=3)


def repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the strings of 100 bytes that an earlier place has; what a cut leaves of a character goes
    too, and ``n_chars`` counts again. Documents stay, even with an empty text."""
    kept = repeats.without_repeats(docs, as_text=True)
    kept = kept.withColumn("text", F.when(F.col("text").isNotNull(), F.col("_kept.text")))
    return kept.withColumn("n_chars", F.length("text").cast("long")).select(docs.columns)


def source_mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The sources at their target weights: documents as often as the mix takes them; nulls, ties and repeats as in
    ``mixing.repeated``, an empty table stays empty."""
    return mixing.repeated(docs)


def piece_ids(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Ids of each text (little-endian 32-bit numbers), their number, and whether they decode to the text. The copies of a
    document that the mix has made are segmented each in its own way; nulls as in ``sentencepieces.encoded``, an empty
    table stays empty."""
    ids = sentencepieces.encoded(docs, sentencepieces.model_path(), copies=True)
    return ids.select("doc_id", "lang", "source", "n_chars", F.col("_ids").alias("ids"), (
        F.octet_length("_ids") / 4).cast("long").alias("n_ids"), F.col("_lossless").alias("lossless"))


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality_classifier", good_quality),
    ("simhash_near_dedup", near_duplicates),
    ("suffix_array_dedup", repeated_passages),
    ("source_mixing", source_mix),
    ("sentencepiece_encoding", piece_ids),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages on ``documents``; each result but the last is a stored table."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
