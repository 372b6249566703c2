"""Helpers shared by the operators: stored tables, columns of documents, connected components."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from werkbank.operators.stored import scratch, stored  # noqa: F401

LAST_ID = 2 ** 63 - 1


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def id_or_last(name: str = "doc_id") -> Column:
    """The id for joins and order; rows without one come after all others."""
    return F.coalesce(F.col(name).cast("long"), F.lit(LAST_ID))


def connected_components(edges: DataFrame, name: str = "components") -> DataFrame:
    """Columns ``node`` and ``component`` (the smallest node reachable) from edges ``a``, ``b``
    of any one type. Nodes without an edge do not appear; loops and null ends are ignored.

    Large-star and small-star rounds until nothing changes: every round hangs the neighbours of a
    node below its smallest neighbour. Minima are summed before they are shuffled and the joins
    are plain equi-joins with one row per node on one side, so a node with very many neighbours
    can be split. Each round is a stored table."""
    edges = (edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
             .distinct())
    edges, before = stored(edges, name), None
    while True:
        state = edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if state == before or not state[0]:
            return edges.select(F.col("a").alias("node"), F.col("b").alias("component")).unionByName(
                edges.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct())
        before = state
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = (both.where("b > a").join(least, "a").where("b <> m")
                 .select(F.col("b").alias("a"), F.col("m").alias("b")).distinct())
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        hung = large.join(least, "a").where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
        edges = stored(hung.unionByName(least.withColumnRenamed("m", "b")).distinct(), name)
