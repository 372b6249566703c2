"""Keyed operators. Each reduces on the map side before its shuffle, so that a key with very
many rows costs one partial row per task."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from werkbank.sources.schemas import conform


def _named(columns) -> Column:
    return F.struct(*[F.col(f"`{c}`") for c in columns])


def latest_by(df: DataFrame, keys: list[str], order: list[str], first: bool = False) -> DataFrame:
    """One row per key: the greatest (or with ``first`` the least) by ``order``. The order
    columns should identify a row within its key."""
    rest = [c for c in df.columns if c not in keys]
    pick = F.min_by if first else F.max_by
    picked = df.groupBy(*keys).agg(pick(_named(rest), _named(order)).alias("_row"))
    return picked.select(*[f"`{c}`" if c in keys else F.col(f"_row.`{c}`") for c in df.columns])


def upsert_latest(base: DataFrame, updates: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """Upsert where the last write wins; on equal ``order`` an update beats the base row."""
    both = conform(base, updates.schema).withColumn("_new", F.lit(0)).unionByName(
        updates.withColumn("_new", F.lit(1)))
    return latest_by(both, keys, [*order, "_new"]).drop("_new")


def missing_ids(wanted: DataFrame, have: DataFrame, key: str) -> DataFrame:
    """Rows of ``wanted`` whose key is not in ``have``. The known keys are reduced to one row
    each first."""
    return wanted.join(have.select(key).distinct(), key, "left_anti")


def dedupe_keep_first(df: DataFrame, key: str, position: str) -> DataFrame:
    """Distinct values with the position of their first occurrence."""
    return df.groupBy(key).agg(F.min(position).alias(position))
