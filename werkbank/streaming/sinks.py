"""Exactly-once tables for streaming updates.

A micro-batch is written to its own ``batch_id`` partition, replacing what an earlier attempt
of the same batch left, so a restart repeats nothing. Readers take the newest row per key, so
an update never rewrites rows that are already stored, and no late row is lost.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from werkbank.operators.keyed import latest_by


def write_updates(stream: DataFrame, path: str, checkpoint: str, mode: str = "append",
                  trigger: dict | None = None, keys: list[str] | None = None,
                  order: list[str] | None = None,
                  reduced: Callable[[DataFrame], DataFrame] | None = None) -> StreamingQuery:
    """Start writing a stream; with ``keys`` each batch is reduced to its newest row per key, with
    ``reduced`` to what that function makes of it."""
    def write(batch: DataFrame, batch_id: int) -> None:
        rows = latest_by(batch, keys, order) if keys else reduced(batch) if reduced else batch
        rows.write.mode("overwrite").parquet(f"{path}/batch_id={batch_id}")

    return (stream.writeStream.outputMode(mode).option("checkpointLocation", checkpoint)
            .trigger(**(trigger or {"availableNow": True})).foreachBatch(write).start())


def read_latest(spark: SparkSession, path: str, keys: list[str], order: list[str] | None = None) -> DataFrame:
    """Newest row per key, by ``order`` and then by batch."""
    stored = spark.read.parquet(path)
    return latest_by(stored, keys, [*(order or []), "batch_id"]).drop("batch_id")


def compact(spark: SparkSession, path: str, target: str, keys: list[str], order: list[str] | None = None) -> None:
    """Write the current rows of an update table to a new table, as its first batch."""
    read_latest(spark, path, keys, order).write.mode("overwrite").parquet(f"{target}/batch_id=-1")
