"""Intermediate tables in the folder that all executors share.

A stored table cuts the lineage: what reads it never runs the steps before it again, however often it is read and
whichever executor is lost."""

from __future__ import annotations

import atexit
import uuid

from pyspark.sql import DataFrame, SparkSession

_WRITTEN: list[tuple[SparkSession, str]] = []


def shared_folder(spark: SparkSession) -> str:
    """The folder that all executors share, as the cluster names it, else the warehouse."""
    return (spark.conf.get("spark.checkpoint.dir", None) or spark.conf.get("spark.sql.warehouse.dir")).rstrip("/")


def scratch(spark: SparkSession, name: str = "run") -> str:
    """A new path below the shared folder. What is written there goes with ``drop_stored``."""
    path = f"{shared_folder(spark)}/werkbank/{name}-{uuid.uuid4().hex}"
    _WRITTEN.append((spark, path))
    return path


def stored(frame: DataFrame, name: str) -> DataFrame:
    """``frame``, written and read again."""
    path = scratch(frame.sparkSession, name)
    frame.write.option("compression", "zstd").parquet(path)
    return frame.sparkSession.read.schema(frame.schema).parquet(path)


@atexit.register
def drop_stored() -> None:
    """Remove what this process has stored; results that still read it can't be used afterwards. It runs by itself when
    the process ends."""
    while _WRITTEN:
        spark, path = _WRITTEN.pop()
        context = spark.sparkContext
        if context._jsc is not None:
            place = context._jvm.org.apache.hadoop.fs.Path(path)
            place.getFileSystem(context._jsc.hadoopConfiguration()).delete(place, True)
