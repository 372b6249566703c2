"""Streaming jobs and the daily forecast. Each has a batch twin in ``plans``."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.streaming import StreamingQuery

from werkbank.functions.dates import bucket
from werkbank.plans.inventory import forecast_components, save_forecast
from werkbank.plans.monitoring import OPEN_RUNS, alert_changes, incident_states, reduced_runs, standing_alerts
from werkbank.plans.traffic import half_hours, join_half_hours, merge_half_hours
from werkbank.sources.support import normalise_messages, parse_ticket_pages
from werkbank.streaming.sinks import compact, write_updates
from werkbank.streaming.windows import bounded_counts


def stream_messages(raw: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Upsert raw messages by id. Repeated deliveries are reduced to one row per batch, and
    the newest version counts when read. No state is kept, so neither an edit that follows
    quickly nor a message that comes very late can be dropped."""
    return write_updates(normalise_messages(raw), path, checkpoint, keys=["message_id"], order=["cached_at"])


def stream_counts(source: DataFrame, path: str, checkpoint: str, at: str = "ts",
                  grain: str = "day") -> StreamingQuery:
    """Rows per calendar day, Monday week or month of the session time zone. Counts are
    partial per task before they meet their period. A period is one small row of state, so
    none is ever closed and no row counts as late."""
    counted = source.groupBy(bucket(F.col(at), grain).alias("period")).agg(F.count("*").alias("n"))
    return write_updates(counted, path, checkpoint, "update")


def stream_sessions(source: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Half hours of activity per user, from which ``read_sessions`` joins the sessions. Each batch
    writes its own half hours, summed per task before the shuffle, and they merge when they are read:
    no state is kept, and no row comes too late."""
    return write_updates(source, path, checkpoint, reduced=half_hours)


def read_sessions(spark: SparkSession, path: str) -> DataFrame:
    return join_half_hours(merge_half_hours(spark.read.parquet(path)))


def stream_tickets(pages: DataFrame, path: str, checkpoint: str, revision: str) -> StreamingQuery:
    """Upsert the tickets of landed response pages; the page with the highest ``revision``
    has the ticket's message ids."""
    return write_updates(parse_ticket_pages(pages), path, checkpoint, keys=["ticket_id"], order=[revision])


def stream_incidents(checks: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Runs of a stream of checks ``(service, run_id, healthy, mail_accepted)``, from which
    ``read_incidents`` derives the alerts. Each batch writes one row per run of its own checks, and
    the rows of a run merge when they are read: runs may arrive late, in parts and in any order."""
    return write_updates(checks, path, checkpoint, reduced=reduced_runs)


def stream_alerts(checks: DataFrame, path: str, checkpoint: str, open_runs: int = OPEN_RUNS) -> StreamingQuery:
    """Alerts of a stream of checks in the batch in which they happen, and corrections where a late run changes one.
    Checks that come after ``open_runs`` later runs of their service are rows of kind ``late``."""
    return write_updates(alert_changes(checks, open_runs), path, checkpoint)


def read_alerts(spark: SparkSession, path: str) -> DataFrame:
    """The alerts that stand."""
    return standing_alerts(spark.read.parquet(path))


def stream_bounded_counts(source: DataFrame, path: str, checkpoint: str, at: str = "ts", grain: str = "day",
                          delay: str = "1 day") -> StreamingQuery:
    """Rows per period like ``stream_counts``, with state that ends: a period is closed once its end lies ``delay`` behind
    the latest time seen, and rows that come later are counted as rejects of the period."""
    return write_updates(bounded_counts(source, at, grain, delay), path, checkpoint)


def read_bounded_counts(spark: SparkSession, path: str) -> DataFrame:
    """Per period the rows counted in time (``n``), those rejected as late, and whether the period is closed."""
    rows = spark.read.parquet(path)
    return rows.groupBy("period").agg(
        F.coalesce(F.max(F.when(F.col("kind") != "late", F.col("n"))), F.lit(0)).alias("n"),
        F.coalesce(F.sum(F.when(F.col("kind") == "late", F.col("n"))), F.lit(0)).alias("rejected"),
        F.bool_or(F.col("kind") == "closed").alias("closed"))


def compact_messages(spark: SparkSession, path: str, target: str) -> None:
    """Write the newest version of each message of an update table to a new table, from which reads and later
    batches go on."""
    compact(spark, path, target, ["message_id"], ["cached_at"])


def read_incidents(spark: SparkSession, path: str) -> DataFrame:
    return incident_states(spark.read.parquet(path))


def daily_forecast(spark: SparkSession, erp: dict[str, DataFrame], path: str, as_of: datetime,
                   weeks: int = 1) -> DataFrame:
    """Compute and append the forecast of a day, and give the snapshot table."""
    save_forecast(forecast_components(erp, as_of, weeks), path, as_of, weeks)
    return spark.read.parquet(path)

