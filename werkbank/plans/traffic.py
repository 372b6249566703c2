"""Website traffic metrics over an event table ``(event_id, ts, user_id, event_type, value)``."""

from __future__ import annotations

from datetime import date

from pyspark.sql import DataFrame, Window, functions as F

from werkbank.functions.dates import as_date, date_range
from werkbank.operators.shaping import page

METRICS = ("activeUsers", "sessions", "screenPageViews", "engagementRate", "ecommercePurchases",
           "purchaseRevenue")
GAP_SECONDS = 30 * 60
ENGAGED_SECONDS = 10


def half_hours(events: DataFrame) -> DataFrame:
    """Events of each user per aligned half hour. A user has at most 48 such rows per day however
    many events there are, and they are summed on the map side."""
    once = lambda kind: F.sum((F.col("event_type") == kind).cast("bigint"))
    first = F.struct("ts", "event_id")
    slot = F.window("ts", f"{GAP_SECONDS} seconds")
    return events.groupBy("user_id", slot.alias("_w")).agg(
        F.min("ts").alias("first_at"), F.max("ts").alias("last_at"), F.count("*").alias("events"),
        once("view").alias("views"), once("purchase").alias("purchases"), F.min_by("event_id", first).alias("first_id"),
        F.min_by("event_type", first).alias("event_type")).withColumn("slot", F.unix_seconds("_w.start")).drop("_w")


def merge_half_hours(slots: DataFrame) -> DataFrame:
    """One row per user and half hour from rows of parts of the events, in whatever order they came."""
    first = F.struct("first_at", "first_id")
    return slots.groupBy("user_id", "slot").agg(
        F.min("first_at").alias("first_at"), F.max("last_at").alias("last_at"), F.sum("events").alias("events"),
        F.sum("views").alias("views"), F.sum("purchases").alias("purchases"), F.min_by("first_id", first).alias("first_id"),
        F.min_by("event_type", first).alias("event_type"))


def join_half_hours(slots: DataFrame) -> DataFrame:
    """Sessions from half hours. Events within one half hour always belong together, so only
    the gaps between half hours matter."""
    order = Window.partitionBy("user_id").orderBy("slot")
    gap = F.unix_micros("first_at") - F.unix_micros(F.lag("last_at").over(order))
    opens = F.coalesce((gap > GAP_SECONDS * 1_000_000).cast("int"), F.lit(1))
    numbered = slots.withColumn("_opens", opens).withColumn("session", F.sum("_opens").over(order))
    return numbered.groupBy("user_id", "session").agg(
        F.min("first_at").alias("started"), F.max("last_at").alias("ended"), F.sum("events").alias("events"),
        F.sum("views").alias("views"), F.sum("purchases").alias("purchases"),
        F.min_by("event_type", "slot").alias("event_type"))


def sessions(events: DataFrame) -> DataFrame:
    """Sessions per user: events at most 30 minutes apart."""
    return join_half_hours(half_hours(events))


def engaged():
    """Longer than 10 seconds, or with a purchase, or with two page views."""
    length = F.unix_micros("ended") - F.unix_micros("started")
    return (length > ENGAGED_SECONDS * 1_000_000) | (F.col("purchases") > 0) | (F.col("views") >= 2)


def traffic_report(events: DataFrame, metrics: list[str], breakdown: str = "overview",
                   start_date="28daysAgo", end_date="yesterday", as_of: date | None = None) -> DataFrame:
    """Metrics of the period in total, per date, or per value of an event column.

    Users are counted in the period or group itself; daily users are never added up. A
    session counts on the day, and under the column value, of its first event.
    """
    if not metrics or len(set(metrics)) != len(metrics) or set(metrics) - set(METRICS):
        raise ValueError(f"ask each of {METRICS} at most once, and one at least")
    lo, hi = as_date(start_date, as_of=as_of), as_date(end_date, as_of=as_of)
    if lo > hi:
        raise ValueError(f"the period ends ({hi}) before it begins ({lo})")
    chosen = events.filter(date_range(F.col("ts"), lo, hi))
    by = [] if breakdown == "overview" else [breakdown]
    day = lambda c: F.to_date(c).alias("date")
    kind = F.col("event_type")
    per_event = {
        "activeUsers": F.countDistinct("user_id"),
        "screenPageViews": F.sum((kind == "view").cast("bigint")),
        "ecommercePurchases": F.sum((kind == "purchase").cast("bigint")),
        "purchaseRevenue": F.sum(F.when(kind == "purchase", F.col("value").cast("decimal(18,2)")).otherwise(0)),
    }
    per_session = {
        "sessions": F.count("*"),
        "engagementRate": F.sum(engaged().cast("bigint")).cast("double") / F.count("*"),
    }
    parts = []
    for source, known in ((chosen, per_event), (sessions(chosen), per_session)):
        wanted = [m for m in metrics if m in known]
        if not wanted:
            continue
        if breakdown == "date":
            source = source.withColumn("date", day(F.col("ts" if known is per_event else "started")))
        aggregates = [known[m].alias(m) for m in wanted]
        parts.append(source.groupBy(*by).agg(*aggregates) if by else source.agg(*aggregates))
    if len(parts) == 1:
        result = parts[0]
    elif by:
        result = parts[0].join(parts[1], by, "full")
    else:
        result = parts[0].select("*", *[parts[1].select(m).scalar().alias(m) for m in parts[1].columns])
    return result.select(*by, *metrics)


def website_traffic(events: DataFrame, metric: str = "sessions", breakdown: str = "overview",
                    start_date="28daysAgo", end_date="yesterday", as_of: date | None = None,
                    limit: int = 100, offset: int = 0) -> DataFrame:
    """One page of a one-metric report with the total row count and the next offset; dates in
    order, other breakdowns by falling metric."""
    report = traffic_report(events, [metric], breakdown, start_date, end_date, as_of)
    order = ["date"] if breakdown == "date" else [F.desc(metric)] + ([] if breakdown == "overview" else [breakdown])
    return page(report, order, offset, limit)
