"""Sorting, paging, chart points and records."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F, types as T


def sort_head(df: DataFrame, sort_by: str | None, ties: list[str], descending: bool = False,
              limit: int | None = None) -> DataFrame:
    """Sort by one column with NULL last in both directions, ties by ``ties``."""
    if sort_by is not None and sort_by not in df.columns:
        raise ValueError(f"cannot sort by {sort_by}")
    order = []
    if sort_by is not None:
        c = F.col(sort_by)
        order.append(c.desc_nulls_last() if descending else c.asc_nulls_last())
    order += [F.col(t).asc_nulls_last() for t in ties if t != sort_by]
    out = df.orderBy(*order) if order else df
    return out if limit is None else out.limit(limit)


#: Parts of a result that are ordered and counted on their own.
SLOTS = 64


def first_rows(df: DataFrame, order: list, n: int) -> DataFrame:
    """The first ``n`` rows of a totally ordered result with ``_place`` (from 1) and ``_total``, the number of all rows,
    from one run of ``df``.

    Rows are dealt over slots by a hash; each slot counts its rows and keeps its first ``n``, so what meets at the end
    is at most ``SLOTS * n`` rows, whose first ones per slot bring the counts."""
    slot = Window.partitionBy("_slot").orderBy(*order)
    kept = (df.withColumn("_slot", F.pmod(F.xxhash64(*[F.col(f"`{c}`") for c in df.columns]), F.lit(SLOTS)))
            .withColumn("_place", F.row_number().over(slot))
            .withColumn("_rows", F.count("*").over(Window.partitionBy("_slot")))
            .filter(F.col("_place") <= n).withColumn("_one", F.lit(1)))
    few = Window.partitionBy("_one")
    return (kept.withColumn("_total", F.sum(F.when(F.col("_place") == 1, F.col("_rows"))).over(few))
            .withColumn("_place", F.row_number().over(few.orderBy(*order)))
            .filter(F.col("_place") <= n).drop("_one", "_slot", "_rows"))


def page(df: DataFrame, order: list, offset: int, limit: int) -> DataFrame:
    """One page of a totally ordered result with ``row_count`` and ``next_offset``, in one run of the result."""
    if type(limit) is not int or limit < 1:
        raise ValueError("a page needs a whole number of rows, at least one")
    if type(offset) is not int or offset < 0:
        raise ValueError("a page starts at row 0 or later")
    end = offset + limit
    rows = first_rows(df, order, end).filter(F.col("_place") > offset).orderBy("_place")
    return rows.withColumn("row_count", F.col("_total")).withColumn(
        "next_offset", F.when(F.col("_total") > end, F.lit(end))).drop("_place", "_total")


def numbered_page(df: DataFrame, order: list, number: int, size: int) -> DataFrame:
    """Page ``number`` (from 1) with ``row_count`` and the number of pages, in one run of the result."""
    if number < 1 or size < 1:
        raise ValueError("page and page size must be positive")
    rows = first_rows(df, order, number * size).filter(F.col("_place") > (number - 1) * size).orderBy("_place")
    return rows.withColumn("row_count", F.col("_total")).withColumn("page_count", F.greatest(
        F.lit(1), F.ceil(F.col("_total") / size))).drop("_place", "_total")


def limit_flag(df: DataFrame, order: list, limit: int) -> DataFrame:
    """The first ``limit`` rows and whether more follow. One row beyond the limit is fetched
    and the rest is never counted; the windows run over these few rows only."""
    probe = df.orderBy(*order).limit(limit + 1).withColumn("_one", F.lit(1))
    place = Window.partitionBy("_one").orderBy(*order)
    return (probe.withColumn("_place", F.row_number().over(place))
            .withColumn("truncated", F.count("*").over(Window.partitionBy("_one")) > limit)
            .filter(F.col("_place") <= limit).drop("_one", "_place"))


def to_chart(df: DataFrame, groups: list[str], metrics: list[str], limit: int | None = None) -> DataFrame:
    """Long ``(x, y, series)`` points of a grouped result, in chart order, NULL values
    dropped. Day and week come first in the label; year and month are one 'Mon yyyy' label.
    All points; only with a ``limit`` the first ones, and ``truncated`` tells whether more exist."""
    lead = next((g for g in ("day", "week") if g in groups), None)
    if lead:
        names = [lead] + [g for g in groups if g != lead]
        order = [F.coalesce(F.col(lead), F.lit("")), *names[1:]]
    elif "year" in groups and "month" in groups:
        names, order = None, ["year", "month", *[g for g in groups if g not in ("year", "month")]]
    else:
        names, order = groups, groups
    if names is None:
        label = F.date_format(F.make_date("year", "month", F.lit(1)), "MMM yyyy")
    elif names:
        label = F.concat_ws(" / ", *[F.coalesce(F.col(g).cast("string"), F.lit("None")) for g in names])
    else:
        label = F.lit("Total")
    shaped = df.select(label.alias("x"), *groups, *[F.col(m).cast("double").alias(m) for m in metrics])
    points = (shaped.unpivot(["x", *groups], metrics, "metric", "y").filter("y IS NOT NULL")
              .withColumn("_rank", F.array_position(F.array(*map(F.lit, metrics)), F.col("metric"))))
    series = F.col("metric") if len(metrics) > 1 else F.lit(None).cast("string")
    if limit is None:
        return points.orderBy(*order, "_rank").select("x", "y", series.alias("series"))
    return limit_flag(points, [*order, "_rank"], limit).select("x", "y", series.alias("series"), "truncated")


def to_records(df: DataFrame) -> DataFrame:
    """JSON-safe records: ISO dates as text, NaN and infinities as NULL, NULL fields kept."""
    columns = []
    for field in df.schema.fields:
        c = F.col(f"`{field.name}`")
        if isinstance(field.dataType, (T.DoubleType, T.FloatType)):
            c = F.when(~F.isnan(c) & (F.abs(c) != float("inf")), c)
        elif isinstance(field.dataType, T.DateType):
            c = c.cast("string")
        elif isinstance(field.dataType, (T.TimestampType, T.TimestampNTZType)):
            c = F.date_format(c, "yyyy-MM-dd'T'HH:mm:ss")
        columns.append(c.alias(field.name))
    return df.select(F.to_json(F.struct(*columns), {"ignoreNullFields": "false"}).alias("record"))
