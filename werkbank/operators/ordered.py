"""Running values and look-ups that stay parallel when one key holds much of the data.

A plain window puts all rows of a key into one task. Here rows are cut once at the borders of ranges of (key, order),
so that a key of any size lies in as many ranges as it fills; each range runs its own window, and what crosses
the borders comes from a table with one row per range. A missing key is a key like any other.

Joins deal the rows of hot keys, found by a partial aggregate, over pieces.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window, functions as F

from werkbank.operators.stored import stored

HOT_ROWS = 1_000_000
PIECES = 1024


def _join_keys(left: DataFrame, right: DataFrame, keys: list[str], how: str) -> DataFrame:
    """Join on ``keys`` where NULL equals NULL; the columns of ``right`` that are not keys are added."""
    other = right.withColumnsRenamed({k: f"_right_{k}" for k in keys})
    on = reduce(lambda a, b: a & b, [left[k].eqNullSafe(other[f"_right_{k}"]) for k in keys])
    return left.join(other, on, how).drop(*[f"_right_{k}" for k in keys])


def _hot_keys(rows: DataFrame, keys: list[str], hot_rows: int) -> DataFrame:
    """The keys of at least ``hot_rows`` rows with their size ``_n``. There are at most as many as
    the table has times ``hot_rows`` rows; how they are joined is left to the planner."""
    return rows.groupBy(*keys).agg(F.count("*").alias("_n")).filter(F.col("_n") >= hot_rows)


def spread_join(rows: DataFrame, keyed: DataFrame, keys: list[str], within: str, how: str = "inner",
                hot_rows: int = HOT_ROWS, pieces: int = PIECES,
                sizes_from: DataFrame | None = None) -> DataFrame:
    """Join ``rows`` with ``keyed`` (one row per key) where some keys may hold very many rows.

    Rows of a hot key are dealt over ``pieces`` by a hash of ``within`` (a column that
    identifies a row in its key), and the ``keyed`` row of a hot key is repeated once per
    piece. ``how`` is inner, left, left_semi or left_anti; as in any join by equality, a missing
    key finds nothing. ``sizes_from`` names a cheaper table that has at least as many rows of
    each key.
    """
    counted = rows if sizes_from is None else sizes_from
    hot = _hot_keys(counted, keys, hot_rows).drop("_n").withColumn("_hot", F.lit(True))
    deal = F.pmod(F.xxhash64(within), F.lit(pieces)).cast("int")
    dealt = _join_keys(rows, hot, keys, "left").withColumn(
        "_piece", F.when(F.col("_hot"), deal).otherwise(0)).drop("_hot")
    each = F.when(F.col("_hot"), F.sequence(F.lit(0), F.lit(pieces - 1))).otherwise(F.array(F.lit(0)))
    repeated = _join_keys(keyed, hot, keys, "left").withColumn("_piece", F.explode(each)).drop("_hot")
    return dealt.join(repeated, [*keys, "_piece"], how).drop("_piece")


def in_ranges(rows: DataFrame, columns: list[str], pieces: int | None = None) -> DataFrame:
    """``rows`` cut into ``pieces`` ranges of ``columns`` (by default as many as the session has shuffle partitions), with
    ``_part``, the number of the range, and ``_tie``, a hash of the whole row: rows equal in ``columns`` are cut
    by it, so that one value may fill many ranges. Spark takes the borders from a sample of the rows; what
    hangs on them must be stored before it is read twice."""
    pieces = pieces or int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    marked = rows.withColumn("_tie", F.xxhash64(*rows.columns))
    return marked.repartitionByRange(pieces, *columns, "_tie").withColumn("_part", F.spark_partition_id())


def running_last(rows: DataFrame, keys: list[str], cut: str, mark: Column, order: list[str] | None = None,
                 before: bool = False, pieces: int | None = None) -> DataFrame:
    """Add ``position`` (1-based within the key) and ``last_mark``, the latest non-NULL
    ``mark`` at the row or earlier (``before``: strictly earlier).

    Rows run in the order of the column ``cut``, then ``order``; equal rows follow each other in any order.
    A prefix scan: each range runs a window of its own and is stored with its values. The last key of
    a range hands on how many rows it has had and its latest mark, summed over the ranges that it ends, and the
    first key of the next range adds them where it is the same key. So a key is never in one
    task, and the only ordered table there has one row per range."""
    sequence = [cut, *(order or [])]
    ranges = in_ranges(rows.withColumn("_mark", mark), [*keys, *sequence], pieces)
    within = Window.partitionBy("_part", *keys).orderBy(*sequence, "_tie")
    upto = lambda end: F.last("_mark", ignorenulls=True).over(within.rowsBetween(Window.unboundedPreceding, end))
    values = {"_place": F.row_number().over(within), "_upto": upto(Window.currentRow)}
    local = stored(ranges.withColumns(values | ({"_own": upto(-1)} if before else {})).drop("_mark", "_tie"), "ranges")

    key = F.struct(*keys)
    ends = local.groupBy("_part").agg(F.min(key).alias("_first"), F.max(key).alias("_last"), F.max_by(
        F.struct(F.col("_place").cast("long").alias("n"), "_upto"), F.struct(key, "_place")).alias("_end"))
    so_far = Window.partitionBy("_last").orderBy("_part").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    handed = ends.select("_part", "_first", "_last", F.sum("_end.n").over(so_far).alias("_n"),
                         F.last("_end._upto", ignorenulls=True).over(so_far).alias("_carry"))
    next_range = Window.orderBy("_part")
    handed = handed.select("_part", "_first", *[F.lag(c).over(next_range).alias(c) for c in ("_last", "_n", "_carry")])
    handed = handed.filter(F.col("_last").eqNullSafe(F.col("_first")) & F.col("_last").isNotNull()).drop("_last")
    follows = key.eqNullSafe(F.col("_first"))
    own = "_own" if before else "_upto"
    return (local.join(handed, "_part", "left")
            .withColumn("position", F.col("_place") + F.when(follows, F.col("_n")).otherwise(0))
            .withColumn("last_mark", F.coalesce(own, F.when(follows, F.col("_carry"))))
            .drop("_part", "_first", "_n", "_carry", "_place", "_upto", "_own"))


def hot_keys(rows: DataFrame, keys: list[str], hot_rows: int | None = None) -> DataFrame | None:
    """The keys of at least ``hot_rows`` rows (by default ``HOT_ROWS``), stored; None if there are none."""
    hot = stored(_hot_keys(rows, keys, HOT_ROWS if hot_rows is None else hot_rows).drop("_n"), "hot_keys")
    return None if hot.isEmpty() else hot


def running_last_by_key(rows: DataFrame, keys: list[str], cut: str, mark: Column, hot: DataFrame | None,
                        pieces: int | None = None) -> tuple[DataFrame, DataFrame | None]:
    """``running_last`` for a table of very many keys, in two parts: the rows of all keys but the ``hot`` ones (``hot_keys``),
    dealt by key once and not stored, and those of the hot keys, by ranges (None without hot keys). The first part
    comes dealt by ``keys``, so that a join on them shuffles it no more."""
    cold = rows if hot is None else _join_keys(rows, hot, keys, "left_anti")
    # The mark and the tie are made behind the shuffle, which would carry them.
    dealt = cold.repartition(*keys).withColumn("_mark", mark).withColumn("_tie", F.xxhash64(*rows.columns, "_mark"))
    within = Window.partitionBy(*keys).orderBy(cut, "_tie")
    last = F.last("_mark", ignorenulls=True).over(within.rowsBetween(Window.unboundedPreceding, Window.currentRow))
    placed = dealt.withColumns({"position": F.row_number().over(within).cast("long"), "last_mark": last}).drop("_mark", "_tie")
    return placed, None if hot is None else running_last(_join_keys(rows, hot, keys, "left_semi"), keys, cut, mark, pieces=pieces)


def global_rank(rows: DataFrame, at: str, order: list[str], pieces: int | None = None) -> DataFrame:
    """Add ``rank``, the 1-based position in the order of timestamp ``at`` then ``order``: a prefix scan over all rows."""
    staged = rows.withColumn("_all", F.lit(True)).withColumn("_at", F.unix_micros(F.col(at).cast("timestamp")))
    ranked = running_last(staged, ["_all"], "_at", F.lit(None).cast("int"), order, pieces=pieces)
    return ranked.withColumnRenamed("position", "rank").drop("_all", "_at", "last_mark")
