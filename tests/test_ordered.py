"""Hot keys: cutting keys into pieces changes no result."""

import random

import pytest
from pyspark.sql import Window, functions as F

from werkbank.operators.ordered import global_rank, in_ranges, running_last, spread_join


@pytest.fixture(scope="module")
def rows(spark):
    rng = random.Random(7)
    data, seen = [], set()
    for _ in range(3000):
        key = "hot" if rng.random() < 0.4 else f"k{rng.randrange(200)}"
        at = rng.randrange(10 ** 9)
        if (key, at) not in seen:
            seen.add((key, at))
            data.append((key, at, rng.choice([None, None, None, rng.randrange(9)])))
    return spark.createDataFrame(data, "k string, at long, m int").cache()


def sizes(frame, columns, pieces):
    return [r["count"] for r in in_ranges(frame, columns, pieces).groupBy("_part").count().collect()]


@pytest.mark.parametrize("key", ["hot", None])
def test_ranges_stay_even(spark, key):
    """One outlying value, equal leading columns, all order columns equal, a missing key: no range much above the mean."""
    outlier = spark.createDataFrame([(key, i if i else 10 ** 15, i) for i in range(4000)], "k string, at long, i long")
    ties = spark.createDataFrame([(key, 7, i) for i in range(4000)], "k string, at long, i long")
    for frame, columns in ((outlier, ["k", "at"]), (ties, ["k", "at", "i"]), (ties, ["k", "at"])):
        found = sizes(frame, columns, 8)
        assert len(found) == 8 and sum(found) == 4000 and max(found) < 2 * 4000 / 8


def test_a_range_is_whole(rows):
    """Ranges follow each other in the order of key and cut."""
    found = sorted((r["p"], r["a"], r["b"]) for r in in_ranges(rows, ["k", "at"], 7).groupBy(F.col("_part").alias("p")).agg(
        F.min(F.struct("k", "at")).alias("a"), F.max(F.struct("k", "at")).alias("b")).collect())
    assert len(found) == 7 and all(x[2] < y[1] for x, y in zip(found, found[1:]))


def test_missing_keys_run_like_others(spark, rows):
    frame = rows.withColumn("k", F.when(F.col("k") != "hot", F.col("k")))
    w = Window.partitionBy("k").orderBy("at")
    want = frame.select("k", "at", F.row_number().over(w).alias("p"), F.last("m", ignorenulls=True).over(
        w.rowsBetween(Window.unboundedPreceding, 0)).alias("l"))
    got = running_last(frame, ["k"], "at", F.col("m"), pieces=9).select("k", "at", "position", "last_mark")
    assert sorted(map(tuple, got.collect()), key=repr) == sorted(map(tuple, want.collect()), key=repr)


@pytest.mark.parametrize("before", [False, True])
@pytest.mark.parametrize("pieces", [1, 7, 16, 200, None])
def test_running_last_equals_one_window(rows, before, pieces):
    w = Window.partitionBy("k").orderBy("at")
    span = w.rowsBetween(Window.unboundedPreceding, -1 if before else 0)
    want = rows.select("k", "at", F.row_number().over(w).alias("position"),
                       F.last("m", ignorenulls=True).over(span).alias("last_mark"))
    got = running_last(rows, ["k"], "at", F.col("m"), before=before, pieces=pieces).select(
        "k", "at", "position", "last_mark")
    assert sorted(map(tuple, got.collect()), key=repr) == sorted(map(tuple, want.collect()), key=repr)


@pytest.mark.parametrize("how", ["inner", "left", "left_semi", "left_anti"])
@pytest.mark.parametrize("hot_rows", [1, 500, 10 ** 6])
def test_spread_join_equals_join(spark, rows, how, hot_rows):
    keyed = spark.createDataFrame([("hot", "H"), ("k1", "A"), ("k2", "B"), ("zz", "Z")], "k string, v string")
    want = rows.join(keyed, "k", how)
    got = spread_join(rows, keyed, ["k"], "at", how, hot_rows, 8).select(want.columns)
    assert sorted(map(tuple, got.collect()), key=repr) == sorted(map(tuple, want.collect()), key=repr)


def test_global_rank(spark, rows):
    timed = rows.withColumn("ts", F.timestamp_seconds(F.col("at") / 1000)).drop("m")
    got = global_rank(timed, "ts", ["k", "at"], pieces=8).orderBy("rank").collect()
    want = timed.orderBy("ts", "k", "at").collect()
    assert [(r.k, r.at) for r in got] == [(r.k, r.at) for r in want]
    assert [r["rank"] for r in got] == list(range(1, len(want) + 1))


def test_equal_rows_each_get_a_position(spark):
    """One key, one moment, many rows, some equal in all columns: positions from 1 without gaps."""
    frame = spark.createDataFrame([("a", 1, i % 700) for i in range(2000)] + [("b", 1, 0)] * 3, "k string, at long, i long")
    got = running_last(frame, ["k"], "at", F.lit(None).cast("int"), pieces=9).collect()
    for key, n in (("a", 2000), ("b", 3)):
        assert sorted(r["position"] for r in got if r["k"] == key) == list(range(1, n + 1))


def test_two_keys_of_one_name_part(spark):
    """Keys of several columns, with nulls in one of them, cross borders like others."""
    frame = spark.createDataFrame([(a, b, i, i if i % 40 == 0 else None) for a in ("x", None) for b in (1, None) for i in range(200)],
                                  "a string, b int, at long, m long")
    got = running_last(frame, ["a", "b"], "at", F.col("m"), pieces=11).collect()
    assert len(got) == 800 and all(r["position"] == r["at"] + 1 and r["last_mark"] == r["at"] // 40 * 40 for r in got)


def test_empty_rows(spark, rows):
    got = running_last(rows.where("false"), ["k"], "at", F.col("m"))
    assert got.count() == 0 and {"position", "last_mark"} <= set(got.columns)


def test_scans_and_shuffles_of_a_scan(spark, rows):
    """After the one cut nothing but a row per range is shuffled; no join with borders, no look for hot keys."""
    plan = running_last(rows, ["k"], "at", F.col("m"))._jdf.queryExecution().executedPlan().toString()
    assert plan.count("FileScan") == 2 and "rangepartitioning" not in plan
