"""Frequent pairs of articles: how often two are bought together, of all pairs that are often enough."""

from __future__ import annotations

import sys
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame, functions as F

from werkbank.operators.stored import stored

cloudpickle.register_pickle_by_value(sys.modules[__name__])

#: Articles of a basket that meet in one group, and hashed counters of pairs (8 bytes each in a task; the map that
#: comes of them has one bit each).
PART, BUCKETS = 256, 1 << 20
#: Pairs that a task holds before it sums them and hands them on.
HELD = 1 << 20


def _pairs(left: np.ndarray, right: np.ndarray, same: bool) -> tuple[np.ndarray, np.ndarray]:
    """All pairs of two parts of a basket, or of one part with itself; the smaller number first."""
    if same:
        i, j = np.triu_indices(len(left), 1)
        a, b = left[i], left[j]
    else:
        a, b = np.repeat(left, len(right)), np.tile(right, len(left))
    return np.minimum(a, b), np.maximum(a, b)


def _bucket(a: np.ndarray, b: np.ndarray, buckets: int) -> np.ndarray:
    mixed = (a.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) ^ (b.astype(np.uint64) * np.uint64(0xC2B2AE3D27D4EB4F))
    return ((mixed ^ (mixed >> np.uint64(29))) % np.uint64(buckets)).astype(np.int64)


def _generated(batch: pa.RecordBatch) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    for one, two, parts, articles in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2), batch.column(3)):
        part, number = np.array(parts.as_py()), np.array(articles.as_py(), np.int64)
        yield _pairs(number[part == one], number[part == two], one == two)


def triangles(baskets: DataFrame, part: int = PART) -> DataFrame:
    """Rows of ``order_number`` and ``number`` as groups of articles that meet: one row for a basket of up to ``part``
    articles; a longer one is dealt to parts, and each two parts make a row of their own. ``one`` and ``two`` name the
    parts, ``parts`` the part of each article. No row holds more than about two parts."""
    sizes = baskets.groupBy("order_number").agg(F.ceil(F.count("*") / part).cast("int").alias("n"))
    dealt = baskets.join(sizes, "order_number").withColumn("own", F.pmod(F.xxhash64("number"), F.col("n")).cast("int"))
    other = F.explode(F.sequence(F.lit(0), F.col("n") - 1))
    spread = dealt.withColumn("other", other).select(
        "order_number", F.least("own", "other").alias("one"), F.greatest("own", "other").alias("two"), "own", "number")
    return spread.groupBy("order_number", "one", "two").agg(
        F.collect_list("own").alias("parts"), F.collect_list("number").alias("numbers")).select("one", "two", "parts", "numbers")


def frequent_pairs(baskets: DataFrame, min_orders: int, part: int = PART, buckets: int = BUCKETS) -> DataFrame:
    """``sku_a``, ``sku_b`` (in this order by text) and ``order_count`` of every pair that at least ``min_orders``
    baskets (distinct ``order_number`` and ``sku``) hold.

    Three passes, all of them exact. Only articles that are frequent themselves can be in a frequent pair, so the
    others go first. Then pairs are counted by a hash, a fixed number of counters per task, and the sums become a map
    of bits: a pair whose bits' sum is too small can't be frequent. Only pairs that pass it are counted by name, summed in
    the task before they are shuffled. Long baskets are cut in parts that meet two by two, so no task
    generates all pairs of one."""
    if type(min_orders) is not int or min_orders < 2:
        raise ValueError("a frequent pair is on two orders at least")
    baskets = stored(baskets, "baskets")
    support = baskets.groupBy("sku").agg(F.count("*").alias("orders")).filter(F.col("orders") >= min_orders)
    # The number of an article is fixed once it is stored.
    named = stored(support.select("sku", F.monotonically_increasing_id().alias("number")), "articles")
    groups = stored(triangles(baskets.join(named, "sku").select("order_number", "number"), part), "triangles")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = np.zeros(buckets, np.int64)
        for batch in batches:
            for a, b in _generated(batch):
                np.add.at(sums, _bucket(a, b, buckets), 1)
        at = np.flatnonzero(sums)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(sums[at])], ["bucket", "n"])

    full = groups.mapInArrow(count, "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n")).filter(
        F.col("n") >= min_orders).select("bucket").toArrow()  # at most a number per bucket
    bits = np.zeros(buckets, bool)
    bits[full["bucket"].to_numpy()] = True
    packed = np.packbits(bits)

    def summed(held: list) -> pa.RecordBatch:
        a, b = (np.concatenate([np.empty(0, np.int64), *(h[i] for h in held)]) for i in (0, 1))
        order = np.lexsort((b, a))
        a, b = a[order], b[order]
        starts = np.flatnonzero((np.diff(a, prepend=-1) != 0) | (np.diff(b, prepend=-1) != 0))
        return pa.RecordBatch.from_arrays([pa.array(a[starts]), pa.array(b[starts]), pa.array(
            np.diff(np.append(starts, len(a))))], ["a", "b", "n"])

    def pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        may, held, n = np.unpackbits(packed, count=buckets).astype(bool), [], 0
        for batch in batches:
            for a, b in _generated(batch):
                able = may[_bucket(a, b, buckets)]
                held.append((a[able], b[able]))
                n += len(held[-1][0])
                if n > HELD:
                    yield summed(held)
                    held, n = [], 0
        yield summed(held)

    counted = groups.mapInArrow(pairs, "a long, b long, n long").groupBy("a", "b").agg(F.sum("n").alias("order_count")).filter(
        F.col("order_count") >= min_orders)
    name = lambda side: named.select(F.col("number").alias(side), F.col("sku").alias(f"sku_{side}"))
    return counted.join(name("a"), "a").join(name("b"), "b").select(
        F.least("sku_a", "sku_b").alias("sku_a"), F.greatest("sku_a", "sku_b").alias("sku_b"), "order_count")
