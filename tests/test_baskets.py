"""Frequent pairs against counting all pairs."""

import random
from collections import Counter
from itertools import combinations

import numpy as np
import pytest
from pyspark.sql import functions as F

from werkbank.plans import baskets as B


def brute(rows, least):
    by = {}
    for order, sku in set(rows):
        by.setdefault(order, set()).add(sku)
    counts = Counter(p for skus in by.values() for p in combinations(sorted(skus), 2))
    return sorted((*p, n) for p, n in counts.items() if n >= least)


def got(frame):
    return sorted((r["sku_a"], r["sku_b"], r["order_count"]) for r in frame.collect())


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(2)
    article = lambda: f"S{min(int(rng.expovariate(0.08)), 120):03d}"
    out = [(f"O{o}", article()) for o in range(150) for _ in range(rng.randrange(1, 9))]
    out += [("long", f"S{i:03d}") for i in range(130)] + [("longer", f"S{i:03d}") for i in range(20, 160)]
    return sorted(set(out))


@pytest.mark.parametrize("least", [2, 3, 9])
@pytest.mark.parametrize("part, buckets, held", [(256, 1 << 20, 1 << 20), (16, 64, 10), (7, 1, 1)])
def test_same_as_counting_all_pairs(spark, monkeypatch, rows, least, part, buckets, held):
    """Long baskets in parts, and maps so small that most pairs share a bit: the counts stay exact."""
    monkeypatch.setattr(B, "HELD", held)
    frame = spark.createDataFrame(rows, "order_number string, sku string")
    assert got(B.frequent_pairs(frame, least, part, buckets)) == brute(rows, least)


def test_a_long_basket_is_cut_in_triangles(spark):
    frame = spark.range(2000).select(F.lit("one").alias("order_number"), F.col("id").alias("number"))
    groups = B.triangles(frame, 100).select("one", "two", F.size("numbers").alias("n")).collect()
    assert len(groups) == 20 * 21 // 2 and max(r["n"] for r in groups) < 4 * 100
    assert all(r["one"] <= r["two"] for r in groups)


def test_pairs_of_parts():
    a, b = B._pairs(np.array([3, 1, 2]), np.array([3, 1, 2]), True)
    assert sorted(zip(a.tolist(), b.tolist())) == [(1, 2), (1, 3), (2, 3)]
    a, b = B._pairs(np.array([5, 1]), np.array([3]), False)
    assert sorted(zip(a.tolist(), b.tolist())) == [(1, 3), (3, 5)]


def test_only_frequent_articles_make_pairs(spark, rows):
    """Articles below the support never reach the pairs."""
    frame = spark.createDataFrame([(f"O{i}", f"rare{i}{j}") for i in range(30) for j in range(4)] + [
        ("O1", "a"), ("O2", "a"), ("O1", "b"), ("O2", "b")], "order_number string, sku string")
    assert got(B.frequent_pairs(frame, 2)) == [("a", "b", 2)]


def test_none_and_wrong_limits(spark):
    frame = spark.createDataFrame([("1", "a")], "order_number string, sku string")
    assert got(B.frequent_pairs(frame, 2)) == [] == got(B.frequent_pairs(frame.where("false"), 2))
    for bad in (1, 0, "2", 2.0):
        with pytest.raises(ValueError):
            B.frequent_pairs(frame, bad)
