"""Mixing sources to target weights: a min-cost flow over membership patterns, then seeded documents."""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from werkbank.llm.common import stored, table
from werkbank.operators.ordered import running_last

WORDS = r"[^\x20\x09-\x0D]+"
#: Bits of a document's seeded hash that one round of sums looks at, and the rounds.
BITS, ROUNDS = 12, 2
PLAN = "key string, sizes array<long>, goals array<double>, copies long, rest long"


def targets(sizes: dict[str | None, int], weights: tuple[float, ...], most: int) -> dict[str | None, float]:
    """The words each source should give: all words shared by weight (sources by code point, null last,
    weights repeating); a target stops at ``most`` times its source, what is over is shared again."""
    names = sorted((s for s in sizes if s is not None)) + [None] * (None in sizes)
    weight = {s: weights[i % len(weights)] for i, s in enumerate(names)}
    rest, open_, out = float(sum(sizes.values())), list(names), {}
    while open_:
        whole = sum(weight[s] for s in open_)
        share = {s: rest * weight[s] / whole for s in open_}
        over = [s for s in open_ if share[s] > most * sizes[s]]
        if not over:
            return out | share
        for s in over:
            out[s] = float(most * sizes[s])
            rest -= out[s]
        open_ = [s for s in open_ if s not in out]
    return out


def route(capacity: dict[str, int], members: dict[str, list], quota: dict[str | None, int], most: int) -> dict[str, int]:
    """Words that each pattern gives: a flow of least cost from the patterns to the quotas of their
    sources. The r-th copy of a pattern is an arc of its size and of cost r, so costs are convex and
    words repeat only where nothing unused is left. Shortest paths, one after the other."""
    nodes = ["from", *(("p", p) for p in capacity), *(("s", s) for s in quota), "to"]
    number = {x: i for i, x in enumerate(nodes)}
    head, cost, room, out = [], [], [], [[] for _ in nodes]

    def arc(a, b, c: int, r: int) -> None:
        for x, y, c, r in ((a, b, c, r), (b, a, -c, 0)):
            out[number[x]].append(len(head))
            head.append(number[y])
            cost.append(c)
            room.append(r)

    for p, size in capacity.items():
        for copy in range(1, most + 1):
            arc("from", ("p", p), copy, size)
        for s in members[p]:
            arc(("p", p), ("s", s), 0, most * size)
    for s, words in quota.items():
        arc(("s", s), "to", 0, words)
    given = dict.fromkeys(capacity, 0)
    while True:
        far, by, queue = {0: 0}, {}, [0]
        while queue:  # costs may be negative on the way back, so nodes can be visited again
            below = []
            for a in queue:
                for k in out[a]:
                    if room[k] and far[a] + cost[k] < far.get(head[k], float("inf")):
                        far[head[k]], by[head[k]] = far[a] + cost[k], k
                        below.append(head[k])
            queue = list(dict.fromkeys(below))
        if number["to"] not in far:
            break
        path, at = [], number["to"]
        while at:
            path.append(by[at])
            at = head[by[at] ^ 1]
        words = min(room[k] for k in path)
        for k in path:
            room[k] -= words
            room[k ^ 1] += words
    for k in out[0]:
        given[nodes[head[k]][1]] += room[k ^ 1]
    return given


def _settled(spark: SparkSession, sums: DataFrame, weights: tuple[float, ...], most: int, max_patterns: int) -> DataFrame | None:
    """``key``, ``sizes``, ``goals``, ``copies`` and ``rest`` of every pattern from its ``size``, by the flow on the driver;
    None where there are more than ``max_patterns``."""
    found = sums.limit(max_patterns + 1).collect()
    if len(found) > max_patterns:
        return None
    capacity = {r["key"]: r["size"] for r in found}
    of = {k: json.loads(k)["s"] for k in capacity}
    sizes: dict[str | None, int] = {}
    for k, size in capacity.items():
        for s in of[k]:
            sizes[s] = sizes.get(s, 0) + size
    goal = targets(sizes, weights, most)
    given = route(capacity, of, {s: round(t) for s, t in goal.items()}, most)
    return spark.createDataFrame([(k, [sizes[s] for s in of[k]], [goal[s] for s in of[k]], given[k] // c if c else 0, given[k] % c if c else 0)
                                  for k, c in capacity.items()], PLAN)


def _settled_alone(sums: DataFrame, weights: tuple[float, ...], most: int) -> DataFrame:
    """The same for any number of patterns of one source each, as a table: every source has one arc, so the flow gives it
    its target. Targets are what ``targets`` finds: a source stops at ``most`` times its size, and the sources with the
    smallest size for their weight stop first, so each round of sums finds those that the share of the others fills."""
    source = F.get(F.from_json("key", "s array<string>")["s"], F.lit(0))
    cases = F.element_at(F.array(*map(F.lit, map(float, weights))), (F.pmod(F.col("rank") - 1, F.lit(len(weights))) + 1).cast("int"))
    rows = sums.withColumn("source", source).withColumn("missing", source.isNull())
    rows = stored(global_position(rows, ["missing", "source"]).withColumn("weight", cases), "sources")
    share = None
    while True:
        full = F.lit(False) if share is None else share * F.col("weight") > most * F.col("size")
        rest, whole = rows.agg(F.sum(F.col("size")) - F.coalesce(F.sum(F.when(full, most * F.col("size"))), F.lit(0)),
                               F.sum(F.when(~full, F.col("weight")))).first()
        new = float(rest) / whole if whole else 0.0
        if share is not None and new <= share:
            break
        share = new
    goal = F.least(share * F.col("weight"), (most * F.col("size")).cast("double"))
    given = F.round(goal).cast("long")
    whole = lambda c: F.when(F.col("size") > 0, c).otherwise(0)
    return rows.select("key", F.array("size").alias("sizes"), F.array(goal).alias("goals"), whole(F.call_function("div", given, F.col(
        "size"))).alias("copies"), whole(given % F.col("size")).alias("rest"))


def global_position(rows: DataFrame, order: list[str]) -> DataFrame:
    """``rows`` with ``rank``, their position in an order, counted range by range."""
    return running_last(rows.withColumn("_every", F.lit(True)), ["_every"], order[0], F.lit(None).cast("int"), order[1:]).drop(
        "_every", "last_mark").withColumnRenamed("position", "rank")


def mix_sources(docs: DataFrame, members: Column | None = None, weights: tuple[float, ...] = (1, 2, 3),
                most: int = 3, seed: int = 0, max_patterns: int = 10_000) -> DataFrame:
    """All rows of ``docs`` with a struct ``_mix``: ``size`` (words of the text), ``source_sizes`` and
    ``targets`` (of the row's sources) and ``taken`` (words that the mix takes, copies counted).

    ``members`` is an array of the sources that a document belongs to; by default its ``source``.
    Null is a source of its own, null and empty texts have no words, very long ones are counted whole, no document is taken
    more than ``most`` times, repeated rows and rows without an id are documents like others, and an empty table gives
    an empty result. Other columns are kept, whatever their names, but a column ``_mix`` of the input is replaced.

    The flow runs on the driver over sums per pattern of sources, up to ``max_patterns`` of them. More patterns of one
    source each are settled as a table, with the same result; only more than that of overlapping sources are an error. In
    the order of a seeded hash of id and text a pattern's documents are taken once more until its words are reached:
    ``ROUNDS`` rounds of sums per pattern and ``BITS`` bits narrow the border down, so that a window is needed
    only for the few rows of the last interval. No text is shuffled but theirs."""
    single = members is None
    members = F.array_sort(F.array_distinct(F.array("source") if members is None else members))
    key = F.to_json(F.struct(F.transform(members, lambda x: x.cast("string")).alias("s")),
                    {"ignoreNullFields": "false"})
    # The row travels as one column, so that no name of it can clash.
    packed = docs.drop("_mix")
    sized = docs.select(F.struct(*[F.col(f"`{c}`") for c in packed.columns]).alias("row"), key.alias("key"), F.coalesce(
        F.regexp_count("text", F.lit(WORDS)), F.lit(0)).cast("long").alias("size"),
        F.xxhash64(F.lit(seed), "doc_id", F.xxhash64("text")).alias("hash"))
    thin = stored(sized.select("key", "size", "hash"), "mixing")
    spark = docs.sparkSession
    sums = stored(thin.groupBy("key").agg(F.sum("size").alias("size")), "patterns")
    plan = _settled(spark, sums, weights, most, max_patterns)
    few = plan is not None
    if not few:
        if not single:
            raise ValueError(f"more than {max_patterns} combinations of sources")
        plan = _settled_alone(sums, weights, most)
    # One row per pattern, at most max_patterns where it is broadcast.
    small = F.broadcast if few else lambda frame: frame
    border = stored(plan.where("rest > 0").select("key", "rest", F.lit(0).cast("long").alias("prefix")), "borders")
    for level in range(1, ROUNDS + 1):
        part = F.shiftrightunsigned("hash", 64 - BITS * level)
        inside = thin.join(small(border), "key").where(F.lit(True) if level == 1 else F.shiftrightunsigned(
            "hash", 64 - BITS * (level - 1)) == F.col("prefix"))
        in_order = Window.partitionBy("key").orderBy("part")  # at most 2 ** BITS rows
        parts = inside.groupBy("key", "rest", part.alias("part")).agg(F.sum("size").alias("size")).withColumn(
            "upto", F.sum("size").over(in_order)).where(F.col("upto") >= F.col("rest"))
        border = stored(parts.groupBy("key").agg(F.min(F.struct(F.col("part").alias("prefix"), (
            F.col("rest") - F.col("upto") + F.col("size")).alias("rest"))).alias("b")).select("key", "b.rest", "b.prefix"), "borders")
    told = stored(plan.drop("rest").join(border, "key", "left"), "mix_plan")
    rows = sized.join(small(told), "key")
    place = F.shiftrightunsigned("hash", 64 - BITS * ROUNDS)
    base, cut = F.col("size") * F.col("copies"), F.col("prefix").isNotNull()
    at_border = cut & (place == F.col("prefix"))
    before = F.coalesce(F.sum("size").over(
        Window.partitionBy("key").orderBy("hash").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    away = rows.where(~at_border).withColumn("taken", base + F.when(cut & (place < F.col("prefix")), F.col("size")).otherwise(0))
    near = rows.where(at_border).withColumn("taken", base + F.greatest(F.lit(0), F.least("size", F.col("rest") - before)))
    return away.unionByName(near).select("row.*", F.struct(
        "size", F.col("sizes").alias("source_sizes"), F.col("goals").alias("targets"), "taken").alias("_mix"))


def repeated(docs: DataFrame, **settings) -> DataFrame:
    """The mix as documents: each as often as it is taken, a part of it as one more copy; those of
    which nothing is taken go.

    Copies of a document follow each other. Null and empty texts have no words and go; very long texts are copied whole;
    repeated rows and rows without an id are documents like others; other columns stay, whatever their names; an empty
    table gives an empty result."""
    copies = F.ceil(F.col("_mix.taken") / F.col("_mix.size")).cast("int")
    mixed = mix_sources(docs, **settings).where("_mix.taken > 0")
    return mixed.withColumn("_mix", F.explode(F.sequence(F.lit(1), copies))).drop("_mix")


def op4_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed = mix_sources(table(spark, sf_dir, "documents"))
    return mixed.select("doc_id", "_mix.size", F.col("_mix.source_sizes")[0].alias("source_size"),
                        F.col("_mix.targets")[0].alias("target"), "_mix.taken")
