"""Ranked lexical search: an index partitioned by term, and bundles of an item that pass from one owner of terms to the
next, each adding what its terms give to the documents found so far."""

from __future__ import annotations

import math
import sys
from array import array
from collections import Counter
from collections.abc import Iterator
from functools import reduce
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark import TaskContext, cloudpickle
from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from werkbank.llm.common import stored, table
from werkbank.llm.licenses import words

cloudpickle.register_pickle_by_value(sys.modules[__name__])

#: Documents per item, owners of terms, and the most documents and postings of a shard.
K, OWNERS, SHARD, POSTINGS = 50, 3, 1 << 14, 1 << 21
#: Items that a bundle's group holds at most, and about how many terms of items are searched in one pass.
PART, BLOCK = 256, 1_000_000
#: What a word can give at most for each point of its term's weight.
MOST = 1_000_000
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
TERM = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"

_PLACES, _NUMBERS = np.dtype("<u2"), np.dtype("<i8")
_INDEX = pa.schema([("shard", pa.int64()), ("term", pa.int32()), ("docs", pa.binary()), ("times", pa.binary()),
                    ("sizes", pa.binary()), ("seen", pa.int64()), ("total", pa.int64())])
_BUNDLE = pa.schema([("shard", pa.int64()), ("part", pa.int32()), ("item", pa.int32()), ("docs", pa.binary()),
                     ("scores", pa.binary())])
_FOUND = pa.schema([("item", pa.int32()), ("doc_id", pa.int64()), ("score", pa.int64())])


class Plan(NamedTuple):
    """What the owners need of a pass: per part of items and per item the terms with their weights, owner by
    owner, and the most that the owners after each one can add; and the sums of the corpus."""

    parts: dict[int, list[tuple[int, list[list[tuple[int, int]]], list[int]]]]
    documents: int
    words: int


def term_index(docs: DataFrame, number: dict[bytes, int]) -> DataFrame:
    """Postings of the terms in ``number``. Rows of a task make shards of at most ``SHARD`` documents and about
    ``POSTINGS`` postings; a row per shard and term holds the documents (places in the shard), how often each has the
    term, and the documents' sizes. One row per shard with ``term`` -1 holds ids, which ids are missing, and sizes;
    its ``seen`` and ``total`` are the documents with a term and all their terms."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard, task = 0, TaskContext.get().partitionId()
        ids, sizes, terms, times, places = array("q"), array("q"), array("i"), array("q"), array("i")
        missing = bytearray()

        def flush() -> pa.RecordBatch:
            term, place = np.frombuffer(terms, np.int32), np.frombuffer(places, np.int32)
            time, size = np.frombuffer(times, np.int64), np.frombuffer(sizes, np.int64)
            order = np.argsort(term, kind="stable")
            term, place, time = term[order], place[order], time[order]
            starts = np.flatnonzero(np.diff(term, prepend=-1))
            cuts = [slice(a, b) for a, b in zip(starts.tolist(), [*starts[1:].tolist(), len(term)])]
            one = (task << 32) + shard
            return pa.RecordBatch.from_arrays([
                pa.array([one] * (len(cuts) + 1), pa.int64()), pa.array([-1, *term[starts].tolist()], pa.int32()),
                pa.array([ids.tobytes(), *(place[c].astype(_PLACES).tobytes() for c in cuts)], pa.binary()),
                pa.array([bytes(missing), *(time[c].astype(_NUMBERS).tobytes() for c in cuts)], pa.binary()),
                pa.array([sizes.tobytes(), *(size[place[c]].astype(_NUMBERS).tobytes() for c in cuts)], pa.binary()),
                pa.array([int((size > 0).sum()), *(c.stop - c.start for c in cuts)], pa.int64()),
                pa.array([int(size.sum()), *[None] * len(cuts)], pa.int64())], schema=_INDEX)

        for batch in batches:
            for doc, text in zip(batch.column(0), batch.column(1)):
                found = words(text.as_py())
                known = Counter(map(number.get, found))
                known.pop(None, None)
                terms.extend(known)
                times.extend(known.values())
                places.extend([len(ids)] * len(known))
                missing.append(not doc.is_valid)
                ids.append(doc.as_py() or 0)
                sizes.append(len(found))
                if len(ids) == SHARD or len(terms) >= POSTINGS:
                    yield flush()
                    shard += 1
                    ids, sizes, terms, times, places = array("q"), array("q"), array("i"), array("q"), array("i")
                    missing = bytearray()
        if ids:
            yield flush()

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("binary").alias("text"))
    return rows.mapInArrow(run, "shard long, term int, docs binary, times binary, sizes binary, seen long, total long")


def weight(documents: int, having: int) -> int:
    return math.floor(1000 * math.log((2 * documents + 2) / (2 * having + 1)))


def plan_of(items: list[set[int]], seen: dict[int, int], documents: int, total: int, owners: int) -> tuple[Plan, dict[int, int]]:
    """The plan of a pass and each term's owner. The rarest terms have the first owner, and owners have about
    equally many postings, so the bundles are short until the common terms come, and then hold only documents
    that can still be among the best."""
    weights = {t: weight(documents, n) for t, n in seen.items()}
    whole, so_far, owner = max(1, sum(seen.values())), 0, {}
    for t in sorted(weights, key=lambda t: (-weights[t], t)):
        owner[t] = min(owners - 1, so_far * owners // whole)
        so_far += seen[t]
    parts: dict[int, list] = {}
    for i, terms in enumerate(items):
        own = [[(t, weights[t]) for t in sorted(terms) if owner.get(t) == s] for s in range(owners)]
        rest = [MOST * sum(w for later in own[s + 1:] for _, w in later) for s in range(owners)]
        parts.setdefault(i // PART, []).append((i, own, rest))
    return Plan(parts, documents, total), owner


def gains(times: np.ndarray, sizes: np.ndarray, plan: Plan) -> np.ndarray:
    """What each posting gives for a point of weight. Whole numbers of any size where 64 bits could overflow."""
    if plan.documents * int(sizes.max(initial=0)) * 50 >= 2 ** 63 or int(times.max(initial=0)) >= 2 ** 63 // 10 ** 9:
        times, sizes = times.astype(object), sizes.astype(object)
    length = 50 + 50 * sizes * plan.documents // plan.words
    return ((1_000_000_000 * times) // (1000 * times + 20 * length)).astype(np.int64)


def passed_on(bundles: DataFrame, postings: DataFrame, plan: Plan, owner: int, k: int) -> DataFrame:
    """The bundles after an owner has added what its postings give. A document leaves a bundle when even the most that
    the owners still to come can add leaves it below the ``k`` best of its shard, so no result is lost."""

    def run(key: tuple, left: pa.Table, right: pa.Table) -> pa.Table:
        shard, part = key[0].as_py(), key[1].as_py()
        held = {i: (np.frombuffer(d, _PLACES), np.frombuffer(s, _NUMBERS)) for i, d, s in zip(
            left["item"].to_pylist(), left["docs"].to_pylist(), left["scores"].to_pylist())}
        given = {t: (np.frombuffer(d, _PLACES), gains(np.frombuffer(x, _NUMBERS), np.frombuffer(n, _NUMBERS), plan))
                 for t, d, x, n in zip(*(right[c].to_pylist() for c in ("term", "docs", "times", "sizes")))}
        items, docs, scores, sums = [], [], [], np.zeros(SHARD, np.int64)
        for item, own, rest in plan.parts[part]:
            mine = [(given[t], w) for t, w in own[owner] if t in given]
            if not mine and item not in held:
                continue
            sums[:] = 0
            if item in held:
                sums[held[item][0]] = held[item][1]
            for (at, gain), w in mine:
                sums[at] += w * gain
            at = np.flatnonzero(sums)
            score = sums[at]
            if len(at) > k:
                able = score + rest[owner] >= np.partition(score, -k)[-k]
                at, score = at[able], score[able]
            if len(at):
                items.append(item)
                docs.append(at.astype(_PLACES).tobytes())
                scores.append(score.astype(_NUMBERS).tobytes())
        n = len(items)
        return pa.table([pa.array([shard] * n, pa.int64()), pa.array([part] * n, pa.int32()), pa.array(items, pa.int32()),
                         pa.array(docs, pa.binary()), pa.array(scores, pa.binary())], schema=_BUNDLE)

    return bundles.groupBy("shard", "part").cogroup(postings.groupBy("shard", "part")).applyInArrow(
        run, "shard long, part int, item int, docs binary, scores binary")


def selected(bundles: DataFrame, heads: DataFrame, k: int) -> DataFrame:
    """``item``, ``doc_id`` and ``score`` of the ``k`` best documents of each bundle, with the ids of its shard."""

    def run(key: tuple, left: pa.Table, right: pa.Table) -> pa.Table:
        out = [[np.empty(0, np.int64)] for _ in range(4)]
        if right.num_rows:
            ids = np.frombuffer(right["docs"][0].as_py(), _NUMBERS)
            missing = np.frombuffer(right["times"][0].as_py(), np.uint8)
            for item, docs, scores in zip(*(left[c].to_pylist() for c in ("item", "docs", "scores"))):
                at, score = np.frombuffer(docs, _PLACES), np.frombuffer(scores, _NUMBERS)
                best = np.lexsort((ids[at], missing[at], -score))[:k]
                for column, part in zip(out, (np.full(len(best), item), ids[at[best]], score[best], missing[at[best]])):
                    column.append(part)
        item, doc, score, gone = (np.concatenate(c) for c in out)
        return pa.table([pa.array(item, pa.int32()), pa.array(doc, pa.int64(), mask=gone.astype(bool)),
                         pa.array(score, pa.int64())], schema=_FOUND)

    return bundles.groupBy("shard").cogroup(heads.groupBy("shard")).applyInArrow(run, "item int, doc_id long, score long")


def ranked_search(docs: DataFrame, items: DataFrame, k: int = K, owners: int = OWNERS) -> DataFrame:
    """``item_id``, ``rank`` (from 1), ``doc_id`` and ``score`` of the ``k`` best documents of each item, those of a
    score above 0, equal scores by ascending id.

    Terms are runs of digits, letters and all beyond ASCII, A-Z made small. Documents with a null or empty text count
    as having no term; very long texts are counted whole. Each row is a document, so repeated rows are found as often as
    they stand; rows without an id come after all others of their score. Rows of one ``item_id`` (null is one
    too) are one item with the terms of all of them; items without a term, or with none that a document has, give no
    row, nor does an empty table. Other columns are ignored.

    Items go through in passes of about ``BLOCK`` terms, each over all documents: their terms, numbered, are what is
    sent to the tasks and what comes back to the driver (a number per term). Documents stay where they are read:
    the rows of a task are shards, and an item's bundle of a shard meets the shard's postings of one owner after the
    other."""
    spark = docs.sparkSession
    found = F.regexp_extract_all(F.translate("text", UPPER, LOWER), F.lit(TERM), F.lit(0))
    wanted = stored(items.select("item_id", F.explode(found).alias("term")).distinct(), "items")
    blocks = -(-wanted.count() // BLOCK)
    dealt = wanted.withColumn("block", F.pmod(F.xxhash64("item_id"), F.lit(max(1, blocks))))
    passes = [_one_pass(spark, docs, dealt.where(F.col("block") == b).select("item_id", "term"), k, owners) for b in range(blocks)]
    passes = [p for p in passes if p is not None]
    if not passes:
        return wanted.where("false").select("item_id", F.lit(0).alias("rank"), F.lit(0).cast("long").alias("doc_id"),
                                            F.lit(0).cast("long").alias("score"))
    return reduce(DataFrame.unionByName, passes)


def _one_pass(spark: SparkSession, docs: DataFrame, wanted: DataFrame, k: int, owners: int) -> DataFrame | None:
    rows = wanted.toArrow()
    number = {t: i for i, t in enumerate(sorted(set(rows["term"].to_pylist())))}
    ids: dict = {}
    for item, term in zip(rows["item_id"].to_pylist(), rows["term"].to_pylist()):
        ids.setdefault(item, set()).add(number[term])
    names = sorted(ids, key=lambda i: (i is None, i))
    index = stored(term_index(docs, {t.encode(): i for t, i in number.items()}), "term_index")
    sums = {r["term"]: r for r in index.groupBy("term").agg(F.sum("seen").alias("seen"), F.sum("total").alias("total")).collect()}
    head = sums.pop(-1, None)
    if head is None or not sums:
        return None
    plan, owner = plan_of([ids[i] for i in names], {t: r["seen"] for t, r in sums.items()}, head["seen"], head["total"], owners)
    places = sorted({(t, part) for part, own in plan.parts.items() for _, terms, _ in own for ts in terms for t, _ in ts})
    owned = spark.createDataFrame(pa.table({
        "term": pa.array([t for t, _ in places], pa.int32()), "part": pa.array([p for _, p in places], pa.int32()),
        "owner": pa.array([owner[t] for t, _ in places], pa.int32())}))
    # At most a row per term of an item in this pass.
    postings = index.join(F.broadcast(owned), "term").select("shard", "part", "owner", "term", "docs", "times", "sizes")
    bundles = spark.createDataFrame([], "shard long, part int, item int, docs binary, scores binary")
    for s in range(owners):
        bundles = passed_on(bundles, postings.where(F.col("owner") == s).drop("owner"), plan, s, k)
    best = selected(bundles, index.where("term = -1").select("shard", "docs", "times"), k)
    order = Window.partitionBy("item").orderBy(F.desc("score"), F.col("doc_id").asc_nulls_last())
    ranked = best.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    named = spark.createDataFrame(pa.table({"item": pa.array(range(len(names)), pa.int32()), "item_id": pa.array(
        names, rows.schema.field("item_id").type)}))
    return ranked.join(F.broadcast(named), "item").select("item_id", "rank", "doc_id", "score")


def op11_ranked_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ranked_search(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


OP11_SQL = r"""
WITH d AS (SELECT row_number() OVER () AS place, doc_id, regexp_extract_all(translate(text,
         'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS w FROM documents),
     s AS (SELECT count(*) AS docs, sum(len(w))::BIGINT AS words FROM d WHERE len(w) > 0),
     p AS (SELECT place, doc_id, n, term, count(*) AS tf FROM (SELECT place, doc_id, len(w) AS n, unnest(w) AS term FROM d) GROUP BY ALL),
     f AS (SELECT term, count(*) AS df FROM p GROUP BY term),
     i AS (SELECT DISTINCT item_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
         'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM benchmark),
     r AS (SELECT item_id, place, doc_id, sum(floor(1000 * ln((2 * docs + 2)::DOUBLE / (2 * df + 1)))::BIGINT
         * ((1000000000 * tf) // (1000 * tf + 20 * (50 + (50 * n * docs) // words))))::BIGINT AS score
         FROM i JOIN f USING (term) JOIN p USING (term), s GROUP BY item_id, place, doc_id),
     o AS (SELECT item_id, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id NULLS LAST)::INTEGER AS rank, doc_id, score
         FROM r WHERE score > 0)
SELECT item_id, rank, doc_id, score FROM o WHERE rank <= 50
"""
