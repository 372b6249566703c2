"""SimHash near-dedup: fingerprints of word shingles, joined by a walk over pairs of binary tries."""

from __future__ import annotations

import sys
from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from werkbank.llm.common import connected_components, stored, table

# The functions below travel with the tasks, so executors need no copy of this package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

BITS = 64
LANES = np.uint64(0x0101010101010101)
#: Fingerprints of one block value that are compared in one piece; more are dealt to pairs of pieces.
PIECE = 1024
#: Node pairs walked at once, and rows gathered before a walk.
PAIRS, ROWS = 500_000, 60_000


def shingle_hashes(text: bytes | None, size: int, seed: int) -> np.ndarray:
    """XXH64 of every run of ``size`` words (A-Z lowered, joined by a space), repeats included; of the
    whole sequence where there are fewer words, of nothing where there is none."""
    words = (text or b"").lower().split()
    if not words:
        return np.empty(0, np.uint64)
    line, n = b" ".join(words), max(0, len(words) - size) + 1
    lengths = np.fromiter(map(len, words), np.int64, len(words))
    ends = np.cumsum(lengths + 1) - 1
    starts = (ends - lengths)[:n].tolist()
    runs = map(line.__getitem__, map(slice, starts, ends[-n:].tolist()))
    return np.fromiter(map(xxhash.xxh64_intdigest, runs, repeat(seed)), np.uint64, n)


def majority(hashes: np.ndarray) -> int:
    """The bits set in more than half of the hashes. Eight bits of each hash are summed at a time,
    in the eight bytes of one number, over runs of 255 so that no byte overflows."""
    runs = np.zeros((-(-len(hashes) // 255) or 1) * 255, np.uint64)
    runs[:len(hashes)] = hashes
    runs, out = runs.reshape(-1, 255), 0
    for bit in range(8):
        sums = ((runs >> np.uint64(bit)) & LANES).sum(axis=1, dtype=np.uint64).astype("<u8")
        counts = sums.view(np.uint8).reshape(-1, 8).sum(axis=0, dtype=np.int64)
        for byte in np.flatnonzero(2 * counts > len(hashes)).tolist():
            out |= 1 << (8 * byte + bit)
    return out


def fingerprints(docs: DataFrame, shingle: int = 3, seed: int = 42) -> DataFrame:
    """``doc_id``, ``mark`` (a hash of the text) and ``fingerprint`` (64 bits as a signed long) of every row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = np.array([majority(shingle_hashes(x.as_py(), shingle, seed)) for x in batch.column(2)], np.uint64)
            yield pa.record_batch([batch.column(0), batch.column(1), pa.array(found.view(np.int64))],
                                  ["doc_id", "mark", "fingerprint"])

    thin = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("mark"),
                       F.col("text").cast("binary").alias("text"))
    return thin.mapInArrow(run, "doc_id long, mark long, fingerprint long")


def trie_pairs(groups: np.ndarray, values: np.ndarray, distance: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Positions of all pairs of one group whose values differ in at most ``distance`` bits, in parts.
    ``groups`` ascends and ``values`` ascend in a group, so a trie node is a range of positions.

    Pairs of nodes go down together, bit by bit; each carries the number of bits in which its
    prefixes differ and is dropped beyond the budget. Pairs of leaves are finished by their last
    bits. Whatever has more pairs than ``PAIRS`` waits on a stack, so memory stays bounded."""
    starts = np.flatnonzero(np.r_[True, groups[1:] != groups[:-1]])
    ends = np.r_[starts[1:], len(groups)]
    root = np.stack([starts, ends, starts, ends, np.zeros_like(starts)])[:, ends - starts > 1]
    stack = [(BITS - 1, root)]
    while stack:
        bit, nodes = stack.pop()
        if nodes.shape[1] > PAIRS:
            stack += [(bit, nodes[:, i:i + PAIRS]) for i in range(0, nodes.shape[1], PAIRS)]
            continue
        leaf = (nodes[1] - nodes[0] == 1) & (nodes[3] - nodes[2] == 1)
        if leaf.any():
            a, b = nodes[0, leaf], nodes[2, leaf]
            near = np.bitwise_count(values[a] ^ values[b]) <= distance
            yield a[near], b[near]
            nodes = nodes[:, ~leaf]
        if not nodes.shape[1]:
            continue
        ones = np.r_[0, np.cumsum((values >> np.uint64(bit)) & np.uint64(1), dtype=np.int64)]
        lo, hi, low, high, spent = nodes
        cut, cut2 = hi - (ones[hi] - ones[lo]), high - (ones[high] - ones[low])
        same = lo == low
        below = np.concatenate([
            np.stack([lo, cut, low, cut2, spent]), np.stack([cut, hi, cut2, high, spent]),
            np.stack([lo, cut, cut2, high, spent + 1]),
            np.stack([cut, hi, low, cut2, spent + 1])[:, ~same]], axis=1)
        lo, hi, low, high, spent = below
        alive = (hi > lo) & (high > low) & (spent <= distance) & ~((lo == low) & (hi - lo == 1))
        stack.append((bit - 1, below[:, alive]))


def forest(n: int, pairs: Iterator[tuple[np.ndarray, np.ndarray]]) -> np.ndarray:
    """For each of ``n`` positions the smallest position that the pairs connect it with."""
    root = np.arange(n)
    for a, b in pairs:
        while True:
            x, y = root[a], root[b]
            apart = x != y
            if not apart.any():
                break
            np.minimum.at(root, np.maximum(x, y)[apart], np.minimum(x, y)[apart])
            while not np.array_equal(root, up := root[root]):
                root = up
    return root


def near_links(values: DataFrame, distance: int = 3) -> DataFrame:
    """Edges ``a``, ``b`` that connect all distinct values of the column ``fingerprint`` which lie
    within ``distance`` bits, directly or over others.

    Two such values agree in one of ``distance + 1`` blocks of bits, so every value goes to one group
    per block, and each group is a trie joined with itself. A group of more than ``PIECE`` values is
    dealt to pairs of pieces. Groups are walked together, many at a time, and give a spanning
    forest each instead of all their pairs."""
    blocks = distance + 1
    width = [BITS * (i + 1) // blocks - BITS * i // blocks for i in range(blocks)]
    keys = F.array(*[F.struct(F.lit(i).alias("block"), F.shiftrightunsigned("fingerprint", BITS * i // blocks)
                              .bitwiseAND((1 << w) - 1).alias("value")) for i, w in enumerate(width)])
    rows = values.select("fingerprint", F.inline(keys))
    hot = (rows.groupBy("block", "value").count().where(F.col("count") > PIECE)
           .select("block", "value", F.ceil(F.col("count") / (PIECE / 2)).alias("pieces")))
    rows = rows.join(hot, ["block", "value"], "left")
    own = F.pmod(F.xxhash64("fingerprint"), F.col("pieces"))
    others = F.filter(F.sequence(F.lit(0).cast("long"), F.col("pieces") - 1), lambda x: x != own)
    rows = rows.select("block", "value", "fingerprint", F.explode(F.when(F.col("pieces").isNull(), F.array(
        F.struct(F.lit(0).cast("long").alias("i"), F.lit(0).cast("long").alias("j")))).otherwise(F.transform(
            others, lambda x: F.struct(F.least(x, own).alias("i"), F.greatest(x, own).alias("j"))))).alias("p"))
    rows = rows.select(F.xxhash64("block", "value", "p.i", "p.j").alias("key"), "fingerprint")

    def walk(keys: np.ndarray, prints: np.ndarray) -> pa.RecordBatch:
        order = np.lexsort((prints, keys))
        keys, prints = keys[order], prints[order]
        root = forest(len(keys), trie_pairs(keys, prints, distance))
        linked = np.flatnonzero(root != np.arange(len(keys)))
        both = np.unique(np.stack([prints[linked], prints[root[linked]]]).view(np.int64), axis=1)
        return pa.record_batch([pa.array(both[0]), pa.array(both[1])], ["a", "b"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, prints = np.empty(0, np.int64), np.empty(0, np.uint64)
        for batch in batches:
            keys = np.r_[keys, batch.column(0).to_numpy()]
            prints = np.r_[prints, batch.column(1).to_numpy().view(np.uint64)]
            if len(keys) >= ROWS:
                whole = int(np.searchsorted(keys, keys[-1]))  # the last group may go on
                yield walk(keys[:whole], prints[:whole])
                keys, prints = keys[whole:], prints[whole:]
        if len(keys):
            yield walk(keys, prints)

    return (rows.repartition("key").sortWithinPartitions("key").mapInArrow(run, "a long, b long").distinct())


def labelled(prints: DataFrame, distance: int) -> DataFrame:
    """``prints`` (distinct values of ``fingerprint``) with ``label``, the smallest fingerprint of the component."""
    groups = connected_components(near_links(prints.select("fingerprint"), distance))
    found = prints.join(groups, prints["fingerprint"] == groups["node"], "left")
    return found.withColumn("label", F.coalesce("component", "fingerprint")).drop("node", "component")


def simhash_components(docs: DataFrame, shingle: int = 3, distance: int = 3, seed: int = 42) -> DataFrame:
    """``doc_id``, ``mark`` (a hash of the text), ``fingerprint`` (16 lowercase hex digits) and ``component_id``:
    the smallest doc_id reachable over fingerprints that differ in at most ``distance`` bits, itself included.

    Null text counts as empty; documents without words have fingerprint 0 and link like any other.
    Repeated rows stay, one result row each. A row without a doc_id is linked like any other, but
    names a component (as null) only where none of its rows has an id. Very long texts are read whole. Other columns
    are ignored; an empty table gives an empty result."""
    prints = stored(fingerprints(docs, shingle, seed), "simhash")
    values = labelled(prints.groupBy("fingerprint").agg(F.min("doc_id").alias("first")), distance)
    smallest = values.groupBy("label").agg(F.min("first").alias("component_id"))
    named = values.join(smallest, "label").select("fingerprint", "component_id")
    return prints.join(named, "fingerprint").select(
        "doc_id", "mark", F.lpad(F.lower(F.hex("fingerprint")), 16, "0").alias("fingerprint"), "component_id")


def simhash_dedup(docs: DataFrame, shingle: int = 3, distance: int = 3, seed: int = 42) -> DataFrame:
    """One row of each component, columns unchanged: that of smallest doc_id (rows without one come last), among
    rows of one id that whose text has the smallest hash, of equal rows any one.

    Null and empty texts are one component (fingerprint 0); very long texts are read whole, their shingles one after the
    other; other columns may have any name; an empty table gives an empty result."""
    prints = stored(fingerprints(docs, shingle, seed), "simhash")
    row = lambda mark: [F.col("doc_id").isNull().alias("_none"), F.coalesce(
        F.col("doc_id").cast("long"), F.lit(0)).alias("_id"), mark.alias("_mark")]
    firsts = prints.groupBy("fingerprint").agg(F.min(F.struct(*row(F.col("mark")))).alias("row"))
    kept = labelled(firsts, distance).groupBy("label").agg(F.min("row").alias("row")).select("row.*")
    key = ["_none", "_id", "_mark"]
    # Copies go in each task before rows are dealt, so that those of one row need not meet.
    copy = F.row_number().over(Window.partitionBy(*key).orderBy("_mark"))
    packed = F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row")
    rows = docs.select(packed, *row(F.xxhash64("text"))).withColumn("_copy", copy).where("_copy = 1")
    return rows.join(kept, key, "left_semi").select("row.*")


def op6_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash_components(table(spark, sf_dir, "documents")).drop("mark")
