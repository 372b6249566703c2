"""Embedding near-dedup: cells of a spherical k-means, compared block by block."""

from __future__ import annotations

import math
import sys
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession, functions as F

from werkbank.llm.common import connected_components, stored, table

cloudpickle.register_pickle_by_value(sys.modules[__name__])

#: Vectors that the cells are fitted on, cells at most, rounds of k-means, rows of a block.
SAMPLE, CELLS, ROUNDS, BLOCK = 16_384, 1024, 10, 1024
#: How far, as a share of the distance between two linked vectors, a vector looks beyond its cell's border: less than 1
#: loses links.
REACH = 1.0
#: What rounding may take from a likeness or an angle.
SLACK, TURN = 1e-9, 1e-6


def unit(vectors: np.ndarray) -> np.ndarray:
    return vectors / np.linalg.norm(vectors, axis=1, keepdims=True)


def spherical_kmeans(sample: np.ndarray, cells: int, rounds: int = ROUNDS, seed: int = 0) -> np.ndarray:
    """Unit centres: each vector joins the centre of largest cosine, each centre turns to its vectors' sum. A centre
    without vectors moves to the vector that fits its own centre worst."""
    centres = sample[np.sort(np.random.default_rng(seed).choice(len(sample), min(cells, len(sample)), replace=False))]
    for _ in range(rounds):
        likeness = sample @ centres.T
        own, best = likeness.argmax(axis=1), likeness.max(axis=1)
        sums = np.zeros_like(centres)
        np.add.at(sums, own, sample)
        empty = np.flatnonzero(np.linalg.norm(sums, axis=1) == 0)
        sums[empty] = sample[np.argsort(best, kind="stable")[:len(empty)]]
        centres = unit(sums)
    return centres


def radii(vectors: np.ndarray, centres: np.ndarray) -> np.ndarray:
    """The largest angle between each centre and the vectors at home with it (-1 where there is none). Where
    rounding may decide about the home, each of the cells counts the vector."""
    likeness = vectors @ centres.T
    row, cell = np.nonzero(likeness >= likeness.max(axis=1, keepdims=True) - SLACK)
    out = np.full(len(centres), -1.0)
    np.maximum.at(out, cell, np.arccos(np.clip(likeness[row, cell], -1, 1)))
    return out


def visited(vectors: np.ndarray, centres: np.ndarray, cosine: float, reach: float,
            wide: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Row, cell and home cell of every visit. A vector visits its home and each cell of lower number whose
    border is nearer than ``reach`` times the greatest distance of linked vectors and whose centre is no farther
    than its radius (``wide``) and the greatest angle of linked vectors; with ``reach`` 1 each linked pair
    meets for certain in the lower of its two homes."""
    likeness = vectors @ centres.T
    home = likeness.argmax(axis=1)
    apart = np.sqrt(np.maximum(0, 2 - 2 * centres @ centres.T))
    gap = likeness[np.arange(len(vectors)), home][:, None] - likeness
    near = gap <= reach * math.sqrt(2 - 2 * cosine) * apart[home] + SLACK
    near &= np.arange(len(centres)) < home[:, None]
    near &= (wide >= 0) & (likeness >= np.cos(np.minimum(wide + math.acos(cosine) + TURN, math.pi)) - SLACK)
    near[np.arange(len(vectors)), home] = True
    row, cell = np.nonzero(near)
    return row, cell, home[row]


def embedding_links(vectors: DataFrame, cosine: float = 0.95, reach: float = REACH, seed: int = 0) -> tuple[DataFrame, DataFrame]:
    """From ``node`` and ``vector`` (distinct, valid, of one length): links counted per node and cell (``node``, ``other`` copies
    told by ``copies``), and edges that connect what is linked.

    Cells of about ``BLOCK`` vectors are fitted on at most ``SAMPLE`` vectors, those of smallest hash, and every
    vector is dealt to cells.
    The vectors at home in a cell are compared with each other and with its visitors. Both are cut into
    pieces of about ``BLOCK``, and two pieces are one group: nothing grows with the size of a cell but the
    number of groups."""
    sample = vectors.orderBy(F.xxhash64("vector", F.lit(seed)), "node").limit(SAMPLE).select("vector").toPandas()
    if not len(sample):
        empty = vectors.select("node", F.lit(0).cast("long").alias("links")).limit(0)
        return empty, vectors.select(F.col("node").alias("a"), F.col("node").alias("b")).limit(0)
    n = vectors.count()
    centres = spherical_kmeans(unit(np.stack(sample["vector"].to_numpy()).astype(np.float64)),
                               max(1, min(CELLS, math.ceil(n / BLOCK))), seed=seed)

    def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        wide = np.full(len(centres), -1.0)
        for batch in batches:
            for at in range(0, batch.num_rows, 1024):
                x = np.stack(batch.slice(at, 1024).column(0).to_numpy(zero_copy_only=False)).astype(np.float64)
                wide = np.maximum(wide, radii(unit(x), centres))
        yield pa.record_batch([pa.array(np.arange(len(centres), dtype=np.int32)), pa.array(wide)], ["cell", "wide"])

    widest = vectors.select("vector").mapInArrow(spread, "cell int, wide double").groupBy("cell").agg(F.max("wide"))
    wide = np.full(len(centres), -1.0)
    for cell, angle in widest.collect():
        wide[cell] = angle

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 1024):
                part = batch.slice(at, 1024)
                x = unit(np.stack(part.column(2).to_numpy(zero_copy_only=False)).astype(np.float64))
                row, cell, home = visited(x, centres, cosine, reach, wide)
                yield pa.record_batch([pa.array(cell.astype(np.int32)), pa.array(home.astype(np.int32)),
                                       part.column(0).take(row), part.column(1).take(row), part.column(2).take(row)],
                                      ["cell", "home", "node", "copies", "vector"])

    kind = dict(vectors.dtypes)["vector"]
    visits = vectors.select("node", "copies", "vector").mapInArrow(
        deal, f"cell int, home int, node long, copies long, vector {kind}")
    visits = visits.withColumn("here", F.col("home") == F.col("cell"))
    cut = lambda c: F.ceil(F.count_if(c) / BLOCK).cast("int")
    pieces = visits.groupBy("cell").agg(cut(F.col("here")).alias("homes"), cut(~F.col("here")).alias("others"))
    own = F.pmod(F.xxhash64("node"), F.when(F.col("here"), F.col("homes")).otherwise(F.col("others"))).cast("int")
    numbers = lambda n: F.filter(F.sequence(F.lit(0), F.col(n)), lambda x: x < F.col(n))
    group = lambda visit, i, j: F.struct(F.lit(visit).alias("visit"), i.alias("i"), j.alias("j"))
    groups = F.when(F.col("here"), F.concat(
        F.transform(numbers("homes"), lambda x: group(False, F.least(x, own), F.greatest(x, own))),
        F.transform(numbers("others"), lambda x: group(True, own, x)))).otherwise(
        F.transform(numbers("homes"), lambda x: group(True, x, own)))
    dealt = visits.join(pieces, "cell").select("cell", "here", "node", "copies", "vector", own.alias("piece"),
                                               F.explode(groups).alias("pair"))

    def compare(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        _, visit, i, j = key
        rows = rows.sort_values("node", kind="stable")
        node, copies = rows["node"].to_numpy(), rows["copies"].to_numpy()
        x = unit(np.stack(rows["vector"].to_numpy()).astype(np.float64))
        piece, here = rows["piece"].to_numpy(), rows["here"].to_numpy(bool)
        a, b = np.flatnonzero(here & (piece == i)), np.flatnonzero((here != visit) & (piece == j))
        linked = x[a] @ x[b].T >= cosine
        same = not visit and i == j
        if same:
            np.fill_diagonal(linked, False)
        count = np.zeros(len(node), np.int64)
        count[a] += linked @ copies[b]
        if not same:
            count[b] += copies[a] @ linked
        root = np.arange(len(node))
        while True:  # the smallest place that each place is connected with
            low = root.copy()
            low[a] = np.minimum(low[a], np.where(linked, root[b][None], len(node)).min(axis=1, initial=len(node)))
            low[b] = np.minimum(low[b], np.where(linked, root[a][:, None], len(node)).min(axis=0, initial=len(node)))
            low = low[low]
            if np.array_equal(low, root):
                break
            root = low
        some = np.flatnonzero(count)
        return pd.DataFrame({"node": node[some], "links": count[some], "root": node[root[some]]})

    found = stored(dealt.groupBy("cell", "pair.visit", "pair.i", "pair.j").applyInPandas(compare, "node long, links long, root long"), "links")
    links = found.groupBy("node").agg(F.sum("links").alias("links"))
    return links, found.where("node <> root").select(F.col("node").alias("a"), F.col("root").alias("b")).distinct()


def embedding_components(rows: DataFrame, cosine: float = 0.95, reach: float = REACH, seed: int = 0) -> DataFrame:
    """Per row ``vec_id``, ``n_links`` (other vectors at a cosine of at least ``cosine``), ``component_id`` (smallest
    vec_id reachable over links) and ``kept`` (whether the row names its component).

    Equal vectors are compared once and counted with their copies. Vectors that are null, empty, zero or hold null
    or non-finite components link with nothing, not even with their copies. Rows without an id are linked like others
    and never name a component, unless none of its rows has an id (then it is null and none is kept). Vectors
    of different lengths never link; each length is a search of its own. Other columns are ignored; an empty table gives
    an empty result."""
    rows = rows.select("vec_id", F.col("embedding").alias("vector"))
    valid = (F.col("vector").isNotNull() & ~F.exists("vector", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
             & F.exists("vector", lambda x: x != 0))
    rows = rows.withColumn("valid", F.coalesce(valid, F.lit(False)))
    # Two hashes of a vector, 128 bits, tell it from others; a number of its own names it from then on.
    rows = rows.withColumn("hash", F.when(F.col("valid"), F.struct(F.xxhash64("vector").alias("x"), F.xxhash64(
        F.reverse("vector"), F.lit(1)).alias("y"))))
    nodes = stored(rows.where("valid").groupBy("hash.x", "hash.y").agg(
        F.min("vec_id").alias("first"), F.count("*").alias("copies"), F.first("vector").alias("vector")).withColumn(
        "node", F.monotonically_increasing_id()), "vectors")
    # Vectors of different lengths are never linked, so each length is a search of its own.
    lengths = sorted(r[0] for r in nodes.select(F.size("vector")).distinct().collect()) or [0]
    found = [embedding_links(nodes.where(F.size("vector") == n).select("node", "copies", "vector"), cosine, reach, seed) for n in lengths]
    links, edges = (reduce(DataFrame.unionByName, parts) for parts in zip(*found))
    groups = connected_components(edges)
    told = (nodes.select("x", "y", "node", "first", "copies").join(links, "node", "left")
            .join(groups, "node", "left").withColumn("label", F.coalesce("component", "node")))
    smallest = told.groupBy("label").agg(F.min("first").alias("component_id"))
    told = told.join(smallest, "label").select("x", "y", (F.coalesce("links", F.lit(0)) + F.col("copies") - 1)
                                               .alias("n_links"), "component_id")
    rows = rows.select("vec_id", "valid", "hash.x", "hash.y")
    out = rows.join(told, ["x", "y"], "left")
    return out.select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), F.when(
        F.col("valid"), F.col("component_id")).otherwise(F.col("vec_id")).alias("component_id")).withColumn(
        "kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(False)))


def op3_embeddings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embedding_components(table(spark, sf_dir, "embeddings"))


OP3_SQL = """
WITH RECURSIVE v AS (SELECT vec_id, embedding::DOUBLE[] AS e FROM embeddings WHERE embedding IS NOT NULL
         AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0
         AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
     l AS (SELECT a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b ON a.vec_id <> b.vec_id AND len(a.e) = len(b.e)
         WHERE list_cosine_similarity(a.e, b.e) >= 0.95),
     r AS (SELECT a, b FROM l UNION SELECT r.a, l.b FROM r JOIN l ON l.a = r.b),
     n AS (SELECT a, count(*) AS links FROM l GROUP BY a),
     s AS (SELECT a, min(b) AS least FROM r GROUP BY a)
SELECT vec_id, coalesce(links, 0)::BIGINT AS n_links, least(vec_id, coalesce(s.least, vec_id)) AS component_id,
    vec_id = least(vec_id, coalesce(s.least, vec_id)) AS kept
FROM embeddings LEFT JOIN n ON n.a = vec_id LEFT JOIN s ON s.a = vec_id
"""
