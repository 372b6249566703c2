"""Nearest precedent tickets of query vectors."""

from __future__ import annotations

import sys
from collections.abc import Iterator
from functools import reduce
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame, Window, functions as F

from werkbank.operators.stored import stored

# The scoring functions travel with the tasks, so executors need no copy of this package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

TOP_K = 5
CELLS, BLOCKS = 1, 1
#: Queries that go to the tasks together, chunks that are scored at once, and chunks that centres are fitted on.
BLOCK, STRIP, SAMPLE, ROUNDS = 4096, 1024, 4096, 8

_HITS = "query_id string, chunk_id long, ticket_id string, score double"


class Asked(NamedTuple):
    """A block of queries: their ids, unit vectors, and by what is asked for (sku and status, None for any) the places
    of those that ask for it."""

    ids: list[str]
    unit: np.ndarray
    kinds: list[tuple[str | None, str | None, np.ndarray]]


class Cells(NamedTuple):
    """Centres of the cells, and for each the greatest angle between it and a chunk of the cell."""

    centres: np.ndarray
    radius: np.ndarray


def _unit(matrix: np.ndarray) -> np.ndarray:
    norms = np.sqrt((matrix * matrix).sum(axis=1, keepdims=True))
    return matrix / np.where(norms == 0, 1.0, norms)


def _matrix(column: pa.Array) -> np.ndarray:
    """Vectors of one length as rows."""
    return np.array(column.to_pylist(), np.float64).reshape(len(column), -1)


def _nearest(unit: np.ndarray, centres: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The nearest centre of each vector and the angle to it."""
    scores = unit @ centres.T
    cell = scores.argmax(axis=1)
    return cell, np.arccos(np.clip(scores[np.arange(len(unit)), cell], -1, 1))


class _Best:
    """The ``k`` best chunks so far of each query of a block, by score and then id: never more than that is held."""

    def __init__(self, queries: int, k: int):
        self.k, self.border = k, np.full(queries, -np.inf)
        self.query, self.chunk = np.empty(0, np.int64), np.empty(0, np.int64)
        self.score, self.ticket = np.empty(0), np.empty(0, object)

    def add(self, at: np.ndarray, scores: np.ndarray, chunks: np.ndarray, tickets: np.ndarray) -> None:
        border = self.border[at]
        if scores.shape[1] > self.k:
            border = np.maximum(border, np.partition(scores, -self.k, axis=1)[:, -self.k])
        row, column = np.nonzero(scores >= border[:, None])
        if not len(row):
            return
        query = np.concatenate([self.query, at[row]])
        chunk = np.concatenate([self.chunk, chunks[column]])
        score = np.concatenate([self.score, scores[row, column]])
        ticket = np.concatenate([self.ticket, tickets[column]])
        order = np.lexsort((chunk, -score, query))
        query = query[order]
        place = np.arange(len(query)) - np.searchsorted(query, query)
        keep = order[place < self.k]
        self.query, self.chunk, self.score, self.ticket = query[place < self.k], chunk[keep], score[keep], ticket[keep]
        full = place[place < self.k] == self.k - 1
        self.border[self.query[full]] = self.score[full]


def _scan(chunks: DataFrame, asked: Asked, cells: Cells | None, k: int) -> DataFrame:
    """The ``k`` best chunks per query of each task's chunks. A strip of chunks of one cell is scored only for queries
    whose angle to its centre, less the cell's radius, can still beat what they have."""
    angle = None if cells is None else np.arccos(np.clip(asked.unit @ cells.centres.T, -1, 1))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best = _Best(len(asked.ids), k)
        for batch in batches:
            unit = _unit(_matrix(batch.column(4))) if batch.num_rows else np.empty((0, 0))
            ids, tickets = batch.column(0).to_numpy(), np.array(batch.column(1).to_pylist(), object)
            sku, status = (np.array(batch.column(i).to_pylist(), object) for i in (2, 3))
            cell = batch.column(5).to_numpy()
            for start in range(0, batch.num_rows, STRIP):
                for c in np.unique(cell[start:start + STRIP]).tolist():
                    strip = start + np.flatnonzero(cell[start:start + STRIP] == c)
                    for wanted_sku, wanted_status, at in asked.kinds:
                        if angle is not None:
                            reach = np.cos(np.maximum(angle[at, c] - cells.radius[c], 0))
                            at = at[reach + 1e-9 >= best.border[at]]
                        rows = strip
                        if wanted_sku is not None:
                            rows = rows[sku[rows] == wanted_sku]
                        if wanted_status is not None:
                            rows = rows[status[rows] == wanted_status]
                        if len(at) and len(rows):
                            best.add(at, asked.unit[at] @ unit[rows].T, ids[rows], tickets[rows])
        if len(best.query):
            yield pa.RecordBatch.from_arrays([
                pa.array([asked.ids[q] for q in best.query.tolist()], pa.string()), pa.array(best.chunk, pa.int64()),
                pa.array(best.ticket.tolist(), pa.string()), pa.array(best.score, pa.float64())],
                ["query_id", "chunk_id", "ticket_id", "score"])

    return chunks.select("chunk_id", "ticket_id", "product_sku", "status", "vector", "cell").mapInArrow(run, _HITS)


def cell_index(chunks: DataFrame, cells: int) -> tuple[DataFrame, Cells | None]:
    """Chunks with the ``cell`` that each lies in, stored in the order of cells within each task (no vector is
    shuffled), and the centres and radii. Centres are fitted on at most ``SAMPLE`` chunks, those of smallest hash."""
    drawn = chunks.orderBy(F.xxhash64("chunk_id"), "chunk_id").select("vector").limit(SAMPLE).toArrow()
    if not drawn.num_rows:
        return chunks.withColumn("cell", F.lit(0)), None
    unit = _unit(_matrix(drawn["vector"].combine_chunks()))
    centres = unit[:cells]
    for _ in range(ROUNDS):
        cell, _ = _nearest(unit, centres)
        centres = _unit(np.stack([unit[cell == c].sum(axis=0) if (cell == c).any() else centres[c] for c in range(len(centres))]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            cell, angle = _nearest(_unit(_matrix(batch.column(4))), centres) if batch.num_rows else (np.empty(0), np.empty(0))
            yield pa.RecordBatch.from_arrays([*(batch.column(i) for i in range(5)), pa.array(cell.astype(np.int32)), pa.array(
                angle, pa.float64())], ["chunk_id", "ticket_id", "product_sku", "status", "vector", "cell", "angle"])

    fields = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in chunks.schema.fields)
    placed = stored(chunks.mapInArrow(run, f"{fields}, cell int, angle double").sortWithinPartitions("cell"), "cells")
    radius = np.zeros(len(centres))
    for row in placed.groupBy("cell").agg(F.max("angle").alias("radius")).collect():  # a row per cell
        radius[row["cell"]] = row["radius"]
    return placed, Cells(centres, radius)


def _asked(queries: DataFrame, block: int, blocks: int) -> Asked | None:
    """The queries of a block, about ``BLOCK`` of them."""
    rows = queries.filter(F.pmod(F.xxhash64("query_id"), F.lit(blocks)) == block).drop("ticket_id").toArrow()
    if not rows.num_rows:
        return None
    kinds: dict[tuple, list[int]] = {}
    for i, kind in enumerate(zip(rows["product_sku"].to_pylist(), rows["status"].to_pylist())):
        kinds.setdefault(kind, []).append(i)
    return Asked(rows["query_id"].to_pylist(), _unit(_matrix(rows["vector"].combine_chunks())),
                 [(*kind, np.array(at)) for kind, at in kinds.items()])


def precedents(queries: DataFrame, chunks: DataFrame, k: int = TOP_K, cells: int = CELLS,
               blocks: int = BLOCKS) -> DataFrame:
    """The ``k`` nearest precedents by cosine of each query, the asking ticket itself removed
    afterwards, so that fewer than ``k`` may remain.

    ``queries`` has ``query_id, ticket_id, product_sku, status, vector``; a NULL sku or status
    does not filter. ``chunks`` has a unique ``chunk_id``. The search is exact, and chunk vectors stay where they are
    read: queries go to the tasks in blocks of about ``BLOCK`` (at least ``blocks`` of them), each task keeps the ``k``
    best of its chunks per query and hands on only those, and they are merged by query. With ``cells`` above 1
    the chunks are stored by cell first, and cells that no query can gain from are passed over.
    A task holds one block and one batch of chunks, whatever the size of either table.
    """
    payload = ["product_sku", "status"]
    # New columns, as queries may come from the chunks themselves.
    asked = stored(queries.filter("vector IS NOT NULL").select(F.col("query_id").cast("string").alias("query_id"), "ticket_id", *[
        F.col(c).cast("string").alias(c) for c in payload], "vector"), "queries")
    held = chunks.filter("vector IS NOT NULL").select(F.col("chunk_id").cast("bigint").alias("chunk_id"), F.col(
        "ticket_id").cast("string").alias("ticket_id"), *[F.col(c).cast("string").alias(c) for c in payload], "vector")
    held, known = cell_index(held, cells) if cells > 1 else (held.withColumn("cell", F.lit(0)), None)
    blocks = max(blocks, -(-asked.count() // BLOCK))
    parts = [_scan(held, a, known, k) for a in (_asked(asked, b, blocks) for b in range(blocks)) if a is not None]
    found = reduce(DataFrame.unionByName, parts) if parts else asked.sparkSession.createDataFrame([], _HITS)
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), "chunk_id")
    top = found.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= k)
    own = asked.select("query_id", F.col("ticket_id").alias("_own"))
    return (top.join(own, "query_id").filter(~F.col("ticket_id").eqNullSafe(F.col("_own"))).drop("_own"))


def precedent_payload(found: DataFrame, chunks: DataFrame) -> DataFrame:
    """Problem and resolution text of the found precedents, joined last and for the hits
    alone."""
    return found.join(chunks.select("chunk_id", "problem_text", "linked_resolution"), "chunk_id")
