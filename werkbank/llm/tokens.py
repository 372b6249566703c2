"""Token-ID output: documents as ids of a public tokenizer, stored in Simple-8b words.

The files are Parquet tables that Spark writes and commits, one row per chunk of whole documents:
``shard`` and ``first`` (ids of the shard before the chunk), ``doc_ids`` and ``n_tokens`` (what it
holds), ``words``, ``starts`` (the first word of each block) and ``escapes`` as little-endian numbers."""

from __future__ import annotations

import os
import re
import sys
import types
from array import array
from collections.abc import Iterator
from itertools import accumulate, chain

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext, cloudpickle
from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from werkbank.llm import simple8b
from werkbank.llm.common import id_or_last, scratch, table

cloudpickle.register_pickle_by_value(sys.modules[__name__])

#: Ids that a chunk gathers before it is closed; a longer document makes a longer chunk.
CHUNK = 1 << 18
#: Characters of text encoded at once, and pieces whose ids a Python worker remembers.
CHARS, REMEMBERED = 1 << 21, 900_000
FORMAT = ("shard int, first bigint, doc_ids array<bigint>, n_tokens array<bigint>, words binary, starts binary, "
          "escapes binary")
#: A word with the white space that the tokenizer's own splitting leaves with it, or other white space.
PIECES = re.compile(r" ?\S+|\s+(?!\S)|\s+")
#: White space for Python only, the zero that the dictionary of pieces would end at, and what special tokens begin
#: with: such texts are encoded whole.
ODD = ("\0", "\x1c", "\x1d", "\x1e", "\x1f", "<|")


def remembered(kind: str) -> dict:
    """A dictionary that stays with the Python worker from task to task. Code that travels by value
    has fresh globals in each task, so it lives in a module of its own."""
    module = sys.modules.setdefault("werkbank_worker_memory", types.ModuleType("werkbank_worker_memory"))
    return module.__dict__.setdefault(kind, {})


def tokenizer(path: str):
    from tokenizers import Tokenizer

    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    loaded = remembered("tokenizers")
    if path not in loaded:
        loaded[path] = Tokenizer.from_file(path)
    return loaded[path]


def _keys(text: str) -> list[str]:
    """The pieces of a text. A word stands for itself with a space before it; after a line end, at the start
    of the text, and for pieces cut by ``PIECES``, a sign tells so that no word begins with."""
    words = text.split()
    if " ".join(words) != text.replace("\n", " "):
        return ["\v" + p for p in PIECES.findall(text)]
    if words:
        for k in accumulate(line.count(" ") + 1 for line in text.split("\n")[:-1]):
            words[k] = "\n" + words[k]
        words[0] = "\t" + words[0]
    return words


def _spelled(key: str) -> str:
    return key[1:] if key[0] in "\t\v" else key if key[0] == "\n" else " " + key


def encoded(texts: list[str], path: str) -> tuple[np.ndarray, np.ndarray]:
    """The ids of the texts, one after the other, and how many each text has.

    The tokenizer cuts at white space before it merges, so the ids of a text are those of its pieces in order.
    The different pieces of all texts are looked up, or encoded by the library, once, and put in place together."""
    model, known = tokenizer(path), remembered(f"ids of {path}")
    whole = {i for i, t in enumerate(texts) if any(odd in t for odd in ODD)}
    pieces = [[f"\r{i}"] if i in whole else _keys(t) for i, t in enumerate(texts)]
    place, names = pd.factorize(np.fromiter(chain.from_iterable(pieces), object))
    ids = list(map(known.get, names))
    new = [k for k, x in enumerate(ids) if x is None]
    for k, code in zip(new, model.encode_batch_fast(
            [texts[int(names[k][1:])] if names[k][0] == "\r" else _spelled(names[k]) for k in new], add_special_tokens=False)):
        ids[k] = array("I", code.ids).tobytes()
    if len(known) + len(new) > REMEMBERED:
        known.clear()
    known.update((names[k], ids[k]) for k in new if names[k][0] != "\r")
    sizes = np.fromiter(map(len, ids), np.int64, len(ids)) // 4
    starts = np.cumsum(sizes) - sizes
    counts = sizes[place]
    ends = np.cumsum(counts)
    source = np.arange(int(counts.sum())) + np.repeat(starts[place] - (ends - counts), counts)
    per_text = np.r_[0, ends][np.cumsum([0, *map(len, pieces)])]
    return np.frombuffer(b"".join(ids), "<u4")[source], np.diff(per_text)


def _some(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[list, list[str]]]:
    """Ids and texts, about ``CHARS`` characters at a time."""
    names, texts, size = [], [], 0
    for batch in batches:
        for doc_id, text in zip(batch.column(0), batch.column(1)):
            names.append(doc_id.as_py())
            texts.append((text.as_py() or b"").decode("utf-8", "replace"))
            size += len(texts[-1])
            if size >= CHARS:
                yield names, texts
                names, texts, size = [], [], 0
    if names:
        yield names, texts


def write_tokens(docs: DataFrame, path: str, tokenizer_path: str, end_id: int = 0) -> None:
    """Write the ids of all documents, each with ``end_id`` behind it, in ascending doc_id order.

    Null text is empty. Rows without a doc_id come last; rows of one id (or none) are ordered by the
    hash of their text, and each row is written. An empty table gives an empty file. Documents are
    dealt to shards by ranges of (doc_id, hash), so neither one id nor missing ids fill a shard."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard, first, ids, counts, parts, size = TaskContext.get().partitionId(), 0, [], [], [], 0

        def close() -> pa.RecordBatch:
            words, starts, escapes = simple8b.encode(np.concatenate(parts))
            row = {"shard": shard, "first": first, "doc_ids": ids, "n_tokens": counts,
                   "words": words.astype("<u8").tobytes(), "starts": starts.astype("<u4").tobytes(),
                   "escapes": escapes.astype("<u8").tobytes()}
            return pa.RecordBatch.from_pylist([row], schema)

        for names, texts in _some(batches):
            codes, lengths = encoded(texts, tokenizer_path)
            ends = np.cumsum(lengths)
            for doc_id, n, at in zip(names, lengths.tolist(), ends.tolist()):
                ids.append(doc_id)
                counts.append(n + 1)
                parts += [codes[at - n:at], end]
                size += n + 1
                if size >= CHUNK:
                    yield close()
                    first, ids, counts, parts, size = first + size, [], [], [], 0
        if ids:
            yield close()

    end = np.array([end_id], "<u4")
    longs = pa.list_(pa.int64())
    schema = pa.schema([("shard", pa.int32()), ("first", pa.int64()), ("doc_ids", longs), ("n_tokens", longs),
                        ("words", pa.binary()), ("starts", pa.binary()), ("escapes", pa.binary())])
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("binary").alias("text"),
                       id_or_last().alias("_id"), F.col("doc_id").isNull().alias("_none"),
                       F.xxhash64("text").alias("_hash"))
    keys = ["_id", "_none", "_hash"]
    dealt = rows.repartitionByRange(*keys).sortWithinPartitions(*keys).select("doc_id", "text")
    dealt.mapInArrow(run, FORMAT).write.parquet(path)


def read_tokens(spark: SparkSession, path: str) -> DataFrame:
    """``doc_id``, ``start`` (ids of all documents before it), ``n_tokens`` and ``ids`` (little-endian
    32-bit numbers) of every document in the files."""
    files = spark.read.schema(FORMAT).parquet(path)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                counts = np.array(row["n_tokens"], np.int64)
                ends = np.cumsum(counts)
                codes = simple8b.decode(np.frombuffer(row["words"], "<u8"), np.frombuffer(row["starts"], "<u4"),
                                        np.frombuffer(row["escapes"], "<u8"), int(ends[-1])).astype("<u4")
                raw, cuts = codes.tobytes(), [0, *(4 * ends).tolist()]
                n = len(counts)
                yield pa.record_batch([
                    pa.array([row["shard"]] * n, pa.int32()), pa.array(row["first"] + ends - counts),
                    pa.array(row["doc_ids"], pa.int64()), pa.array(counts),
                    pa.array([raw[a:b] for a, b in zip(cuts, cuts[1:])], pa.binary())],
                    ["shard", "within", "doc_id", "n_tokens", "ids"])

    docs = files.mapInArrow(run, "shard int, within bigint, doc_id bigint, n_tokens bigint, ids binary")
    # One row per shard, which is one write task: small enough to be sent to all executors at any size.
    totals = files.groupBy("shard").agg(F.max(F.col("first") + F.aggregate(
        "n_tokens", F.lit(0).cast("long"), lambda a, b: a + b)).alias("total"))
    before = Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    bases = totals.select("shard", F.coalesce(F.sum("total").over(before), F.lit(0)).alias("base"))
    return docs.join(F.broadcast(bases), "shard").select(
        "doc_id", (F.col("base") + F.col("within")).alias("start"), "n_tokens", "ids")


def op2_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    path = scratch(spark, "tokens")
    write_tokens(table(spark, sf_dir, "documents"), path, public_tokenizers.path("byte_bpe_50k.json"))
    return read_tokens(spark, path).select("doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))
