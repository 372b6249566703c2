"""Suffix-array dedup: removes every byte that lies in a string of 100 bytes seen earlier in the corpus.

1. A string of 100 bytes is named by its anchor, the 32-byte piece of smallest hash in it. Neighbouring
   strings mostly share their anchor; such a run of strings is a context of 100 to 168 bytes. About one
   position in 35 is an anchor, and only these travel: hash of the piece, hash of the context, place.
2. Per anchor and context the first place is kept. An anchor with one context is settled there: the
   first place keeps its strings, all others lose them.
3. The contexts of the other anchors are cut from their texts, and all strings in them are ordered by a
   deep-shallow suffix sort. Of equal strings the first keeps its place.
4. Strings that kept their place go back to their texts; what only others cover is removed."""

from __future__ import annotations

import sys
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F, types as T

from werkbank.llm import suffixes
from werkbank.llm.common import id_or_last, stored, table

cloudpickle.register_pickle_by_value(sys.modules[__name__])

PIECE = 32
#: Bytes of text that are hashed at once, and anchors gathered before copies among them are merged.
BYTES, ANCHORS = 1 << 19, 300_000
#: Contexts of one anchor that are sorted in one bucket; the strings of others get buckets of their own.
BUCKET = 4096
#: Lanes that the contexts of one anchor are dealt over.
LANES = 32
#: Bytes of contexts that are sorted at once.
SORTED = 1 << 20
#: A place in a text is one number: first start and, in the lowest bits, number of starts.
COUNT = 7


def tie() -> Column:
    """Tells the texts of one id apart."""
    return F.xxhash64("text")


def mixed(words: np.ndarray) -> np.ndarray:
    words = words * np.uint64(0x9E3779B97F4A7C15)
    words ^= words >> np.uint64(32)
    return words


def anchors(data: np.ndarray, length: int) -> tuple[np.ndarray, ...]:
    """Runs of strings of ``length`` bytes with a common anchor: first start, number of starts, anchor's
    place, anchor's hash. Sums of mixed words give each piece's hash; minima of 1, 2, 4, ... pieces
    give that of each string. A place stands in the lower bits, so the leftmost of ties wins."""
    n = len(data) - length + 1
    words = mixed(np.ndarray((len(data) - 7,), "<u8", data, strides=(1,)))
    pieces = len(data) - PIECE + 1
    hashes = words[:pieces].copy()
    for i in range(8, PIECE, 8):
        hashes *= np.uint64(0xD6E8FEB86659FD93)
        hashes += words[i:i + pieces]
    hashes = mixed(hashes)
    low = np.uint64((1 << 24) - 1)
    least, span, window = (hashes & ~low) | np.arange(pieces, dtype=np.uint64), 1, length - PIECE + 1
    while span < window:
        ahead = min(span, window - span)
        least = np.minimum(least[:len(least) - ahead], least[ahead:])
        span += ahead
    place = (least[:n] & low).astype(np.int64)
    first = np.flatnonzero(np.r_[True, place[1:] != place[:-1]])
    return first, np.diff(np.r_[first, n]), place[first], hashes[place[first]]


def text_anchors(text: bytes, length: int) -> Iterator[tuple[np.ndarray, ...]]:
    """(first start, number of starts, anchor's place in the run, anchor hash, context hash) of a text, in parts."""
    for at in range(0, len(text) - length + 1, BYTES):
        part = text[at:at + BYTES + length - 1]
        first, count, place, key = anchors(np.frombuffer(part, np.uint8), length)
        context = np.fromiter(map(xxhash.xxh3_64_intdigest, map(part.__getitem__, map(
            slice, first.tolist(), (first + count + length - 1).tolist()))), np.uint64, len(first))
        yield first + at, count, place - first, key, context


def _merged(rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """One row per anchor and context (the earliest) of rows (key, context, doc, tie, code, at), and whether
    its anchor has several contexts here."""
    rows = rows[:, np.lexsort((rows[4], rows[3], rows[2], rows[1], rows[0]))]
    new_key = np.r_[True, rows[0, 1:] != rows[0, :-1]]
    new = new_key | np.r_[True, rows[1, 1:] != rows[1, :-1]]
    rows, begin = rows[:, new], np.flatnonzero(new_key[new])
    sizes = np.diff(np.r_[begin, rows.shape[1]])
    return rows, np.repeat(sizes > 1, sizes)


def parts(batches: Iterator[pa.RecordBatch], column: int) -> Iterator[pa.RecordBatch]:
    """Slices of about ``BYTES`` bytes of text each, so that a worker holds little at a time."""
    for batch in batches:
        sizes = np.fromiter((len(x.as_buffer()) if x.is_valid else 0 for x in batch.column(column)), np.int64, batch.num_rows)
        ends = np.flatnonzero(np.diff(np.cumsum(sizes) // BYTES)) + 1
        for a, b in zip([0, *ends.tolist()], [*ends.tolist(), batch.num_rows]):
            yield batch.slice(a, b - a)


def find_anchors(docs: DataFrame, length: int) -> DataFrame:
    """``key``, ``salt``, ``context``, ``doc``, ``tie``, ``code``, ``at`` of all anchors, merged in each part of a task.
    Where an anchor shows several contexts in a part, its rows are spread by context (``salt``), and a
    row without a context tells the anchor's own group of it: no anchor's rows must meet in a task."""

    def emit(parts: list[np.ndarray]) -> pa.RecordBatch:
        rows, several = _merged(np.concatenate(parts, axis=1))
        told = np.unique(rows[0, several])
        gap = np.zeros(len(told), np.int64)
        put = lambda i, extra: pa.array(np.r_[rows[i], extra])
        empty = np.r_[np.zeros(rows.shape[1], bool), np.ones(len(told), bool)]
        return pa.record_batch([
            put(0, told), pa.array(np.r_[np.where(several, rows[1] | 1, 0), gap]),
            pa.array(np.r_[rows[1], gap], mask=empty), put(2, gap), put(3, gap), put(4, gap),
            pa.array(np.r_[rows[5], gap].astype(np.int8))], ["key", "salt", "context", "doc", "tie", "code", "at"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts, size = [], 0
        for batch in batches:
            for doc, mark, text in zip(*(batch.column(i) for i in range(3))):
                doc, mark, text = doc.as_py(), mark.as_py(), text.as_py() or b""
                for first, count, at, key, context in text_anchors(text, length):
                    parts.append(np.stack([key.view(np.int64), context.view(np.int64), np.full(len(first), doc),
                                           np.full(len(first), mark), first << COUNT | count, at]))
                    size += len(first)
                    if size >= ANCHORS:
                        yield emit(parts)
                        parts, size = [], 0
        if parts:
            yield emit(parts)

    texts = docs.select(id_or_last().alias("doc"), tie().alias("tie"),
                        F.col("text").cast("binary").alias("text")).where(F.octet_length("text") >= length)
    return texts.mapInArrow(run, "key long, salt long, context long, doc long, tie long, code long, at byte")


def first_contexts(found: DataFrame) -> DataFrame:
    """The first place of each anchor and context; ``key`` is null where the anchor has no other context."""
    group = Window.partitionBy("key", "salt")
    rows = (found.repartition("key", "salt")
            .withColumn("last", F.lag("context").over(group.orderBy("context", "doc", "tie", "code")))
            .withColumn("several", (F.min("context").over(group) < F.max("context").over(group))
                        | (F.count("context").over(group) < F.count("*").over(group)) | (F.col("salt") != 0)))
    return rows.where("context is not null and (last is null or last <> context)").select(
        "doc", "tie", "code", "at", F.when(F.col("several"), F.col("key")).alias("key"))


def cut_contexts(texts: DataFrame, wanted: DataFrame, length: int) -> DataFrame:
    """``bucket``, ``doc``, ``tie``, ``code``, ``at``, ``bytes`` of the contexts to be sorted. The strings of an anchor with
    very many contexts are cut one by one, with their own hash as bucket, and merged in each batch."""
    per_doc = wanted.groupBy("doc", "tie").agg(F.collect_list(F.struct("code", "key", "at", "crowded")).alias("places"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["bucket", "doc", "tie", "code", "at", "bytes"]
        for batch in parts(batches, 2):
            out, single = ([], [], [], [], [], []), {}
            for doc, mark, text, places in zip(*(c.to_pylist() for c in batch.columns)):
                for p in places:
                    start, count = p["code"] >> COUNT, p["code"] & (1 << COUNT) - 1
                    if not p["crowded"]:
                        for column, value in zip(out, (p["key"], doc, mark, p["code"], p["at"], text[start:start + count + length - 1])):
                            column.append(value)
                        continue
                    for s in range(start, start + count):
                        place = (doc, mark, s << COUNT | 1)
                        string = text[s:s + length]
                        single[string] = min(place, single.get(string, place))
            for string, (doc, mark, code) in single.items():
                for column, value in zip(out, (xxhash.xxh3_64_intdigest(string) - (1 << 63), doc, mark, code, 0, string)):
                    column.append(value)
            yield pa.record_batch([*(pa.array(x, pa.int64()) for x in out[:4]), pa.array(out[4], pa.int8()),
                                   pa.array(out[5], pa.binary())], names)

    joined = texts.join(per_doc, ["doc", "tie"]).select("doc", "tie", "text", "places")
    return joined.mapInArrow(run, "bucket long, doc long, tie long, code long, at byte, bytes binary")


def sort_contexts(contexts: DataFrame, length: int) -> DataFrame:
    """``doc``, ``tie`` and ``code`` of the runs of strings in the contexts that no earlier place has."""

    def settle(rows: list[pa.RecordBatch]) -> pa.RecordBatch:
        rows = pa.Table.from_batches(rows).combine_chunks()
        bucket, doc, mark, code, at = (rows.column(i).to_numpy().astype(np.int64) for i in range(5))
        raw = rows.column(5).to_pylist()
        sizes = np.fromiter(map(len, raw), np.int64, len(raw))
        data = np.frombuffer(b"".join(raw) + bytes(8), np.uint8)
        counts = sizes - length + 1
        row = np.repeat(np.arange(len(raw)), counts)
        step = np.arange(counts.sum()) - np.repeat(np.cumsum(counts) - counts, counts)
        # Equal strings have their anchor at one distance, so bucket and distance part them beforehand.
        begin = np.flatnonzero(np.r_[True, bucket[1:] != bucket[:-1]])
        dense = np.repeat(np.arange(len(begin)), np.diff(np.r_[begin, len(bucket)]))
        order, group = suffixes.deep_shallow(
            data, (np.cumsum(sizes) - sizes)[row] + step, dense[row] * 256 + at[row] - step + 128, length)
        row, step = row[order], step[order]
        place = (code[row] >> COUNT) + step
        earliest = np.lexsort((place, mark[row], doc[row], group))
        keep = earliest[np.r_[True, group[earliest][1:] != group[earliest][:-1]]]
        row, step = row[keep], step[keep]
        turn = np.lexsort((step, row))
        row, step = row[turn], step[turn]
        first = np.flatnonzero(np.r_[True, (row[1:] != row[:-1]) | (step[1:] != step[:-1] + 1)])
        runs = np.diff(np.r_[first, len(row)])
        codes = (((code[row[first]] >> COUNT) + step[first]) << COUNT) | runs
        return pa.record_batch([pa.array(doc[row[first]]), pa.array(mark[row[first]]), pa.array(codes)], ["doc", "tie", "code"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for batch in batches:
            for i in range(0, batch.num_rows, 8192):
                part = batch.slice(i, 8192)
                keys = part.column(0).to_numpy()
                if size >= SORTED and keys[0] != held[-1].column(0)[-1].as_py():
                    yield settle(held)
                    held, size = [], 0
                elif size >= SORTED and keys[-1] != keys[0]:  # the open bucket ends in this part
                    cut = int(np.searchsorted(keys, keys[0], side="right"))
                    yield settle([*held, part.slice(0, cut)])
                    held, size, part = [], 0, part.slice(cut)
                held.append(part)
                size += part.nbytes
        if held:
            yield settle(held)

    return (contexts.repartition("bucket").sortWithinPartitions("bucket")
            .mapInArrow(run, "doc long, tie long, code long"))


def without_repeats(docs: DataFrame, length: int = 100, as_text: bool = False) -> DataFrame:
    """All rows of ``docs`` with a struct ``_kept``: ``bytes`` (what is left; or ``text``, without what a cut leaves
    of a character) and ``spans`` (first and last + 1
    byte of each maximal removed run, one after the other).

    A byte goes if a string of ``length`` bytes over it also starts earlier: in a smaller doc_id, or earlier in
    the same text. Null text is empty, texts below ``length`` bytes stay whole. Rows without a doc_id come
    after all others; rows of one id (or none) are ordered by the hash of their text, and rows that repeat id
    and text are one document, with one result for all. Very long texts are hashed in parts that overlap, and are cut
    whole. Other columns stay, whatever their names, but ``_kept`` is replaced; an empty table gives an empty result."""
    if not PIECE + 8 <= length <= PIECE + (1 << COUNT) - 2:
        raise ValueError("the strings must have 40 to 158 bytes")
    firsts = stored(first_contexts(find_anchors(docs, length)), "repeats")
    open_ = firsts.where("key is not null")
    # Contexts of an anchor are dealt over lanes, so that those of a common one do not meet to be told that it is crowded.
    lanes = F.explode(F.sequence(F.lit(0).cast("long"), F.lit(LANES - 1).cast("long")))
    crowded = open_.groupBy("key").count().where(F.col("count") > BUCKET).select("key", lanes.alias("lane"), F.lit(True).alias("crowded"))
    lane = F.pmod(F.xxhash64("doc", "tie", "code"), F.lit(LANES))
    wanted = open_.withColumn("lane", lane).join(crowded, ["key", "lane"], "left").select(
        "doc", "tie", "code", "key", "at", F.coalesce("crowded", F.lit(False)).alias("crowded"))
    texts = docs.select(id_or_last().alias("doc"), tie().alias("tie"),
                        F.col("text").cast("binary").alias("text")).where(F.octet_length("text") >= length)
    sorted_ = sort_contexts(cut_contexts(texts, wanted, length), length)
    runs = (firsts.where("key is null").select("doc", "tie", "code").unionByName(sorted_)
            .groupBy("doc", "tie").agg(F.collect_list("code").alias("runs")))

    # The row travels as one column, so that no name of it can clash.
    docs = docs.drop("_kept")
    packed = F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row")
    rows = docs.select(packed, id_or_last().alias("doc"), tie().alias("tie")).join(runs, ["doc", "tie"], "left")
    rows = rows.select(F.col("row.text").cast("binary").alias("text"), "runs", "row")
    kind = pa.struct([("text", pa.string()) if as_text else ("bytes", pa.binary()), ("spans", pa.list_(pa.int64()))])

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in parts(batches, 0):
            found = [_keep(t or b"", r, length) for t, r in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist())]
            kept = pa.array([x.decode("utf-8", "ignore") for x, _ in found] if as_text else [x for x, _ in found], kind[0].type)
            kept = pa.StructArray.from_arrays([kept, pa.array([x for _, x in found], kind[1].type)], fields=list(kind))
            yield pa.RecordBatch.from_arrays([batch.column(2), kept], names=["row", "_kept"])

    held = T.StructType([T.StructField("text", T.StringType()) if as_text else T.StructField("bytes", T.BinaryType()),
                         T.StructField("spans", T.ArrayType(T.LongType()))])
    return rows.mapInArrow(keep, T.StructType([rows.schema["row"], T.StructField("_kept", held)])).select("row.*", "_kept")


def _keep(text: bytes, runs: np.ndarray | None, length: int) -> tuple[bytes, list[int]]:
    if len(text) < length:
        return text, []
    runs = np.asarray([] if runs is None else runs, np.int64)
    start, count = runs >> COUNT, runs & (1 << COUNT) - 1
    kept = np.zeros(len(text) - length + 2, np.int64)
    np.add.at(kept, start, 1)
    np.add.at(kept, start + count, -1)
    repeated = np.cumsum(kept[:-1]) == 0
    edge = np.diff(np.r_[0, repeated, 0].astype(np.int64))
    begins, ends = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1) + length - 1
    if not len(begins):
        return text, []
    apart = begins[1:] > ends[:-1]  # removed runs that touch are one
    begins, ends = begins[np.r_[True, apart]], ends[np.r_[apart, True]]
    spans = np.stack([begins, ends], axis=1).ravel().tolist()
    cuts = [0, *spans, len(text)]
    return b"".join(text[a:b] for a, b in zip(cuts[::2], cuts[1::2])), spans


def op1_suffix_array(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    spans = F.col("_kept.spans")
    removed = F.aggregate(F.transform(spans, lambda x, i: F.when(i % 2 == 1, x).otherwise(-x)),
                          F.lit(0).cast("long"), lambda a, b: a + b)
    return without_repeats(docs).select(
        "doc_id", F.coalesce(F.octet_length("text"), F.lit(0)).cast("long").alias("n_bytes"), removed.alias("n_removed"),
        (F.size(spans) / 2).cast("long").alias("n_spans"), F.sha2("_kept.bytes", 256).alias("kept_sha256"))


#: Strings are compared by a 64-bit hash of their bytes here, and texts are cut as hexadecimal digits.
OP1_SQL = """
WITH d AS (SELECT row_number() OVER () AS r, doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents),
     p AS (SELECT r, doc_id, h, unnest(range(0, len(h) // 2 - 99)) AS pos FROM d WHERE len(h) >= 200),
     s AS (SELECT r, doc_id, pos, hash(substr(h, 2 * pos + 1, 200)) AS s FROM p),
     f AS (SELECT r, pos, row_number() OVER (PARTITION BY s ORDER BY doc_id, pos) AS n FROM s),
     e AS (SELECT r, pos, CASE WHEN pos <= lag(pos) OVER (PARTITION BY r ORDER BY pos) + 100 THEN 0 ELSE 1 END AS new FROM f WHERE n > 1),
     g AS (SELECT r, pos, sum(new) OVER (PARTITION BY r ORDER BY pos) AS run FROM e),
     x AS (SELECT r, run, min(pos) AS a, max(pos) + 100 AS b FROM g GROUP BY r, run),
     c AS (SELECT r, a, b, lag(b, 1, 0) OVER (PARTITION BY r ORDER BY a) AS before FROM x),
     k AS (SELECT r, count(*) AS spans, sum(b - a)::BIGINT AS gone, max(b) AS tail,
         string_agg(substr(h, 2 * before + 1, 2 * (a - before)), '' ORDER BY a) AS kept FROM c JOIN d USING (r) GROUP BY r)
SELECT doc_id, (len(h) // 2)::BIGINT AS n_bytes, coalesce(gone, 0)::BIGINT AS n_removed, coalesce(spans, 0)::BIGINT AS n_spans,
    sha256(unhex(CASE WHEN spans IS NULL THEN h ELSE kept || substr(h, 2 * tail + 1) END)) AS kept_sha256
FROM d LEFT JOIN k USING (r)
"""
