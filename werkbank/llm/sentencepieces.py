"""SentencePiece encoding with seeded merge-dropout, and decoding that gives the text back.

Every text is cut into units (spaces and what follows them); no piece of such a model reaches from one unit
into the next. In each round, every unit takes its best candidate merge from its agenda (the best score, then
the leftmost). A candidate is skipped for good if a hash keyed by seed, document, place and piece says so.
Units of a batch go through the rounds side by side; long ones have an agenda of their own."""

from __future__ import annotations

import heapq
import sys
import types
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T

from werkbank.llm.common import table

cloudpickle.register_pickle_by_value(sys.modules[__name__])

#: Characters encoded at once, and the longest unit that goes through the common rounds.
CHARS, LONG = 1 << 17, 48
NONE = np.iinfo(np.int64).max
SLOTS = 20


class Pieces:
    """What a model file holds, as tables: symbols of characters, merges of two symbols, bytes of ids."""

    def __init__(self, path: str):
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        size = model.get_piece_size()
        names = [model.id_to_piece(i) for i in range(size)]
        special = [model.is_control(i) or model.is_unknown(i) or model.is_unused(i) for i in range(size)]
        normal = {n: i for i, n in enumerate(names) if not special[i] and not model.is_byte(i)}
        if any("▁" in n.lstrip("▁") for n in normal):
            raise ValueError("a piece reaches over a space")
        # Characters that occur only inside pieces are symbols too, with numbers above those of the pieces.
        symbols = normal | {c: size + i for i, c in enumerate(sorted({c for n in normal for c in n} - normal.keys()))}
        self.size = size
        self.symbol = np.full(0x110000, -1, np.int32)
        for text, i in symbols.items():
            if len(text) == 1:
                self.symbol[ord(text)] = i
        self.symbol[ord(" ")], self.symbol[ord("▁")] = symbols["▁"], -1
        self.loose = np.zeros(0x110000, bool)  # characters that no merge takes
        self.loose[:] = True
        for n in normal:
            if len(n) > 1:
                self.loose[[ord(c) for c in n]] = False
        self.loose[ord(" ")] = False
        best = sorted((i for n, i in normal.items() if len(n) > 1), key=lambda i: (-model.get_score(i), i))
        self.rank = np.full(size, NONE)
        self.rank[best] = np.arange(len(best))
        self.best = np.array(best, np.int64)  # the piece of each rank
        merges = {(symbols[n[:k]], symbols[n[k:]]): i for n, i in normal.items() for k in range(1, len(n))
                  if n[:k] in symbols and n[k:] in symbols}
        self.merges = merges
        self.keys, self.values = np.full((1 << SLOTS) + 64, -1, np.int64), np.zeros((1 << SLOTS) + 64, np.int64)
        self.probes = 1
        for (a, b), i in merges.items():
            key = a << 32 | b
            slot = int(self._slot(np.array([key]))[0])
            tries = 1
            while self.keys[slot] != -1:
                slot, tries = slot + 1, tries + 1
            self.keys[slot], self.values[slot] = key, i
            self.probes = max(self.probes, tries)
        self.byte = np.array([model.piece_to_id(f"<0x{b:02X}>") for b in range(256)])
        self.raw = [b"" if special[i] else bytes([int(n[3:5], 16)]) if model.is_byte(i) else n.replace("▁", " ").encode()
                    for i, n in enumerate(names)]

    @staticmethod
    def _slot(keys: np.ndarray) -> np.ndarray:
        return ((keys.view(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - SLOTS)).view(np.int64)

    def merged(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """The piece that two symbols make, or -1."""
        keys = left << 32 | right
        keys[(left < 0) | (right < 0)] = -2
        slot, out = self._slot(keys), np.full(len(keys), -1)
        todo = np.arange(len(keys))
        for _ in range(self.probes):
            held = self.keys[slot]
            hit = held == keys[todo]
            out[todo[hit]] = self.values[slot[hit]]
            go = ~hit & (held != -1)
            if not go.any():
                break
            todo, slot = todo[go], slot[go] + 1
        return out


def pieces(path: str) -> Pieces:
    """The tables of a model, kept by the Python worker from task to task."""
    module = sys.modules.setdefault("werkbank_worker_memory", types.ModuleType("werkbank_worker_memory"))
    known = module.__dict__.setdefault("pieces", {})
    if path not in known:
        known[path] = Pieces(path)
    return known[path]


def skipped(key: np.ndarray, start: np.ndarray, middle: np.ndarray, piece: np.ndarray, dropout: float) -> np.ndarray:
    """Whether the candidate at ``start`` (its right part at ``middle``) is skipped in the document of ``key``."""
    h = key ^ (start.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
    h = (h ^ (h >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9) + middle.astype(np.uint64)
    h = (h ^ (h >> np.uint64(32))) * np.uint64(0x94D049BB133111EB) + piece.astype(np.uint64)
    h = (h ^ (h >> np.uint64(29))) * np.uint64(0xD6E8FEB86659FD93)
    return (h >> np.uint64(11)).astype(np.float64) < dropout * 2.0 ** 53


def agenda(model: Pieces, symbols: list[int], starts: np.ndarray, key: np.uint64, dropout: float) -> list[tuple[int, int]]:
    """(place, symbol) of one unit after all merges, by a heap of candidates."""
    n = len(symbols)
    left, right, alive = list(range(-1, n - 1)), [*range(1, n), -1], [True] * n
    heap: list[tuple[int, int, int, int, int]] = []

    def offer(a: int) -> None:
        b = right[a] if a >= 0 else -1
        piece = model.merges.get((symbols[a], symbols[b])) if b >= 0 else None
        if piece is not None and not (dropout and skipped(
                np.array([key]), starts[a:a + 1], starts[b:b + 1], np.array([piece]), dropout)[0]):
            heapq.heappush(heap, (int(model.rank[piece]), a, b, symbols[a], symbols[b]))

    for a in range(n):
        offer(a)
    while heap:
        _, a, b, x, y = heapq.heappop(heap)
        if not (alive[a] and alive[b] and right[a] == b and symbols[a] == x and symbols[b] == y):
            continue
        symbols[a], alive[b], right[a] = model.merges[x, y], False, right[b]
        if right[b] >= 0:
            left[right[b]] = a
        offer(left[a])
        offer(a)
    return [(i, symbols[i]) for i in range(n) if alive[i]]


def encode_batch(model: Pieces, texts: list[str], keys: list[int], dropout: float) -> list[np.ndarray]:
    """Ids of each text; a space before it stands for the one that the model puts there."""
    points = [np.frombuffer((" " + t if t else "").encode("utf-32-le", "surrogatepass"), "<u4") for t in texts]
    code = np.concatenate([np.empty(0, np.uint32), *points])
    lengths = np.array([len(p) for p in points])
    doc = np.repeat(np.arange(len(texts)), lengths)
    start = np.arange(len(code)) - np.repeat(np.cumsum(lengths) - lengths, lengths)
    symbol = model.symbol[code].astype(np.int64)
    space = code == 32
    loose = model.loose[code]
    before = np.r_[True, (doc[1:] != doc[:-1]) | (space[1:] & ~space[:-1]) | loose[1:] | loose[:-1]][:len(code)]
    unit = np.cumsum(before) - 1
    sizes = np.bincount(unit) if len(unit) else np.empty(0, np.int64)
    key = np.array(keys, np.int64).view(np.uint64)
    place, final = np.arange(len(code)), symbol.copy()
    gone = np.zeros(len(code), bool)
    for u in np.flatnonzero(sizes > LONG):
        lo = int(np.searchsorted(unit, u))
        own = slice(lo, lo + int(sizes[u]))
        left = dict(agenda(model, symbol[own].tolist(), start[own], key[doc[lo]], dropout))
        gone[own] = True
        for i, s in left.items():
            final[lo + i], gone[lo + i] = s, False
    place = np.flatnonzero((sizes[unit] > 1) & (sizes[unit] <= LONG)) if len(unit) else place
    own, held, best = unit[place], symbol[place], np.full(len(place), NONE)

    def offer(spots: np.ndarray) -> None:
        """Put on the agenda what the symbols at ``spots`` make with their right neighbours."""
        spots = spots[own[spots] == own[np.minimum(spots + 1, len(own) - 1)]]
        spots = spots[spots + 1 < len(own)]
        piece = model.merged(held[spots], held[spots + 1])
        spots, piece = spots[piece >= 0], piece[piece >= 0]
        if dropout:
            at = place[spots]
            stay = ~skipped(key[doc[at]], start[at], start[place[spots + 1]], piece, dropout)
            spots, piece = spots[stay], piece[stay]
        best[spots] = model.rank[piece] << 32 | spots

    offer(np.arange(len(place)))
    while len(place):
        begin = np.flatnonzero(np.r_[True, own[1:] != own[:-1]])
        top = np.minimum.reduceat(best, begin)
        stays = np.repeat(top != NONE, np.diff(np.r_[begin, len(own)]))
        done = ~stays
        final[place[done]] = held[done]
        taken = top[top != NONE] & 0xFFFFFFFF
        held[taken] = model.best[best[taken] >> 32]
        gone[place[taken + 1]] = True
        stays[taken + 1] = False
        now = np.cumsum(stays) - 1
        place, own, held, best = place[stays], own[stays], held[stays], best[stays]
        taken = now[taken]
        # The numbers of places have changed, and so have the candidates beside a merge.
        live = best != NONE
        best[live] = best[live] >> 32 << 32 | np.flatnonzero(live)
        left = taken[taken > 0] - 1
        changed = np.concatenate([taken, left[own[left] == own[left + 1]]])
        best[changed] = NONE
        offer(changed)
    kept = np.flatnonzero(~gone)
    ids, whose = final[kept], doc[kept]
    unknown = (ids < 0) | (ids >= model.size)
    if unknown.any():
        spelled = [model.byte[np.frombuffer(chr(c).encode("utf-8", "surrogatepass"), np.uint8)] for c in code[kept[unknown]]]
        times = np.ones(len(ids), np.int64)
        times[unknown] = [len(s) for s in spelled]
        flat = np.repeat(ids, times)
        flat[np.repeat(unknown, times)] = np.concatenate(spelled)
        ids, whose = flat, np.repeat(whose, times)
    return np.split(ids.astype("<u4"), np.searchsorted(whose, np.arange(1, len(texts))))


def encode_texts(model: Pieces, texts: list[str], keys: list[int], dropout: float) -> list[bytes]:
    """Ids of each text as little-endian 32-bit numbers, some ``CHARS`` characters at a time."""
    out, some, size = [], [], 0
    for i, text in enumerate(texts):
        some.append(i)
        size += len(text)
        if size >= CHARS or i == len(texts) - 1:
            out += [x.tobytes() for x in encode_batch(model, [texts[j] for j in some], [keys[j] for j in some], dropout)]
            some, size = [], 0
    return out


def decoded(model: Pieces, ids: bytes) -> bytes:
    """The text of ids: the bytes of all pieces without the space before the first."""
    return b"".join(map(model.raw.__getitem__, np.frombuffer(ids, "<u4").tolist()))[1:]


def _parts(batches: Iterator[pa.RecordBatch], column: int) -> Iterator[pa.RecordBatch]:
    """Slices of about ``CHARS`` bytes in a column, so that a worker holds little at a time."""
    for batch in batches:
        sizes = np.fromiter((x.as_buffer().size if x.is_valid else 0 for x in batch.column(column)), np.int64, batch.num_rows)
        ends = np.flatnonzero(np.diff(np.cumsum(sizes) // CHARS)) + 1
        for a, b in zip([0, *ends.tolist()], [*ends.tolist(), batch.num_rows]):
            yield batch.slice(a, b - a)


def _packed(docs: DataFrame) -> Column:
    """The row as one column, so that no name of it can clash."""
    return F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row")


def encoded(docs: DataFrame, path: str, dropout: float = 0.1, seed: int = 0, copies: bool = False) -> DataFrame:
    """All rows of ``docs`` with ``_ids`` (little-endian 32-bit numbers) and ``_lossless`` (whether decoding gives the
    text back). Null is the empty text, without ids. The same seed, doc_id and text give the same ids, so repeated
    rows have equal ones; rows without an id share one key. With ``copies`` equal rows that stand one after the other,
    as a mix makes them, are numbered, and the number is part of the key: each is segmented in its own way.
    Without dropout the ids are the library's own. An empty table stays empty; other columns may have any name,
    but ``_ids`` and ``_lossless`` of the input are replaced.

    Rows go through in parts of about ``CHARS`` characters, so that a worker holds little at a time; a very long text is
    a part of its own and encoded whole."""
    docs = docs.drop("_ids", "_lossless")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model, last, number = pieces(path), None, 0
        for part in _parts(batches, 0):
            raw, keys = [t or b"" for t in part.column(0).to_pylist()], part.column(1).to_pylist()
            if copies:
                for i, (own, text) in enumerate(zip(keys, raw)):
                    number = number + 1 if (own, text) == last else 0
                    last = own, text
                    keys[i] = xxhash.xxh3_64_intdigest(number.to_bytes(8), own & (1 << 64) - 1) - (1 << 63) if number else own
            ids = encode_texts(model, [t.decode("utf-8", "replace") for t in raw], keys, dropout)
            same = [decoded(model, i) == t for i, t in zip(ids, raw)]
            yield pa.RecordBatch.from_arrays([part.column(2), pa.array(ids, pa.binary()), pa.array(same)], ["row", "_ids", "_lossless"])

    rows = docs.select(F.col("text").cast("binary").alias("text"), F.xxhash64(F.lit(seed), "doc_id").alias("key"), _packed(docs))
    schema = T.StructType([rows.schema["row"], T.StructField("_ids", T.BinaryType()), T.StructField("_lossless", T.BooleanType())])
    return rows.mapInArrow(run, schema).select("row.*", "_ids", "_lossless")


def decoded_texts(rows: DataFrame, path: str, ids: str = "_ids") -> DataFrame:
    """All rows with ``_text``, the text of the ids in column ``ids`` (little-endian 32-bit numbers of the model's pieces):
    what ``encoded`` was given, whichever way it was segmented. No ids and null give the empty text. A number that is no
    piece, or half a number, ends the job. Very long rows are decoded whole; other columns may have any name, but ``_text``
    is replaced; an empty table stays empty."""
    rows = rows.drop("_text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = pieces(path)
        for part in _parts(batches, 0):
            texts = [decoded(model, i or b"").decode("utf-8", "replace") for i in part.column(0).to_pylist()]
            yield pa.RecordBatch.from_arrays([part.column(1), pa.array(texts, pa.string())], ["row", "_text"])

    given = rows.select(F.col(f"`{ids}`").alias("ids"), _packed(rows))
    return given.mapInArrow(run, T.StructType([given.schema["row"], T.StructField("_text", T.StringType())])).select("row.*", "_text")


def model_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


def op7_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    back = decoded_texts(encoded(docs, model_path()), model_path())
    return back.select(
        "doc_id", (F.octet_length("_ids") / 4).cast("long").alias("n_ids"), F.crc32("_ids").alias("ids_crc32"),
        (F.col("_text") == F.coalesce("text", F.lit(""))).alias("lossless"), F.col("_ids").alias("ids"),
        F.sha2("_text", 256).alias("decoded_sha256"))
