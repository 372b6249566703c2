"""Quality rules: figures of a text, and its lines marked content or boilerplate by a linear-chain conditional random
field; the share of words in content lines decides whether the text stays."""

from __future__ import annotations

import math
import sys
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession, functions as F, types as T
from pyspark.sql.pandas.types import from_arrow_type

from werkbank.llm.common import table

cloudpickle.register_pickle_by_value(sys.modules[__name__])

#: Labelled documents that the field is fitted on, and the most lines such a document may have.
SAMPLE, LINES = 2_000, 256
EPOCHS, RATE, DECAY = 120, 0.1, 1e-3
#: Share of words in content lines from which a text stays.
SHARE = 0.5
#: Fixed values of the rules: fewest words, and the most words of a hundred in repeated windows.
WORDS, REPEATED = 50, 50
SYMBOLS = b"#*$%&|<>"
_SPACES = bytes(range(9, 14)) + b" "
_LETTERS, _CAPITALS = bytes(range(97, 123)), bytes(range(65, 91))
_ENDS = {46: 0, 33: 1, 63: 0, 44: 2, 58: 2, 59: 2}
#: Figures of a line.
WIDTH = 15
_ASCII = np.array([False] * 256)
_ASCII[[*range(9, 14), 32]] = True
_LATER = np.arange(256) // 64 == 2


class Field(NamedTuple):
    """Weights of a line's figures for content against boilerplate, the score of each step from mark to mark (0
    boilerplate, 1 content), and that of each first mark."""

    weights: np.ndarray
    steps: np.ndarray
    first: np.ndarray


def figures(line: bytes, seen: bool) -> list[float]:
    """Figures of a line with a word, each between 0 and about 1; ``seen``: an earlier line is equal."""
    words = line.split()
    n, size = len(words), len(line)
    less = lambda characters: size - len(line.translate(None, characters))
    capitals = less(_CAPITALS)
    ends = [0, 0, 0]
    for w in words:
        kind = _ENDS.get(w[-1])
        if kind is not None:
            ends[kind] += 1
    last = words[-1][-1]
    return [1.0, min(1.0, math.log1p(n) / 6), min(1.0, 4 * less(SYMBOLS) / size), min(1.0, 4 * less(b"|") / size),
            less(b"0123456789") / size, capitals / max(1, capitals + less(_LETTERS)), ends[1] / n, ends[0] / n, ends[2] / n,
            float(last in (46, 33, 63)), min(1.0, (size - n + 1) / n / 16), float(seen), 1 - len(set(words)) / n,
            min(1.0, 4 * less(b"{}[]()=/\\_@~^\"") / size), float(n == 1)]


def line_figures(text: bytes) -> tuple[list[int], list[int], list[list[float]]]:
    """Number, words and figures of each line that has a word."""
    numbers, sizes, rows, seen = [], [], [], set()
    for i, line in enumerate(text.split(b"\n")):
        words = len(line.split())
        if words:
            numbers.append(i)
            sizes.append(words)
            rows.append(figures(line, line in seen))
            seen.add(line)
    return numbers, sizes, rows


def best_marks(field: Field, rows: list[list[float]]) -> list[int]:
    """Viterbi: the likeliest marks of all lines together; of equally likely ones content counts."""
    own = (np.asarray(rows, float) @ field.weights).tolist()
    (bb, bc), (cb, cc) = field.steps.tolist()
    bad, good = field.first.tolist()
    good += own[0]
    from_bad, from_good = [], []
    for x in own[1:]:
        from_bad.append(good + cb >= bad + bb)
        from_good.append(good + cc >= bad + bc)
        bad, good = max(good + cb, bad + bb), max(good + cc, bad + bc) + x
    mark = int(good >= bad)
    marks = [mark]
    for b, g in zip(reversed(from_bad), reversed(from_good)):
        mark = int(g if mark else b)
        marks.append(mark)
    return marks[::-1]


def risk(flat: np.ndarray, rows: np.ndarray, marks: np.ndarray, there: np.ndarray) -> tuple[float, np.ndarray]:
    """Mean negative log-likelihood of a document's marks, and its gradient, by the forward and backward sums of all
    documents at once (documents x lines x figures, padded where ``there`` is false)."""
    width, n = rows.shape[2], len(rows)
    weights, steps, first = flat[:width], flat[width:width + 4].reshape(2, 2), flat[width + 4:]
    own = np.stack([np.zeros(there.shape), rows @ weights], axis=2)
    length = rows.shape[1]
    ahead, back = np.empty_like(own), np.zeros_like(own)
    ahead[:, 0] = first + own[:, 0]
    for t in range(1, length):
        step = np.logaddexp.reduce(ahead[:, t - 1, :, None] + steps, axis=1) + own[:, t]
        ahead[:, t] = np.where(there[:, t, None], step, ahead[:, t - 1])
    whole = np.logaddexp.reduce(ahead[:, -1], axis=1)
    for t in range(length - 2, -1, -1):
        step = np.logaddexp.reduce(steps + (own[:, t + 1] + back[:, t + 1])[:, None, :], axis=2)
        back[:, t] = np.where(there[:, t + 1, None], step, 0.0)
    chance = np.exp(ahead + back - whole[:, None, None])
    hot = np.eye(2)[marks]
    off = (hot[:, :, 1] - chance[:, :, 1]) * there
    pair = np.exp(ahead[:, :-1, :, None] + steps + (own + back)[:, 1:, None, :] - whole[:, None, None, None])
    moves = (hot[:, :-1, :, None] * hot[:, 1:, None, :] - pair) * there[:, 1:, None, None]
    told = (own * hot).sum(axis=2)
    score = (told * there).sum() + (hot[:, :-1, :, None] * hot[:, 1:, None, :] * steps * there[:, 1:, None, None]).sum() + (
        hot[:, 0] * first).sum()
    grad = np.concatenate([np.einsum("dl,dlf->f", off, rows), moves.sum(axis=(0, 1)).ravel(), (hot[:, 0] - chance[:, 0]).sum(axis=0)])
    return (whole.sum() - score) / n, -grad / n


def fit(texts: list[tuple[list[list[float]], int]]) -> Field | None:
    """A field from the lines of documents and their labels: all lines of a good document count as content, all of
    a bad one as boilerplate. Documents are taken in the order of their number of lines, so that little is padded; every
    step (Adam) looks at all. None where one of the labels is missing."""
    texts = sorted((t for t in texts if t[0]), key=lambda t: (len(t[0]), t))
    if len({label for _, label in texts}) < 2:
        return None
    packs = []
    for i in range(0, len(texts), 64):
        pack = texts[i:i + 64]
        rows = np.zeros((len(pack), len(pack[-1][0]), WIDTH))
        there = np.zeros(rows.shape[:2], bool)
        for j, (own, _) in enumerate(pack):
            rows[j, :len(own)], there[j, :len(own)] = own, True
        packs.append((rows, np.repeat([[label] for _, label in pack], rows.shape[1], axis=1), there))
    flat = np.zeros(WIDTH + 6)
    mean, square = np.zeros_like(flat), np.zeros_like(flat)
    for step in range(1, EPOCHS + 1):
        grad = DECAY * flat + sum(risk(flat, *p)[1] * len(p[0]) for p in packs) / len(texts)
        mean += 0.1 * (grad - mean)
        square += 0.01 * (grad * grad - square)
        flat = flat - RATE * (mean / (1 - 0.9 ** step)) / (np.sqrt(square / (1 - 0.99 ** step)) + 1e-8)
    return Field(flat[:WIDTH], flat[WIDTH:WIDTH + 4].reshape(2, 2), flat[WIDTH + 4:])


def trained(docs: DataFrame, labels: DataFrame) -> Field | None:
    """A field from ``SAMPLE`` labelled documents of at most ``LINES`` lines, those of smallest hash of the id. A document
    with conflicting labels counts as bad; of several texts of one id the one of smallest hash is taken, in Spark,
    so that at most ``SAMPLE`` rows reach the driver."""
    short = F.length("text") - F.length(F.replace("text", F.lit("\n"), F.lit(""))) < LINES
    known = labels.where("doc_id is not null and quality is not null").groupBy("doc_id").agg(F.min("quality").alias("quality"))
    thin = docs.where(F.col("text").isNotNull() & short).select("doc_id", F.xxhash64("text").alias("hash")).groupBy("doc_id").agg(
        F.min("hash").alias("hash"))
    drawn = thin.join(known, "doc_id").orderBy(F.xxhash64("doc_id"), "doc_id").limit(SAMPLE)
    # At most SAMPLE rows.
    rows = docs.where(short).select("doc_id", "text", F.xxhash64("text").alias("hash")).join(
        F.broadcast(drawn), ["doc_id", "hash"]).select("doc_id", "quality", "hash", F.col("text").cast("binary").alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [np.asarray(line_figures(t.as_py())[2], np.float32).tobytes() for t in batch.column(3)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(found, pa.binary())], ["doc_id", "label", "lines"])

    lines = rows.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("quality").cast("int").alias("label"), "hash", "text").mapInArrow(
        run, "doc_id long, label int, lines binary")
    # Repeated rows go here, so that a document counts once.
    found = lines.groupBy("doc_id").agg(F.min("label").alias("label"), F.min("lines").alias("lines")).collect()
    return fit([(np.frombuffer(r["lines"], np.float32).reshape(-1, WIDTH).astype(float).tolist(), int(r["label"] == 1)) for r in found])


def repeated_words(words: list[bytes]) -> int:
    """Words in windows of three that occur twice or more."""
    if len(words) < 4:
        return 0
    number: dict[bytes, int] = {}
    codes = np.fromiter((number.setdefault(w, len(number)) for w in words), np.int64, len(words))
    pairs = np.unique(codes[:-1] * len(number) + codes[1:], return_inverse=True)[1]
    _, runs, times = np.unique(pairs[:-1] * len(number) + codes[2:], return_inverse=True, return_counts=True)
    twice = np.append(times[runs] > 1, [False, False])
    return int((twice | np.roll(twice, 1) | np.roll(twice, 2)).sum())


def text_figures(raw: bytes) -> tuple[int, int, int, int, int]:
    """``n_words``, ``word_chars``, ``n_symbols``, ``n_dup_lines`` and ``n_repeat_words`` of a text."""
    words = raw.split()
    counts = np.bincount(np.frombuffer(raw, np.uint8), minlength=256)
    lines = [line for line in raw.split(b"\n") if line.strip(_SPACES)]
    return (len(words), int(counts.sum() - counts[_ASCII].sum() - counts[_LATER].sum()), int(counts[list(SYMBOLS)].sum()),
            len(lines) - len(set(lines)), repeated_words(words))


def line_quality(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """All rows of ``docs`` with a struct ``_lines``: the figures of the rules (``n_words``, ``word_chars``, ``n_symbols``,
    ``n_dup_lines``, ``n_repeat_words``), ``base_failed``, ``marks`` (a letter per line: c content, b boilerplate, - no
    word), ``content_share`` (words in content lines among all) and ``kept``.

    Null and empty texts have no words, no marks and a share of 0, and fail the rules. Very long texts are read whole, line
    by line; a text of one line has one mark. Equal texts get equal results, whatever their id; labels of documents that
    do not exist are ignored. Without labels of both kinds every line is content. Other columns stay as they
    are, whatever their names, but ``_lines`` is replaced; an empty table gives an empty result."""
    field = trained(docs, labels)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            own = []
            for text in batch.column(0).field("text").cast(pa.binary()):
                raw = text.as_py() or b""
                n, chars, symbols, copies, again = text_figures(raw)
                numbers, sizes, rows = line_figures(raw)
                marks = (best_marks(field, rows) if field else [1] * len(rows)) if rows else []
                spelled = ["-"] * (raw.count(b"\n") + 1 if raw else 0)
                for i, m in zip(numbers, marks):
                    spelled[i] = "bc"[m]
                share = sum(s for s, m in zip(sizes, marks) if m) / n if n else 0.0
                failed = n < WORDS or 100 * again > REPEATED * n
                own.append((n, chars, symbols, copies, again, failed, "".join(spelled), share, not failed and share >= SHARE))
            columns = zip(*own) if own else [[]] * len(found)
            packed = pa.StructArray.from_arrays([pa.array(c, f.type) for c, f in zip(columns, found)], fields=list(found))
            yield pa.RecordBatch.from_arrays([batch.column(0), packed], ["row", "_lines"])

    found = [pa.field(n, t) for n, t in (*((n, pa.int64()) for n in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")),
                                         ("base_failed", pa.bool_()), ("marks", pa.string()), ("content_share", pa.float64()), ("kept", pa.bool_()))]
    rest = docs.drop("_lines")
    rows = rest.select(F.struct(*[F.col(f"`{c}`") for c in rest.columns]).alias("row"))
    kind = T.StructType([*rows.schema.fields, T.StructField("_lines", from_arrow_type(pa.struct(found)))])
    return rows.mapInArrow(run, kind).select("row.*", "_lines")


def content_documents(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The documents that stay, columns unchanged. Rows are treated as in ``line_quality``: null and empty texts go, equal
    texts stay or go together, and an empty table gives an empty result."""
    return line_quality(docs, labels).where("_lines.kept").drop("_lines")


def op12_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return line_quality(docs, table(spark, sf_dir, "labels")).select("doc_id", *(f"_lines.{c}" for c in (
        "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "content_share", "marks")))
