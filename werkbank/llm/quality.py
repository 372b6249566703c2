"""Quality classifier: positive-unlabelled learning with the non-negative risk estimator."""

from __future__ import annotations

import sys
from collections import Counter
from operator import eq
from typing import NamedTuple

import numpy as np
import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from werkbank.llm.common import table

cloudpickle.register_pickle_by_value(sys.modules[__name__])

#: Documents that a model is fitted on: at most so many trusted positives and so many unlabelled ones.
POSITIVES, UNLABELLED = 8_000, 16_000
#: Features of a text.
WIDTH = 31
HIDDEN, EPOCHS, RATE, DECAY = 24, 400, 0.01, 1e-4


class Model(NamedTuple):
    """A net with one hidden layer over standardised features; ``prior`` is the share of good texts."""

    centre: np.ndarray
    scale: np.ndarray
    first: np.ndarray
    first_bias: np.ndarray
    second: np.ndarray
    second_bias: float
    prior: float


def features(text: bytes | None) -> list[float]:
    """Figures of a whole text that do not name its words: shares of kinds of bytes, the spread of bytes,
    words and lines, repetition. An empty or null text has them all at zero."""
    raw = text or b""
    words = raw.split()
    if not words:
        return [0.0] * WIDTH
    size, n = len(raw), len(words)
    counts = np.bincount(np.frombuffer(raw, np.uint8), minlength=256)
    share = counts / size
    part = share[share > 0]
    kinds = [share[65:91].sum(), share[97:123].sum(), share[48:58].sum(), share[128:].sum(),
             share[32], share[10], share[[44, 46]].sum(), share[33], share[63], share[124],
             share[[35, 36, 37, 38, 42, 43, 60, 61, 62, 64, 94, 95, 96, 126]].sum(), share[[39, 34]].sum(),
             share[[40, 41, 91, 93, 123, 125]].sum(), share[[45, 47, 58, 59, 92]].sum()]
    times = Counter(words)
    lines = raw.split(b"\n")
    top = sorted(times.values(), reverse=True)
    lengths = np.fromiter(map(len, words), np.int64, n)
    ends = sum(map(raw.count, (b". ", b".\n", b"! ", b"? ")))
    return [*kinds, -(part * np.log2(part)).sum(), np.log1p(size), np.log1p(n), lengths.mean(), lengths.std(),
            len(times) / n, top[0] / n, sum(top[:10]) / n, sum(map(eq, words, words[1:])) / n,
            len(set(lines)) / len(lines), max(map(len, lines)) / size, np.log1p(len(lines)), ends / n,
            sum(map(bytes.isupper, words)) / n, sum(map(bytes.istitle, words)) / n,
            sum(not w[:1].isalpha() and w[0] < 128 for w in words) / n,
            sum(not w[-1:].isalpha() and w[-1] < 128 for w in words) / n]


def raw_score(model: Model, x: np.ndarray) -> np.ndarray:
    z = np.clip((x - model.centre) / model.scale, -6, 6)
    return np.tanh(z @ model.first + model.first_bias) @ model.second + model.second_bias


def fit(positive: np.ndarray, unlabelled: np.ndarray, prior: float, seed: int = 0) -> Model:
    """Minimise the non-negative unbiased risk: ``prior`` times the loss of the positives as good, plus the
    loss of the unlabelled as bad less ``prior`` times that of the positives as bad. Where that second
    part falls below zero, the step goes against it instead. The loss is the sigmoid of the score;
    all rows take part in every step (Adam), so the result hangs on the rows and the seed alone."""
    centre, scale = unlabelled.mean(axis=0), unlabelled.std(axis=0) + 1e-6
    x = np.clip((np.concatenate([positive, unlabelled]) - centre) / scale, -6, 6)
    n = len(positive)
    rng = np.random.default_rng(seed)
    parts = [rng.normal(0, x.shape[1] ** -0.5, (x.shape[1], HIDDEN)), np.zeros(HIDDEN),
             rng.normal(0, HIDDEN ** -0.5, HIDDEN), np.zeros(1)]
    means, squares = [np.zeros_like(p) for p in parts], [np.zeros_like(p) for p in parts]
    for step in range(1, EPOCHS + 1):
        hidden = np.tanh(x @ parts[0] + parts[1])
        bad = 1 / (1 + np.exp(-np.clip(hidden @ parts[2] + parts[3], -30, 30)))  # loss as a bad text
        slope = bad * (1 - bad)
        rest = bad[n:].mean() - prior * bad[:n].mean()
        back = np.empty(len(x))
        if rest >= 0:
            back[:n], back[n:] = -2 * prior * slope[:n] / n, slope[n:] / (len(x) - n)
        else:
            back[:n], back[n:] = prior * slope[:n] / n, -slope[n:] / (len(x) - n)
        inner = np.outer(back, parts[2]) * (1 - hidden ** 2)
        grads = [x.T @ inner + DECAY * parts[0], inner.sum(axis=0), hidden.T @ back + DECAY * parts[2],
                 np.array([back.sum()])]
        for p, g, m, s in zip(parts, grads, means, squares):
            m += 0.1 * (g - m)
            s += 0.001 * (g * g - s)
            p -= RATE * (m / (1 - 0.9 ** step)) / (np.sqrt(s / (1 - 0.999 ** step)) + 1e-8)
    return Model(centre, scale, parts[0], parts[1], parts[2], float(parts[3][0]), prior)


def held_out() -> Column:
    """Whether the row's label may not be learned from; rows without an id have no label."""
    return F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 1, F.lit(False))


def trained(docs: DataFrame, labels: DataFrame, seed: int = 0, positives: int = POSITIVES, unlabelled: int = UNLABELLED) -> Model | None:
    """A model from trusted positives (``quality`` 1, never 0, not held out) and unlabelled texts.

    The prior is estimated as the share of good ones among the labelled documents that may be used. Both
    samples are the ids of smallest seeded hash, at most ``positives`` and ``unlabelled`` of them. An id counts once, with
    its text of smallest hash, and that is settled in Spark: what reaches the driver is at most ``positives + unlabelled``
    rows of features, however often an id is repeated, and the result does not hang on the order of rows. None where
    there is nothing to learn from."""
    known = (labels.where(F.col("doc_id").isNotNull() & F.col("quality").isNotNull() & ~held_out())
             .groupBy("doc_id").agg(F.min("quality").alias("quality")))
    # A document without a text is known by no hash and counts as the empty text.
    marked = docs.where("doc_id is not null").select("doc_id", F.xxhash64("text").alias("mark")).groupBy("doc_id").agg(
        F.min("mark").alias("mark"))
    good = marked.join(known, "doc_id")
    order = F.xxhash64("doc_id", F.lit(seed))
    shares = good.agg(F.avg("quality")).first()[0]
    sampled = (good.where("quality = 1").select("doc_id", "mark").orderBy(order, "doc_id").limit(positives)
               .withColumn("positive", F.lit(True)).unionByName(
        marked.orderBy(order, "doc_id").limit(unlabelled).withColumn("positive", F.lit(False))))
    # At most positives + unlabelled rows.
    wanted = sampled.groupBy("doc_id", "mark").agg(F.max("positive").alias("positive"), F.min("positive").alias("only"))
    rows = docs.select("doc_id", F.xxhash64("text").alias("mark"), F.col("text").cast("binary").alias("text")).join(
        F.broadcast(wanted), ["doc_id", "mark"])
    drawn = rows.select("doc_id", "positive", "only", _features("text").alias("x")).groupBy("doc_id").agg(
        F.first("positive").alias("positive"), F.first("only").alias("only"), F.min("x").alias("x")).toPandas()
    drawn = drawn.sort_values("doc_id", kind="stable")
    x = np.array(drawn["x"].tolist(), float).reshape(-1, WIDTH)
    positive, free = x[drawn["positive"].to_numpy(bool)], x[~drawn["only"].to_numpy(bool)]
    if not len(positive) or not len(free):
        return None
    return fit(positive, free, shares, seed)


def _features(name: str) -> Column:
    @F.pandas_udf("array<double>")
    def run(texts: pd.Series) -> pd.Series:
        return pd.Series([features(t) for t in texts])

    return run(name)


def score(model: Model | None, text: str = "text") -> Column:
    """The chance, from 0 to 1, that the text is good; 0.5 for all where there is no model."""
    if model is None:
        return F.lit(0.5)

    @F.pandas_udf("double")
    def run(texts: pd.Series) -> pd.Series:
        x = np.array([features(t) for t in texts], float).reshape(-1, WIDTH)
        return pd.Series(1 / (1 + np.exp(-np.clip(raw_score(model, x), -30, 30))))

    return run(F.col(text).cast("binary"))


def quality_scores(docs: DataFrame, labels: DataFrame, seed: int = 0) -> DataFrame:
    """``doc_id``, ``held_out``, ``score`` and ``predicted`` (1 from a score of 0.5) for every row.

    Null and empty texts get the score of a text with all features at zero. Repeated rows get equal scores;
    rows without an id are scored and not learned from; a document with conflicting labels is no
    positive. Very long texts are read whole. Other columns are ignored; an empty table gives an empty result.
    Without usable positives every score is 0.5."""
    found = docs.select("doc_id", held_out().alias("held_out"), score(trained(docs, labels, seed)).alias("score"))
    return found.withColumn("predicted", (F.col("score") >= 0.5).cast("int"))


def good_documents(docs: DataFrame, labels: DataFrame, seed: int = 0) -> DataFrame:
    """The documents predicted good, columns unchanged, whatever their names.

    Null and empty texts stay or go as a text with all features at zero does, equal texts together, rows without an
    id like others; very long texts are read whole; an empty table gives an empty result, and without usable
    positives every document stays."""
    return docs.where(score(trained(docs, labels, seed)) >= 0.5)


def op10_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_scores(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
