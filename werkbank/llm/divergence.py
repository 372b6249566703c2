"""Source divergence audit: how far the word shares of the sources of a language lie apart, from run-length columns.

The vocabulary of a language is cut into blocks of terms of about equal frequency and ordered in each so that terms
with equal counts stand together. A source's counts of a block are then a few runs, and two sources are compared run
by run: the boundaries of both are merged and the difference of the shares is multiplied by the run's length."""

from __future__ import annotations

import sys
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from werkbank.llm.common import stored, table

cloudpickle.register_pickle_by_value(sys.modules[__name__])

#: Documents that must hold a term, what is added to each count, and the ranks of terms that are returned.
LEAST, ADDED, TOP = 30, 5, 50
#: A share of one is a billion, in two factors, so that products stay within 64 bits.
FIRST, SECOND = 31_250, 32_000
#: About how many counts a block has, and how many sources of a language meet in one group.
COUNTS, TILE, LANES = 1 << 12, 64, 32
#: Counts that a task holds before it hands them on.
HELD = 1 << 19
#: A-Z become small; what is no a-z or beyond ASCII becomes a space.
KEPT = bytes(c + 32 if 65 <= c <= 90 else c if 97 <= c <= 122 or c >= 128 else 32 for c in range(256))


def term_counts(docs: DataFrame) -> DataFrame:
    """``lang``, ``source``, ``term``, ``docs`` (documents with the term) and ``n`` (its occurrences), summed. Each group
    has a row without a term too, so that groups without words are known."""
    schema = pa.schema([("lang", pa.string()), ("source", pa.string()), ("term", pa.string()), ("docs", pa.int64()),
                        ("n", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        having: dict[tuple, Counter] = {}
        times: dict[tuple, Counter] = {}

        def flush() -> pa.RecordBatch:
            groups = list(times)
            sizes = [len(times[g]) + 1 for g in groups]
            several = lambda i: pa.array(groups, pa.list_(pa.string(), 2)).flatten().take(pa.array(
                np.repeat(2 * np.arange(len(groups)) + i, sizes)))
            term = pa.array([t for g in groups for t in (None, *times[g])], pa.binary()).cast(pa.string())
            n = [x for g in groups for x in (0, *times[g].values())]
            found = [x for g in groups for x in (0, *(having[g][t] for t in times[g]))]
            return pa.RecordBatch.from_arrays([several(0), several(1), term, pa.array(found, pa.int64()),
                                               pa.array(n, pa.int64())], schema=schema)

        for batch in batches:
            for lang, source, text in zip(*(batch.column(i) for i in range(3))):
                group = (lang.as_py(), source.as_py())
                counts = Counter((text.as_py() or b"").translate(KEPT).split())
                if group not in times:
                    times[group], having[group] = Counter(), Counter()
                times[group].update(counts)
                having[group].update(counts.keys())
            if sum(map(len, times.values())) > HELD:
                yield flush()
                having, times = {}, {}
        if times:
            yield flush()

    rows = docs.select(F.coalesce(F.col("lang").cast("string"), F.lit("")).alias("lang"), F.coalesce(
        F.col("source").cast("string"), F.lit("")).alias("source"), F.col("text").cast("binary").alias("text"))
    counted = rows.mapInArrow(run, "lang string, source string, term string, docs long, n long")
    return counted.groupBy("lang", "source", "term").agg(F.sum("docs").alias("docs"), F.sum("n").alias("n"))


def share(count: Column | str, total: Column | str, size: Column | str) -> Column:
    """1 + floor(10^9 (count + 5) / (total + 5 size)), in whole numbers: the product is taken in two steps."""
    count, total, size = (F.col(c) if isinstance(c, str) else c for c in (count, total, size))
    whole = total + ADDED * size
    first = F.call_function("div", (count + ADDED) * SECOND, whole)
    rest = (count + ADDED) * SECOND % whole
    return 1 + first * FIRST + F.call_function("div", rest * FIRST, whole)


def shares(count: np.ndarray, total: int, size: int) -> np.ndarray:
    whole = total + ADDED * size
    if not whole:
        return np.ones(len(count), np.int64)
    first, rest = np.divmod((count + ADDED) * SECOND, whole)
    return 1 + first * FIRST + rest * FIRST // whole


def columns(term: np.ndarray, source: np.ndarray, n: np.ndarray) -> tuple[int, list[tuple[int, np.ndarray, np.ndarray]]]:
    """The number of terms, and of each source that has one the runs of its counts (their starts, from 0, and counts; a
    run goes on to the next start). Terms are ordered by the sources and counts they have, so that terms with equal
    counts are neighbours in every source."""
    order = np.lexsort((source, term))
    term, source, n = term[order], source[order], n[order]
    starts = np.flatnonzero(np.diff(term, prepend=-1))
    ends = [*starts[1:].tolist(), len(term)]
    rows = [(source[a:b].tolist(), n[a:b].tolist()) for a, b in zip(starts.tolist(), ends)]
    rank = np.empty(len(rows), np.int64)
    rank[sorted(range(len(rows)), key=rows.__getitem__)] = np.arange(len(rows))
    place = np.repeat(rank, np.diff([*starts, len(term)]))
    out = []
    order = np.lexsort((place, source))
    source, place, n = source[order], place[order], n[order]
    firsts = np.flatnonzero(np.diff(source, prepend=-1))
    for a, b in zip(firsts.tolist(), [*firsts[1:].tolist(), len(source)]):
        # Places without a count are runs of zeros: one begins after each place that the next does not follow.
        at = np.concatenate([[0], place[a:b], place[a:b] + 1])
        value = np.concatenate([[0], n[a:b], np.zeros(b - a, np.int64)])
        keep = np.concatenate([[place[a] > 0], np.ones(b - a, bool), np.append(np.diff(place[a:b]) > 1, place[b - 1] + 1 < len(rows))])
        at, value = at[keep], value[keep]
        sort = np.argsort(at, kind="stable")
        at, value = at[sort], value[sort]
        new = np.append(True, np.diff(value) != 0)
        out.append((int(source[a]), at[new], value[new]))
    return len(rows), out


def apart(size: int, a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray]) -> int:
    """The sum over ``size`` terms of the distance of two columns of runs (starts and shares): boundaries of both are
    merged, and each distance counts as often as its run is long."""
    at = np.union1d(a[0], b[0])
    one = a[1][np.searchsorted(a[0], at, "right") - 1]
    two = b[1][np.searchsorted(b[0], at, "right") - 1]
    return int((np.abs(one - two) * np.diff(np.append(at, size))).sum())


def run_columns(counts: DataFrame) -> DataFrame:
    """``lang``, ``block``, ``size`` (terms of the block), ``number`` (of the source), ``starts`` and ``runs`` from rows
    of ``lang``, ``block``, ``term``, ``number``, ``n``."""
    schema = pa.schema([("lang", pa.string()), ("block", pa.string()), ("size", pa.int64()), ("number", pa.int64()),
                        ("starts", pa.binary()), ("runs", pa.binary())])

    def run(key: tuple, rows: pa.Table) -> pa.Table:
        term = rows["term"].combine_chunks().dictionary_encode().indices.to_numpy(zero_copy_only=False).astype(np.int64)
        size, found = columns(term, rows["number"].to_numpy(), rows["n"].to_numpy())
        return pa.table([pa.array([key[0].as_py()] * len(found), pa.string()), pa.array([key[1].as_py()] * len(found), pa.string()),
                         pa.array([size] * len(found), pa.int64()), pa.array([s for s, _, _ in found], pa.int64()),
                         pa.array([a.astype(np.int64).tobytes() for _, a, _ in found], pa.binary()),
                         pa.array([v.astype(np.int64).tobytes() for _, _, v in found], pa.binary())], schema=schema)

    return counts.groupBy("lang", "block").applyInArrow(
        run, "lang string, block string, size long, number long, starts binary, runs binary")


def distances(every: DataFrame) -> DataFrame:
    """``lang``, ``a``, ``b`` (numbers of sources, the smaller first) and ``value``, summed over blocks, from a row per
    block and source of the language (``starts`` null: the block has no term of the source)."""
    schema = pa.schema([("lang", pa.string()), ("a", pa.int64()), ("b", pa.int64()), ("value", pa.int64())])

    def run(key: tuple, rows: pa.Table) -> pa.Table:
        size, held = rows["size"][0].as_py(), []
        for number, total, terms, starts, runs in zip(*(rows[c].to_pylist() for c in ("number", "total", "terms", "starts", "runs"))):
            at = np.zeros(1, np.int64) if starts is None else np.frombuffer(starts, np.int64)
            n = np.zeros(1, np.int64) if runs is None else np.frombuffer(runs, np.int64)
            held.append((number, (at, shares(n, total, terms))))
        one, two = key[2].as_py(), key[3].as_py()
        left = [h for h in held if h[0] // TILE == one]
        right = [h for h in held if h[0] // TILE == two]
        found = [(a, b, apart(size, x, y) if size else 0) for a, x in left for b, y in right if a < b]
        return pa.table([pa.array([key[0].as_py()] * len(found), pa.string()), *(pa.array(c, pa.int64()) for c in (
            zip(*found) if found else ([], [], [])))], schema=schema)

    # A column goes to each pair of tiles that its own is part of.
    own = F.floor(F.col("number") / TILE).cast("long")
    tiles = F.transform(F.sequence(F.lit(0).cast("long"), F.floor((F.col("sources") - 1) / TILE).cast("long")),
                        lambda t: F.struct(F.least(t, own).alias("one"), F.greatest(t, own).alias("two")))
    dealt = every.withColumn("_t", F.explode(tiles)).select("*", "_t.one", "_t.two").drop("_t")
    part = dealt.groupBy("lang", "block", "one", "two").applyInArrow(run, "lang string, a long, b long, value long")
    return part.groupBy("lang", "a", "b").agg(F.sum("value").alias("value"))


def _ranked(rows: DataFrame) -> DataFrame:
    order = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    return rows.withColumn("rank", F.row_number().over(order))


def source_divergence(docs: DataFrame, least: int = LEAST, top: int = TOP) -> DataFrame:
    """``lang``, ``source``, ``part``, ``item``, ``value`` and ``rank``. Part ``pair``: every other source of the language,
    the farthest first, with the sum over the kept terms of the distance of both shares. Part ``term``: the ``top`` terms
    that the source has more of than its language, with the distance of the shares. Kept are terms that at least ``least``
    documents of the language hold; shares are whole billionths, smoothed.

    Null language, source and text count as empty; documents without words make their group known, a language without
    kept terms has pairs of value 0; very long texts are counted whole; repeated rows are documents of their own; equal
    values are ranked by item. Other columns are ignored, an empty table gives an empty result.

    Counts are summed per task and per group before anything meets; blocks of the vocabulary have bounded size whatever
    the language's, and no group needs more than the columns of ``2 * TILE`` sources in one block."""
    counts = stored(term_counts(docs), "term_counts")
    words = counts.where("term is not null")
    vocabulary = words.groupBy("lang", "term").agg(F.sum("docs").alias("docs"), F.sum("n").alias("all"), F.count("*").alias(
        "rows")).where(F.col("docs") >= least).drop("docs")
    # Terms of equal frequency, or nearly so where it is high, are of one kind; kinds are cut into blocks of bounded size.
    kind = F.when(F.col("all") <= 64, F.col("all")).otherwise(64 + F.floor(8 * F.log2(F.col("all") / 64))).cast("long")
    vocabulary = stored(vocabulary.withColumn("kind", kind), "vocabulary")
    kinds = vocabulary.groupBy("lang", "kind").agg(F.ceil(F.sum("rows") / COUNTS).cast("long").alias("slices"))
    slice_ = F.pmod(F.xxhash64("term"), F.col("slices"))
    placed = vocabulary.join(kinds, ["lang", "kind"]).select("lang", "term", "all", F.concat_ws("/", "kind", slice_).alias("block"))
    kept = stored(words.join(placed, ["lang", "term"]).select("lang", "source", "term", "n", "all", "block"), "kept_counts")

    langs = vocabulary.groupBy("lang").agg(F.count("*").alias("terms"), F.sum("all").alias("lang_total"))
    totals = kept.groupBy("lang", "source").agg(F.sum("n").alias("total"))
    sources = counts.where("term is null").groupBy("lang").agg(F.count("*").alias("sources"))
    number = F.row_number().over(Window.partitionBy("lang").orderBy("source")).cast("long") - 1
    groups = (counts.where("term is null").select("lang", "source").join(sources, "lang").join(langs, "lang", "left")
              .join(totals, ["lang", "source"], "left").na.fill(0, ["terms", "lang_total", "total"]))
    groups = stored(groups.withColumn("number", number), "groups")

    runs = stored(run_columns(kept.join(groups.select("lang", "source", "number"), ["lang", "source"]).select(
        "lang", "block", "term", "number", "n")), "run_columns")
    # Each source has a column in each block, and in one of no terms, so that every pair appears.
    blocks = runs.select("lang", "block", "size").distinct().unionByName(
        sources.select("lang", F.lit("").alias("block"), F.lit(0).cast("long").alias("size")))
    lane = F.pmod(F.xxhash64("block"), F.lit(LANES))
    every = blocks.withColumn("lane", lane).join(groups.select("lang", "number", "sources", "terms", "total").withColumn(
        "lane", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(LANES - 1).cast("long")))), ["lang", "lane"]).drop("lane").join(
        runs.drop("size"), ["lang", "block", "number"], "left")
    far = distances(every)
    name = groups.select("lang", "number", "source")
    named = lambda frame, n, as_: frame.join(name.select("lang", F.col("number").alias(n), F.col("source").alias(as_)), ["lang", n])
    far = stored(named(named(far, "a", "source"), "b", "item").select("lang", "source", "item", "value"), "distances")
    pairs = far.unionByName(far.select("lang", F.col("item").alias("source"), F.col("source").alias("item"), "value"))

    stand = kept.join(groups.select("lang", "source", "total", "terms", "lang_total"), ["lang", "source"]).select(
        "lang", "source", F.col("term").alias("item"), (share("n", "total", "terms") - share("all", "lang_total", "terms")).alias("value"))
    terms = _ranked(stand.where("value > 0")).where(F.col("rank") <= top)
    out = _ranked(pairs).withColumn("part", F.lit("pair")).unionByName(terms.withColumn("part", F.lit("term")))
    return out.select("lang", "source", "part", "item", "value", "rank")


def op13_source_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return source_divergence(table(spark, sf_dir, "documents"))


OP13_SQL = r"""
WITH d AS (SELECT row_number() OVER () AS place, coalesce(lang, '') AS lang, coalesce(source, '') AS source, regexp_extract_all(translate(
         coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x40\x5B-\x60\x7B-\x7F]+') AS w FROM documents),
     g AS (SELECT DISTINCT lang, source FROM d),
     o AS (SELECT lang, source, term, count(*) AS n, count(DISTINCT place) AS docs
         FROM (SELECT place, lang, source, unnest(w) AS term FROM d) GROUP BY ALL),
     k AS (SELECT lang, term, sum(n) AS n FROM o GROUP BY lang, term HAVING sum(docs) >= 30),
     l AS (SELECT lang, count(*) AS v, sum(n) AS n FROM k GROUP BY lang),
     x AS (SELECT g.lang, g.source, k.term, coalesce(o.n, 0) AS c, k.n AS whole FROM g JOIN k USING (lang) LEFT JOIN o USING (lang, source, term)),
     s AS (SELECT lang, source, sum(c) AS n FROM x GROUP BY ALL),
     p AS (SELECT x.lang, x.source, x.term, c, 1 + (1000000000::HUGEINT * (c + 5)) // (s.n + 5 * l.v) AS p,
         1 + (1000000000::HUGEINT * (x.whole + 5)) // (l.n + 5 * l.v) AS q FROM x JOIN s USING (lang, source) JOIN l USING (lang)),
     f AS (SELECT a.lang, a.source, b.source AS item, sum(abs(a.p - b.p)) AS value FROM p a JOIN p b USING (lang, term)
         WHERE a.source <> b.source GROUP BY ALL),
     r AS (SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(value, 0)::BIGINT AS value FROM g a JOIN g b USING (lang)
         LEFT JOIN f ON f.lang = a.lang AND f.source = a.source AND f.item = b.source WHERE a.source <> b.source
         UNION ALL SELECT lang, source, 'term', term, (p - q)::BIGINT FROM p WHERE c > 0 AND p > q),
     n AS (SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item)::INTEGER AS rank FROM r)
SELECT lang, source, part, item, value, rank FROM n WHERE part = 'pair' OR rank <= 50
"""
