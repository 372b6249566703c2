"""Document fingerprints by winnowing, with column expressions only.

A rolling hash runs over all runs of ``k`` words; of every ``window`` neighbouring ones the smallest is kept, the
rightmost of equal ones, with its position. Two texts that share ``window + k - 1`` words in a row share a fingerprint."""

from __future__ import annotations

from pyspark.ml.feature import Bucketizer
from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from werkbank.llm.common import id_or_last, table

#: Words of a hashed run, and runs of a window.
K, WINDOW = 5, 8
#: A word; longer ones are cut, so that a text without spaces has words too.
WORD = r"[^\x20\x09-\x0D]{1,16}"
#: Runs that are rolled from one summed run, so that arrays stay short while they grow.
ROLL = 64
#: Ranges that the rows of one very frequent id are cut in, by the hash of their text.
PARTS = 256
#: A hash keeps its upper 33 bits; below them stands its position, counted down, so that of equal hashes the
#: rightmost is the smallest.
PLACE = (1 << 31) - 1


def turned(x: Column, bits: int) -> Column:
    return F.shiftleft(x, bits % 64).bitwiseOR(F.shiftrightunsigned(x, -bits % 64))


def with_runs(rows: DataFrame, words: str, into: str, k: int) -> DataFrame:
    """``rows`` with the hashes of all runs of ``k`` words (of all words, if they are fewer) in ``into``.

    A cyclic polynomial: from run to run the hash is turned by one bit, the word that leaves is taken out and the
    one that enters is put in. Every ``ROLL`` runs it is summed anew, so each word costs the same in a long text."""
    names, change = f"{into}_names", f"{into}_change"
    moves = F.greatest(F.size(names) - k, F.lit(0))
    rows = rows.withColumn(names, F.transform(words, lambda word: F.xxhash64(word)))
    rows = rows.withColumn(change, F.zip_with(
        F.slice(names, F.lit(1), moves), F.slice(names, F.lit(k + 1), moves),
        lambda leaves, enters: turned(leaves, k).bitwiseXOR(enters)))

    def piece(first: Column) -> Column:
        summed = F.aggregate(F.slice(names, first, F.lit(k)), F.lit(0).cast("long"),
                             lambda run, word: turned(run, 1).bitwiseXOR(word))
        return F.aggregate(F.slice(change, first, F.lit(ROLL - 1)), F.array(summed), lambda runs, step: F.concat(
            runs, F.array(turned(F.element_at(runs, F.lit(-1)), 1).bitwiseXOR(step))))

    firsts = F.sequence(F.lit(1), F.size(change) + 1, F.lit(ROLL))
    return rows.withColumn(into, F.when(F.size(names) == 0, F.array().cast("array<long>")).otherwise(
        F.flatten(F.transform(firsts, piece)))).drop(names, change)


def with_prints(rows: DataFrame, text: str, into: str, k: int = K, window: int = WINDOW) -> DataFrame:
    """``rows`` with the fingerprint of ``text`` as numbers of hash and position in ``into``. Texts of fewer words
    than a run have the hash of all of them, texts without words (and null) none."""
    words, runs = f"{into}_words", f"{into}_runs"
    rows = rows.withColumn(words, F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(WORD), F.lit(0)))
    rows = with_runs(rows, words, runs, k).withColumn(runs, F.transform(runs, lambda run, i: run.bitwiseAND(
        ~PLACE).bitwiseOR(F.lit(PLACE).cast("long") - i)))
    m = F.size(runs)
    least = F.transform(F.sequence(F.lit(1), m - window + 1), lambda i: F.array_min(F.slice(runs, i, window)))
    return rows.withColumn(into, F.when(m == 0, F.col(runs)).when(m <= window, F.array(F.array_min(runs))).otherwise(
        F.array_distinct(least))).drop(words, runs)


def hashes(prints: str) -> Column:
    return F.array_distinct(F.transform(prints, lambda x: F.shiftright(x, 31)))


def positions(prints: str) -> Column:
    """Hash and first word of each fingerprint of a text."""
    return F.transform(prints, lambda x: F.struct(F.shiftright(x, 31).alias("hash"), (
        F.lit(PLACE).cast("long") - x.bitwiseAND(PLACE)).alias("word")))


def digest(found: str) -> Column:
    return F.md5(F.array_join(F.transform(F.array_sort(found), lambda x: x.cast("string")), ",").cast("binary"))


def likeness(a: str, b: str) -> Column:
    """Shared hashes among those of both (Jaccard); two texts without any are alike."""
    common = F.size(F.array_intersect(a, b))
    both = F.size(a) + F.size(b) - common
    return F.when(both == 0, 1.0).otherwise(common / both)


def in_order(docs: DataFrame) -> DataFrame:
    """``docs`` with ``_bucket`` (ranges of ascending doc_id) and ``_order`` (the order in them). Rows without an id
    come last. They, and the rows of an id on which two borders fall, are cut in ranges of the hash of their text.

    Borders are quantiles of the ids: four buckets per shuffle partition, found in one aggregate."""
    n = 4 * int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ids = id_or_last().cast("double")
    cuts = docs.where("doc_id is not null").agg(F.percentile_approx(ids, [i / n for i in range(1, n)], 100 * n)).first()[0] or []
    borders = [float("-inf"), *sorted(set(cuts)), float("inf")]
    if len(borders) < 3:
        borders.insert(1, 0.0)
    # Beyond 2 ** 53 a border stands for several ids.
    crowded = [int(c) for c, after in zip(cuts, cuts[1:]) if c == after and abs(c) < 2 ** 53]
    part = F.shiftrightunsigned(F.xxhash64("text").bitwiseXOR(F.lit(-1 << 63)), 64 - (PARTS - 1).bit_length())
    # A crowded id is the border that its bucket begins with: its parts stand before all other rows there.
    within = F.when(F.col("doc_id").isNull() | F.col("doc_id").cast("long").isin(crowded), part).otherwise(PARTS)
    named = Bucketizer(splits=borders, inputCol="_value", outputCol="_bucket").transform(docs.withColumn("_value", ids))
    bucket = F.when(F.col("doc_id").isNull(), len(borders)).otherwise(F.col("_bucket").cast("int"))
    return named.drop("_value").withColumns({
        "_bucket": (bucket * (PARTS + 1) + within).cast("int"),
        "_order": F.struct(id_or_last().alias("id"), F.xxhash64("text").alias("hash"))})


def edited_fingerprints(docs: DataFrame, k: int = K, window: int = WINDOW) -> DataFrame:
    """Per row ``doc_id``, ``text``, ``edited`` (the text whose last half of code points gives way to the first as
    many of the next document, in ascending doc_id; the first follows the last), ``prints``, ``edited_prints`` and
    ``next_prints`` (hashes of the three texts), ``positions`` (hash and word of each fingerprint of the text).

    Null texts count as empty. Whole texts are hashed, whatever their length; the cost of a word does not grow with it. Rows of one id (or none) follow each other by the hash of their text; repeated rows
    too. A single row follows itself; an empty table gives an empty result; other columns are ignored.

    Rows are dealt once, by ranges of ids; the next document is the next row of the range. At the end of each range
    stands a copy of the first row of the next one."""
    rows = in_order(docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")))
    firsts = rows.groupBy("_bucket").agg(F.min("_order").alias("_order"))
    # One row per range, of which there are a fixed number.
    ring = Window.orderBy("_bucket")
    firsts = firsts.select("_order", F.coalesce(F.lag("_bucket").over(ring), F.max("_bucket").over(
        ring.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))).alias("_before"))
    copies = (rows.drop("_bucket").join(F.broadcast(firsts), "_order").groupBy("_order", "_before").agg(
        F.first("doc_id").alias("doc_id"), F.first("text").alias("text")))
    rows = rows.withColumn("_copy", F.lit(False)).unionByName(
        copies.withColumnRenamed("_before", "_bucket").withColumn("_copy", F.lit(True)))
    rows = with_prints(rows, "text", "_prints", k, window)
    order = Window.partitionBy("_bucket").orderBy("_copy", "_order")
    rows = rows.withColumns({"_next": F.lead("text").over(order), "_after": F.lead("_prints").over(order)}).where("not _copy")
    half = F.floor(F.length("text") / 2).cast("int")
    rows = rows.withColumn("edited", F.concat(F.substring("text", F.lit(1), F.length("text") - half),
                                              F.substring("_next", F.lit(1), half)))
    rows = with_prints(rows, "edited", "_edited", k, window)
    return rows.select("doc_id", "text", "edited", hashes("_prints").alias("prints"), hashes("_edited").alias("edited_prints"),
                       hashes("_after").alias("next_prints"), positions("_prints").alias("positions"))


def op8_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = edited_fingerprints(table(spark, sf_dir, "documents"))
    return found.select(
        "doc_id", F.length("text").cast("long").alias("n_chars"), F.sha2("edited", 256).alias("edited_sha256"),
        digest("prints").alias("fingerprint"), digest("edited_prints").alias("edited_fingerprint"),
        likeness("prints", "edited_prints").alias("near_edited"), likeness("prints", "next_prints").alias("near_next"),
        F.col("positions.hash").alias("hashes"), F.col("positions.word").alias("words"))
