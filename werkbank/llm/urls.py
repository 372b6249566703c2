"""URL filters: rules of host and path, and gradient-boosted trees on lexical features for the rest.

Everything is a column expression or a fitted model of the machine-learning library; no Python runs on rows."""

from __future__ import annotations

from functools import reduce

from pyspark.ml.classification import GBTClassificationModel, GBTClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from werkbank.llm.common import stored, table

RULES = [("allow", "com", "/"), ("block", "example.com", "/en/"), ("allow", "www.example.com", "/en/"),
         ("block", "net", "/es/"), ("block", "net", "/fr/")]
#: Labelled URLs that the trees are fitted on, trees, their depth, and the weight of the overall share in a suffix's.
SAMPLE, TREES, DEPTH, SMOOTHING = 10_000, 20, 3, 10.0
#: Lanes that the URLs of one suffix are dealt over.
LANES = 32
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
DIGITS = "0123456789"
SIGNS = "-._~:/?#[]@!$&'()*+,;=%"
LEXICAL = ("length", "host_length", "path_length", "depth", "labels", "digits", "host_digits", "hyphens", "entropy",
           "parameters", "values", "fragment", "escapes", "secure", "longest_label")


def after_scheme(url: Column) -> Column:
    """What follows the first ``://``; empty without one."""
    return F.coalesce(F.get(F.split(url, "://", 2), F.lit(1)), F.lit(""))


def host_of(url: Column) -> Column:
    return F.translate(F.regexp_extract(after_scheme(url), "^([^/?#]*)", 1), UPPER, LOWER)


def path_of(url: Column) -> Column:
    return F.regexp_extract(after_scheme(url), "^[^/?#]*([^?#]*)", 1)


def decided(host: Column, path: Column, rules: list[tuple[str, str, str]]) -> Column:
    """The longest rule that fits, as a struct of ``rule`` and ``verdict``; null where none does. The rules are a
    short list, so they are one expression; of equally long ones the first counts."""
    out = F.lit(None).cast("struct<rule:string,verdict:string>")
    for verdict, name, start in sorted(rules, key=lambda r: len(r[1] + r[2])):
        fits = ((host == name) | host.endswith("." + name)) & path.startswith(start)
        out = F.when(fits, F.struct(F.lit(name + start).alias("rule"), F.lit(verdict).alias("verdict"))).otherwise(out)
    return out


def _count(text: Column, characters: str) -> Column:
    return F.length(text) - F.length(F.translate(text, characters, ""))


def _entropy(text: Column) -> Column:
    """Bits per character over small letters (capitals count as small), digits and the signs of URLs."""
    size = F.greatest(F.length(text), F.lit(1))
    parts = [F.when(n > 0, n / size * F.log2(size / n)).otherwise(0.0)
             for n in (_count(text, c + c.upper() if c.isalpha() else c) for c in LOWER + DIGITS + SIGNS)]
    return reduce(lambda a, b: a + b, parts)


def lexical(url: Column, host: Column, path: Column) -> dict[str, Column]:
    """Figures of a URL's spelling; those of a null URL are the empty text's."""
    url = F.coalesce(url, F.lit(""))
    query = F.regexp_extract(url, r"^[^?#]*\?([^#]*)", 1)
    share = lambda text: _count(text, DIGITS) / F.greatest(F.length(text), F.lit(1))
    found = (F.length(url), F.length(host), F.length(path), _count(path, "/"), _count(host, "."), share(url), share(host),
             _count(url, "-"), _entropy(url), F.when(query != "", _count(query, "&") + 1).otherwise(0), _count(query, "="),
             url.contains("#"), _count(url, "%"), url.startswith("https"),
             F.array_max(F.transform(F.split(host, r"\."), F.length)))
    return {name: value.cast("double") for name, value in zip(LEXICAL, found)}


def suffix_of(host: Column) -> Column:
    return F.substring_index(host, ".", -1)


def suffix_figures(labelled: DataFrame) -> tuple[DataFrame, float]:
    """Per suffix the logarithm of its labelled URLs and the share of blocked ones, drawn to the share of all; and
    that share. Counts are summed before they are shuffled."""
    overall = labelled.agg(F.sum(F.col("label") * F.col("times")) / F.sum("times")).first()[0]
    found = labelled.groupBy("suffix").agg(F.sum("times").alias("n"), F.sum(F.col("label") * F.col("times")).alias("blocked"))
    return found.select("suffix", F.log1p("n").alias("suffix_seen"), (
        (F.col("blocked") + SMOOTHING * overall) / (F.col("n") + SMOOTHING)).alias("suffix_blocked")), overall


def fitted(rows: DataFrame, seed: int = 0) -> GBTClassificationModel:
    return GBTClassifier(labelCol="label", featuresCol="features", weightCol="weight", maxIter=TREES, maxDepth=DEPTH,
                         seed=seed).fit(rows)


def url_verdicts(pages: DataFrame, rules: list[tuple[str, str, str]] | None = None, seed: int = 0) -> DataFrame:
    """All rows of ``pages`` with a struct ``_url``: ``host``, ``path``, ``rule`` and ``verdict`` (allow or block: the
    rule's, else that of the trees).

    URLs that a rule decides are the labelled ones. Figures of suffixes come from all of them; the trees are
    fitted on at most ``SAMPLE`` different ones, of each label half as many, those of smallest hash, weighted by how often they occur;
    both labels weigh the same, as how many URLs the rules block says nothing about the others. Where labels are of one
    kind only, their verdict holds for the rest, without any label it is allow. Null URLs have no host and no path and
    are judged like an empty text; very long URLs are read whole; equal URLs get equal verdicts; an empty table gives an
    empty result; other columns stay, whatever their names, but ``_url`` is replaced."""
    rules = RULES if rules is None else rules
    # The row travels as one column, so that no name of it can clash.
    pages = pages.drop("_url")
    rows = pages.select(F.struct(*[F.col(f"`{c}`") for c in pages.columns]).alias("row"), "url").select(
        "row", "url", host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path"))
    rows = rows.withColumns({"told": decided(F.col("host"), F.col("path"), rules), "suffix": suffix_of(F.col("host"))})
    # Equal URLs have equal labels, so they are one row with a count; a hot one is no more than a weight.
    labelled = stored(rows.where("told is not null").groupBy("url", "host", "path", "suffix").agg(
        F.first((F.col("told.verdict") == "block").cast("double")).alias("label"), F.count("*").alias("times")), "labelled_urls")
    seen = {r["label"]: r["times"] for r in labelled.groupBy("label").agg(F.sum("times").alias("times")).collect()}
    if len(seen) < 2:
        return _result(rows, F.lit("block" if 1.0 in seen else "allow"))
    figures, overall = suffix_figures(labelled)
    # A few suffixes hold most URLs: these are dealt over lanes by their hash, and each figure goes to all lanes.
    figures = figures.withColumn("lane", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(LANES - 1).cast("long"))))
    assembler = VectorAssembler(inputCols=[*LEXICAL, "suffix_seen", "suffix_blocked"], outputCol="features")

    def with_features(frame: DataFrame) -> DataFrame:
        dealt = frame.withColumn("lane", F.pmod(F.xxhash64("url"), F.lit(LANES)))
        joined = dealt.join(figures, ["suffix", "lane"], "left").withColumns({
            "suffix_seen": F.coalesce("suffix_seen", F.lit(0.0)), "suffix_blocked": F.coalesce("suffix_blocked", F.lit(overall))})
        return assembler.transform(joined.withColumns(lexical(F.col("url"), F.col("host"), F.col("path"))))

    # Of each label the URLs of smallest hash, so that neither crowds the other out; tasks hand on no more than is kept.
    sample = reduce(DataFrame.unionByName, [labelled.where(F.col("label") == label).orderBy(
        F.xxhash64("url", F.lit(seed)), "url").limit(SAMPLE // 2) for label in (0.0, 1.0)])
    sample = stored(with_features(sample).select("features", "label", F.col("times").cast("double").alias("weight")), "urls")
    drawn = {r["label"]: r["weight"] for r in sample.groupBy("label").agg(F.sum("weight").alias("weight")).collect()}
    balanced = sample.withColumn("weight", F.when(F.col("label") == 1, F.col("weight") * (drawn[0.0] / drawn[1.0])).otherwise(F.col("weight")))
    model = fitted(balanced, seed).setPredictionCol("verdict").setProbabilityCol("").setRawPredictionCol("")
    judged = model.transform(with_features(rows))
    return _result(judged, F.when(F.col("verdict") == 1, "block").otherwise("allow"))


def _result(rows: DataFrame, verdict: Column) -> DataFrame:
    return rows.select("row.*", F.struct("host", "path", "told.rule", F.coalesce("told.verdict", verdict).alias("verdict")).alias("_url"))


def op5_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages").select("page_id", "url")
    return url_verdicts(pages).select("page_id", "_url.*")
