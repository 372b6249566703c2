"""A third of all rows under one key: the joins that carry rows are split at run time, and
the sums before joins leave nothing to split."""

import pytest
from helpers import erp, values
from pyspark.sql import functions as F

from werkbank.plans import documents, inventory, purchasing, support
from werkbank.sources.schemas import ERP, conform

SETTINGS = {
    "spark.sql.autoBroadcastJoinThreshold": "-1", "spark.sql.adaptive.autoBroadcastJoinThreshold": "-1",
    "spark.sql.shuffle.partitions": "24", "spark.sql.adaptive.advisoryPartitionSizeInBytes": "32KB",
    "spark.sql.adaptive.coalescePartitions.minPartitionSize": "16KB",
    "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "48KB",
    "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "2"}


@pytest.fixture()
def small_limits(spark):
    before = {k: spark.conf.get(k, None) for k in SETTINGS}
    for k, v in SETTINGS.items():
        spark.conf.set(k, v)
    yield
    for k, v in before.items():
        spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def final_plan(df):
    rows = df.collect()
    return df._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0], rows


@pytest.fixture(scope="module")
def purchases(spark, tmp_path_factory):
    folder = str(tmp_path_factory.mktemp("skew"))
    lines = spark.range(0, 120_000, 1, 12).selectExpr(
        "id AS BELEGP_ID", "if(id % 3 = 0, 'HOT', concat('P', id % 4001)) AS Belegnummer", "'B' AS Belegtyp",
        "concat('ME', id % 701) AS Artikelnummer", "concat('name ', id) AS Bezeichnung", "1 AS Menge", "1 AS EditMenge",
        "timestamp_ntz'2026-01-01 00:00:00' AS Datum", "'A' AS Zeilentyp")
    heads = spark.range(0, 4001, 1, 8).selectExpr("concat('P', id) AS Belegnummer", "'B' AS Belegtyp", "-1 AS UebernahmeOffen",
                                                  "'S' AS Name")
    heads = heads.union(spark.sql("SELECT 'HOT', 'B', -1, 'S'"))
    for name, df in (("beleg", heads), ("belegp", lines)):
        conform(df, ERP[name]).write.parquet(f"{folder}/{name}")
    return {**erp(spark), **{n: spark.read.parquet(f"{folder}/{n}") for n in ("beleg", "belegp")}}


def test_delivery_lines_are_split(spark, purchases, small_limits):
    plan, rows = final_plan(purchasing.delivery_lines(purchases))
    assert "skew=true" in plan and len(rows) == 120_000


def test_open_purchases_are_split(spark, purchases, small_limits):
    plan, rows = final_plan(inventory.open_purchases(purchases))
    assert "skew=true" in plan and sum(r["ordered_amount"] for r in rows) == 120_000


def test_common_predecessor_is_split(spark, tmp_path, small_limits):
    heads = spark.range(0, 60_000, 1, 12).selectExpr(
        "concat('L', id) AS Belegnummer", "'L' AS Belegtyp", "if(id % 3 = 0, 'M0', concat('M', id)) AS LieferBelegNr",
        "0 AS Status", "'' AS Vorlage", "'K1' AS Adressnummer", "timestamp_ntz'2026-01-01 00:00:00' AS AngelegtAm")
    middle = heads.selectExpr("replace(Belegnummer, 'L', 'M')", "'D'", "'O'", "2", "''", "'K1'", "AngelegtAm")
    original = heads.limit(1).selectExpr("'O'", "'A'", "CAST(NULL AS STRING)", "2", "''", "'K1'", "AngelegtAm")
    conform(heads.union(middle).union(original), ERP["beleg"]).write.parquet(str(tmp_path / "beleg"))
    tables = erp(spark, belegp=[dict(BELEGP_ID=1, Belegnummer="O", Belegtyp="A", Artikelnummer="CP1", Menge=2)])
    tables["beleg"] = spark.read.parquet(str(tmp_path / "beleg"))
    plan, rows = final_plan(documents.missing_components(tables))
    assert "skew=true" in plan and len(rows) == 60_000
    assert {(r["id"], int(r["count"])) for r in rows} == {("CP1", 2)}


def test_equal_texts_are_split_or_summed(spark, tmp_path, small_limits):
    spark.range(0, 60_000, 1, 12).selectExpr(
        "CAST(id AS STRING) AS message_id", "if(id % 3 = 0, 'same text', concat('text ', id)) AS body").write.parquet(
        str(tmp_path / "messages"))
    messages = spark.read.parquet(str(tmp_path / "messages"))
    settings = {"model": "m"}
    cache = messages.filter("message_id = '0'").select(
        support.translation_key(F.col("body"), settings).alias("cache_key"), F.lit("meme").alias("translated_text"))
    backlog = support.translation_backlog(messages, cache, settings)
    assert values(backlog.filter("cached"), "text", "messages") == [("same text", 20_000)]
    plan, rows = final_plan(support.translated_messages(messages, cache, settings))
    assert "skew=true" in plan and sum(r["translated"] == "meme" for r in rows) == 20_000
