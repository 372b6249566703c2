from helpers import erp, table, values

from werkbank.plans.inventory import component_chart
from werkbank.plans.support import evolve
from werkbank.sources.erp import load_erp
from werkbank.sources.schemas import BELEG, DRAFTS, ERP, PRECEDENTS
from werkbank.sources.support import load_precedents


def test_erp_round_trip(spark, tmp_path):
    tables = erp(spark, art=[dict(Artikelnummer="000123", EANNummer=None)],
                 beleg=[dict(Belegnummer="R1", EuroBrutto="10.50", AngelegtAm="2026-01-02 03:04:05", Status="2")])
    for name, df in tables.items():
        df.write.parquet(str(tmp_path / f"{name}.parquet"))
    loaded = load_erp(spark, str(tmp_path))
    assert {n: df.schema.simpleString() for n, df in loaded.items()} == {n: s.simpleString() for n, s in ERP.items()}
    assert values(loaded["art"], "Artikelnummer", "EANNummer") == [("000123", None)]
    assert values(loaded["beleg"], "Status", "UebernahmeOffen") == [(2, None)]


def test_text_that_is_no_time_is_null(spark):
    assert values(table(spark, BELEG, [dict(Belegnummer="1", AngelegtAm="soon")]), "AngelegtAm") == [None]


def test_filters_reach_the_scan(spark, tmp_path):
    from werkbank.plans.sales import analyze_sales

    spark.conf.set("spark.sql.maxMetadataStringLength", "5000")
    spark.conf.set("spark.sql.debug.maxToStringFields", "100")
    tables = erp(spark, beleg=[dict(Belegnummer="R1", Belegtyp="R")])
    tables["beleg"].write.parquet(str(tmp_path / "beleg"))
    tables["beleg"] = spark.read.parquet(str(tmp_path / "beleg"))
    plan = analyze_sales(tables, ["revenue"], ["year"], date_from="2026-01-01")._jdf.queryExecution().executedPlan().toString()
    scan = next(line for line in plan.splitlines() if "PushedFilters" in line)
    read = scan.split("ReadSchema:")[1]
    assert "EqualTo(Belegtyp,R)" in scan and "GreaterThanOrEqual(AngelegtAm" in scan
    assert "EuroBrutto" in read and "Strasse" not in read and "ErloesEuro" not in read


def test_precedents_and_evolution(spark, tmp_path):
    raw = spark.createDataFrame([(1, "T1", [0.5, 1.0])], "chunk_id int, ticket_id string, vector array<double>")
    raw.write.parquet(str(tmp_path / "precedents.parquet"))
    loaded = load_precedents(spark, str(tmp_path))
    assert loaded.schema.simpleString() == PRECEDENTS.simpleString() and values(loaded, "status") == [None]
    old = spark.createDataFrame([("1", "m")], "ticket_id string, based_on_message_id string")
    new = evolve(old, DRAFTS, {"prompt_version": ""})
    assert new.columns == DRAFTS.names and values(new, "prompt_version", "response_json") == [("", None)]


def test_component_chart(spark):
    sold = spark.createDataFrame([("A", "a", "2026-01-01", 2), ("B", "b", None, 3)], "sku string, name string, period string, sold_amount int")
    assert values(component_chart(sold), "x", "y", "series", sort=True) == [
        ("2026-01-01", 2.0, "A - a"), ("B - b", 3.0, "B - b")]


def test_stored_tables_are_packed(spark, tmp_path, monkeypatch):
    """What a plan stores, and the relations that ``stored_relations`` writes, are packed with zstd: fewer bytes for the same rows."""
    from werkbank import registry
    from werkbank.operators import stored

    rows = spark.range(5000).selectExpr("id", "concat('Item ', id % 97) AS name")
    monkeypatch.setattr(stored, "scratch", lambda spark, name="run": f"{tmp_path}/{name}")
    assert sorted(stored.stored(rows, "packed").collect()) == sorted(rows.collect())
    monkeypatch.setattr(registry, "_scratch", lambda spark: f"{tmp_path}/relations")
    registry.QUERIES["stored_relations"](spark, "/root/testdata/sf0.001")
    files = [f.name for f in tmp_path.rglob("part-*")]
    assert files and all(name.endswith(".zstd.parquet") for name in files)
    assert {p.name for p in (tmp_path / "relations").iterdir()} == {f"{n}.parquet" for n in registry.schemas.ERP}
