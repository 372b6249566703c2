from datetime import date, datetime
from decimal import Decimal

import pytest
from helpers import erp, table, values
from pyspark.sql import functions as F

from werkbank.functions.predicates import article_arguments, article_predicate
from werkbank.plans import inventory as I
from werkbank.sources.schemas import ART

NAMES = {
    "CP1": "AMD Ryzen 9 9900X", "CP2": "Intel Core i9-14900K", "CP3": "Intel Core i9-14900KF",
    "CP4": "Intel Core Ultra 9 285K Tray", "CP5": "intel core i5-14400", "TW1": "CoolerMaster Elite 302",
    "TW2": "CoolerMaster Elite 302 TG", "TW3": "CoolerMaster Elite 3020", "GC1": "Geforce RTX 5080 16GB",
    "GC2": "Quadro P1000 2048MB", "GC3": "Nvidia T400 1024MB", "GC4": "Radeon RX 7700 12GB",
    "ME1": "16GB DDR5 6000", "ME2": "116GB DDR4 3200", "HD1": "1000Gb SSD X", "HD2": "1000Gb HDD X", "HD3": "500Gb SSD",
    "MB1": "50%_[x]\\board", "MB2": "50 and board"}


@pytest.fixture(scope="module")
def art(spark):
    rows = [dict(Artikelnummer=k, Bezeichnung=v, ArtikelGruppe=k[:2], EANNummer="0012" if k == "CP1" else None,
                 HstArtikelnummer="Ab-1" if k == "CP2" else None) for k, v in NAMES.items()]
    return table(spark, ART, rows).cache()


@pytest.mark.parametrize("attributes,found", [
    (dict(ean=" 0012 "), "CP1"), (dict(producer_ean="ab-1"), "CP2"), (dict(sku="p1"), "CP1"),
    (dict(cpu_manufacturer="Intel", cpu_generation=9, cpu_model="14900k"), "CP2"),
    (dict(cpu_manufacturer="Intel", cpu_model="14900KF"), "CP3"),
    (dict(cpu_manufacturer="Intel", cpu_model="285K"), "CP4"),
    (dict(cpu_manufacturer="Intel", cpu_generation=9), "CP2 CP3"),
    (dict(cpu_manufacturer="Intel"), "CP2 CP3 CP4 CP5"), (dict(cpu_manufacturer="AMD"), "CP1"),
    (dict(cpu_manufacturer="AMD", cpu_model="9900X"), "CP1"), (dict(cpu_manufacturer="AMD", cpu_model="9900"), ""),
    (dict(case_manufacturer="COOLERMASTER"), "TW1 TW2 TW3"),
    (dict(case_manufacturer="coolermaster", case_model=" elite 302 "), "TW1 TW2"),
    (dict(gpu_series="Quadro"), "GC1 GC2 GC3"), (dict(gpu_manufacturer="AMD"), "GC4"),
    (dict(gpu_vram=16), "GC1"), (dict(gpu_vram=2), "GC2"), (dict(gpu_vram=1), "GC3"),
    (dict(gpu_manufacturer="NVIDIA", gpu_model="5080"), "GC1"),
    (dict(ram_capacity=16, ram_ddr=5), "ME1"), (dict(ram_capacity=16, ram_ddr=4), ""), (dict(ram_speed=3200), "ME2"),
    (dict(hdd_type="SSD"), "HD1 HD3"), (dict(hdd_type="HDD", hdd_capacity=1000), "HD2"),
    (dict(hdd_capacity=1000), "HD1 HD2 HD3"),
    (dict(item_name="50%board"), "MB1 MB2"), (dict(item_name="[x]\\"), "MB1"), (dict(item_name="x' OR 1=1 --"), ""),
])
def test_article_predicate(art, attributes, found):
    assert values(art.filter(article_predicate(**attributes)), "Artikelnummer", sort=True) == found.split()


@pytest.mark.parametrize("bad", [
    {}, dict(ean=" "), dict(ean=12), dict(category="ME", cpu_manufacturer="AMD"), dict(gpu_model="5080"),
    dict(gpu_series="Radeon", gpu_manufacturer="NVIDIA"), dict(cpu_model="14900K"), dict(cpu_generation=9),
    dict(cpu_manufacturer="AMD", cpu_model="K9"), dict(cpu_manufacturer="AMD", cpu_generation=0),
    dict(case_model="Elite 302"), dict(case_manufacturer="Nobody"), dict(colour="red"),
    dict(case_manufacturer="NZXT", case_model="Elite 302")])
def test_article_arguments_raise(bad):
    with pytest.raises(ValueError):
        article_arguments(**bad)


def test_attributes_and_cases(art):
    rows = {r["sku"]: r for r in I.article_attributes(art).collect()}
    assert (rows["CP4"]["cpu_manufacturer"], rows["CP4"]["cpu_generation"], rows["CP4"]["cpu_model"]) == ("Intel", 9, "285K")
    assert (rows["CP1"]["cpu_manufacturer"], rows["CP1"]["cpu_model"]) == ("AMD", "9900X")
    assert (rows["GC2"]["gpu_vram"], rows["GC4"]["gpu_manufacturer"], rows["HD2"]["hdd_type"]) == (2, "AMD", "HDD")
    assert rows["MB1"]["cpu_model"] is None and rows["ME1"]["ram_speed"] == 6000
    cases = {r["sku"]: r for r in I.canonical_case(art).collect()}
    assert cases["TW2"]["case_model"] == "Elite 302" and cases["TW1"]["listed"] and not cases["TW3"]["listed"]


AS_OF = datetime(2026, 6, 1, 12)


def stock(spark):
    item = lambda sku, name: dict(Artikelnummer=sku, Bezeichnung=name, ArtikelGruppe="CP")
    lot = lambda i, sku, kind="S": dict(Id=i, Artikelnummer=sku, SCTyp=kind)
    units = lambda i, n, value, at="2026-01-01 00:00:00": dict(IdSerie=i, Bestand=n, Wert=value, AngelegtAm=at)
    buy = lambda number, sku, n, kind="B": dict(Belegnummer=number, Belegtyp=kind, Artikelnummer=sku, Menge=n)
    head = lambda number, state, kind="B": dict(Belegnummer=number, Belegtyp=kind, UebernahmeOffen=state)
    return erp(spark, art=[item("A", "AMD Ryzen 9 1"), item("B", "AMD Ryzen 9 2"), item("C", "AMD Ryzen 9 3"),
                           item("Z", "AMD Ryzen 5 9")],
               serie=[lot(1, "A"), lot(2, "A"), lot(3, "A", "O"), lot(4, "B"), lot(5, "C")],
               lagerp=[units(1, 2, 10), units(1, 1, 40), units(2, 3, 10), units(2, 0, 99), units(3, 9, 1),
                       units(1, 5, 7, "2000-01-01 00:00:00"), units(4, 1, 0), units(5, 0, 5)],
               beleg=[head("P1", -1), head("P2", 0), head("P3", None), head("P1", -1, "R")],
               belegp=[buy("P1", "A", 4), buy("P1", "A", "0.5"), buy("P1", "B", 7), buy("P2", "A", 50),
                       buy("P3", "A", 60), buy("P1", "A", 70, "R"), buy("P1", "C", 3)])


def test_search_inventory(spark):
    got = I.search_inventory(stock(spark), AS_OF, cpu_manufacturer="AMD", cpu_generation=9)
    columns = ("sku", "item_count", "minimum_price", "maximum_price", "average_price", "ordered_amount")
    # B has stock of no value, so its open purchases are not shown; C has no units
    assert values(got, *columns, sort=True) == [("A", 6, 10, 40, 20.0, Decimal("4.5")), ("B", 1, 0, 0, 0.0, None)]


def test_stock_by_sku(spark):
    t = erp(spark, art=[dict(Artikelnummer="CP00001"), dict(Artikelnummer="ME00002")],
            serie=[dict(Id=1, Artikelnummer="ME00002", SCTyp="O")], lagerp=[dict(IdSerie=1, Bestand=6)])
    wanted = spark.createDataFrame([("cp00001",), ("me00002 ",), ("UNKNOWN",), ("cp00001",)], "sku string")
    assert values(I.stock_by_sku(t, wanted), "sku", "current_stock", sort=True) == [("cp00001", 0), ("me00002", 6)]
    assert values(I.unknown_skus(t, wanted), "sku") == ["UNKNOWN"]


SOLD = [("CP1", "2.5", "2025-12-31"), ("CP1", "-0.5", "2026-01-04"), ("CP1", "4", "2026-01-05"),
        ("CP1", "3", "2027-01-05"), ("CP2", "8", "2026-01-04")]


@pytest.mark.parametrize("grain,expected", [
    ("day", "CP1 2025-12-31 2.5|CP1 2026-01-04 -0.5|CP1 2026-01-05 4|CP1 2027-01-05 3|CP2 2026-01-04 8"),
    ("week", "CP1 2025-12-29 2|CP1 2026-01-05 4|CP1 2027-01-04 3|CP2 2025-12-29 8"),
    ("month", "CP1 2025-12-01 2.5|CP1 2026-01-01 3.5|CP1 2027-01-01 3|CP2 2026-01-01 8"),
    ("year", "CP1 2025-01-01 2.5|CP1 2026-01-01 3.5|CP1 2027-01-01 3|CP2 2026-01-01 8"),
    ("total", "CP1 None 9|CP2 None 8")])
def test_component_sales(spark, grain, expected):
    t = erp(spark, art=[dict(Artikelnummer=s, Bezeichnung=s, ArtikelGruppe="CP") for s in ("CP1", "CP2")],
            belegp=[dict(Belegtyp="R", Artikelnummer=s, Menge=n, Datum=f"{d} 23:59:59") for s, n, d in SOLD]
            + [dict(Belegtyp="L", Artikelnummer="CP1", Menge=99, Datum="2026-01-05 00:00:00"),
               dict(Belegtyp="R", Artikelnummer="CP1", Menge=99, Datum="2027-01-06 00:00:00")])
    got = I.component_sales(t, "2025-12-31", date(2027, 1, 5), grain, category="CP")
    rows = sorted((r["sku"], str(r["period"]), r["sold_amount"]) for r in got.collect())
    assert rows == [(s, p, Decimal(n)) for s, p, n in (e.split() for e in expected.split("|"))]


def test_component_sales_needs_dates_and_a_filter(spark):
    t = erp(spark)
    for arguments in (dict(date_from=None, date_to="2026-01-01", category="CP"),
                      dict(date_from="2026-01-01", date_to="2026-01-02")):
        with pytest.raises(ValueError):
            I.component_sales(t, **arguments)


def test_forecast_formula(spark):
    usage = lambda stock: spark.createDataFrame([("A", 8, 4, 4, stock, 0)], "sku string, u1 int, u2 int, u3 int, stock int, incoming int")
    shown = lambda stock, weeks: values(I.forecast_demand(usage(stock), weeks), "weekly_forecast", "stock_coverage")
    assert shown(0, 1) == [(1.5, 1.5)] and shown(0, 2) == [(3.0, 3.0)] and shown(2, 1) == []
    for weeks in (0, 53):
        with pytest.raises(ValueError):
            shown(0, weeks)


def test_forecast_and_snapshots(spark, tmp_path):
    line = lambda sku, n, day, kind="R": dict(Belegtyp=kind, Belegnummer="1", Artikelnummer=sku, Menge=n, Datum=f"{day} 12:00:00")
    t = erp(spark, art=[dict(Artikelnummer=s, Bezeichnung=f"name {s}", ArtikelGruppe="CP" if s != "X" else "ZZ")
                        for s in ("A", "B", "X")],
            belegp=[line("A", 8, "2026-06-20"), line("A", 4, "2026-05-03"), line("A", 4, "2026-04-05"),
                    line("A", 90, "2026-03-08"), line("B", 1, "2026-05-30"), line("X", 50, "2026-05-30"),
                    line("A", 1, "2026-05-01", "B")],
            beleg=[dict(Belegnummer="1", Belegtyp="B", UebernahmeOffen=-1)],
            serie=[dict(Id=1, Artikelnummer="A", SCTyp="O")], lagerp=[dict(IdSerie=1, Bestand="0.25")])
    got = I.forecast_components(t, AS_OF)
    assert values(got, "sku", "weekly_forecast", "stock_coverage") == [("A", 1.5, 0.25)]
    path = str(tmp_path / "snapshots")
    I.save_forecast(got, path, AS_OF, 1)
    later = got.withColumn("stock_coverage", F.lit(9.0)).unionByName(
        got.withColumn("sku", F.lit("B")).withColumn("stock_coverage", F.lit(10.0)))
    I.save_forecast(got, path, AS_OF.replace(hour=15), 1)
    I.save_forecast(later, path, AS_OF.replace(hour=15), 1)  # repeated run
    I.save_forecast(got, path, AS_OF.replace(hour=18), 2)
    stored = spark.read.parquet(path)
    assert values(I.latest_forecast(stored, AS_OF.date(), 1), "sku", "stock_coverage") == [("B", 10.0), ("A", 9.0)]
    assert I.latest_forecast(stored, date(2026, 1, 1), 1).count() == 0
    assert stored.select("run_date", "weeks").distinct().count() == 2


def test_forecasts_share_their_facts(spark):
    """Three days and two horizons from facts that are stored once: the rows of each forecast from the tables, whose lines no
    forecast reads again."""
    line = lambda sku, n, day, kind="R": dict(Belegtyp=kind, Belegnummer="1", Artikelnummer=sku, Menge=n, Datum=day)
    days = ["2026-06-20 12:00:00", "2026-05-31 08:00:00", "2026-05-03 00:00:00", "2026-04-05 00:00:01", "2026-03-09 00:00:00", None]
    t = erp(spark, art=[dict(Artikelnummer=s, Bezeichnung=f"name {s}", ArtikelGruppe="CP") for s in "ABC"],
            belegp=[line(s, n, day) for s in "ABC" for day in days for n in (3, None, 4 if s == "A" else 1)] + [
                line("A", 1, "2026-05-01 00:00:00", "B"), line("B", None, "2026-05-30 00:00:00")],
            beleg=[dict(Belegnummer="1", Belegtyp="B", UebernahmeOffen=-1)],
            serie=[dict(Id=1, Artikelnummer="A", SCTyp="O")], lagerp=[dict(IdSerie=1, Bestand="0.25"), dict(IdSerie=1, Bestand=None)])
    from datetime import timedelta

    facts = I.forecast_facts(t, AS_OF - timedelta(days=2))
    for as_of in (AS_OF - timedelta(days=2), AS_OF, AS_OF.replace(hour=15)):
        for weeks in (1, 4):
            shared, alone = (I.forecast_components(x, as_of, weeks) for x in (facts, t))
            assert sorted(map(tuple, shared.collect())) == sorted(map(tuple, alone.collect())) != []
            assert "Belegtyp" not in shared._jdf.queryExecution().optimizedPlan().toString()


def test_latest_forecast_reads_lines_for_all_its_runs_together(spark, monkeypatch):
    from werkbank import registry

    built, saved = [], []
    real = registry.inventory.forecast_facts, registry.inventory.save_forecast
    monkeypatch.setattr(registry.inventory, "forecast_facts", lambda *a: built.append(a) or real[0](*a))
    monkeypatch.setattr(registry.inventory, "save_forecast", lambda *a: saved.append(a[2:]) or real[1](*a))
    registry.QUERIES["latest_forecast"](spark, "/root/testdata/sf0.001")
    assert len(built) == 1 and len(saved) == 4
