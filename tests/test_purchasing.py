import pytest
from helpers import erp, values

from werkbank.plans import purchasing as P


@pytest.fixture(scope="module")
def deliveries(spark):
    head = lambda number, kind, name, state: dict(Belegnummer=number, Belegtyp=kind, Name=name, UebernahmeOffen=state)
    line = lambda number, sku, name, n, day, kind="B", role="A", price="42.75": dict(
        Belegnummer=number, Belegtyp=kind, Zeilentyp=role, Artikelnummer=sku, Bezeichnung=name, EditMenge=n, Datum=day,
        Einzelpreis=price, Gesamtpreis="200.00")
    return erp(spark, art=[
        dict(Artikelnummer="ME-16", ArtikelGruppe="ME", Bezeichnung="16GB DDR5 6000"),
        dict(Artikelnummer="CP-KF", ArtikelGruppe="CP", Bezeichnung="Intel Core i9-14900KF"),
        dict(Artikelnummer="CP-K", ArtikelGruppe="CP", Bezeichnung="Intel Core i9-14900K")],
        beleg=[head("P1", "B", "Supplier A", -2), head("P1", "R", None, 0), head("P2", "B", "Supplier A", 0),
               head("P3", "B", "Supplier B", 2), head("P4", "B", "Supplier A", None), head("P5", "R", None, 0)],
        belegp=[line("P1", "ME-16", "RAM", 10, "2026-11-01 00:00:00"), line("P1", "CP-KF", "CPU", 5, "2026-11-01 00:00:00"),
                line("P2", "CP-K", "CPU", 4, "2026-11-09 23:59:59"),
                line("P3", "ME-16", "RAM", 7, "2026-11-10 00:00:00", price=None),
                line("P4", "ME-16", "RAM", 99, "2026-11-11 00:00:00"),
                line("P5", "ME-16", "RAM", 1, "2026-11-11 00:00:00", kind="R"),
                line("P1", "ME-16", "note", 1, "2026-11-01 00:00:00", role="T")])


@pytest.mark.parametrize("filters,expected", [
    ({}, "P3 ME-16 received|P2 CP-K received|P1 CP-KF waiting|P1 ME-16 waiting"),
    (dict(status="waiting"), "P1 CP-KF waiting|P1 ME-16 waiting"),
    (dict(status="received"), "P3 ME-16 received|P2 CP-K received"),
    (dict(date_from="2026-11-01", date_to="2026-11-09", status="received", provider="Supplier A"), "P2 CP-K received"),
    (dict(date_from="2026-11-01", date_to="2026-11-01"), "P1 CP-KF waiting|P1 ME-16 waiting"),
    (dict(components=["CP-"]), "P2 CP-K received|P1 CP-KF waiting"),
    (dict(components=[dict(cpu_manufacturer="Intel", cpu_model="14900K")]), "P2 CP-K received"),
    (dict(components=[dict(ram_capacity=16, ram_ddr=5), "CP-"], provider="Supplier A", status="waiting"),
     "P1 CP-KF waiting|P1 ME-16 waiting"),
    (dict(components=[dict(ram_capacity=32)]), ""), (dict(components=["' OR 1=1 --"]), "")])
def test_deliveries(deliveries, filters, expected):
    got = values(P.incoming_deliveries(deliveries, **filters), "delivery_number", "component_sku", "status")
    assert got == [tuple(e.split()) for e in expected.split("|") if e]


def test_delivery_limit_and_prices(deliveries):
    assert values(P.incoming_deliveries(deliveries, limit=1, status="waiting"), "quantity", "truncated") == [(5, True)]
    rows = P.incoming_deliveries(deliveries, provider="supplier b").collect()
    assert rows[0]["price_per_item"] is None and rows[0]["price_overall"] == 200 and rows[0]["truncated"] is False
    with pytest.raises(ValueError):
        P.incoming_deliveries(deliveries, limit=0)
    with pytest.raises(ValueError):
        P.incoming_deliveries(deliveries, status="lost")


@pytest.fixture(scope="module")
def baskets(spark):
    head = lambda n, **more: {**dict(Belegnummer=n, Belegtyp="R", Vertreter=8, PLZ="1", Vertrag=0, Lager=100), **more}
    content = {"1": "A A B C extra", "2": "A B", "3": "A A", "4": "A B", "5": "A B", "6": "A B"}
    return erp(spark, beleg=[head("1"), head("2"), head("3"), head("4", Vertreter=23), head("5", Lager=1), head("6", Belegtyp="L")],
               belegp=[dict(Belegnummer=n, Belegtyp="R" if n != "6" else "L", Artikelnummer=s)
                       for n, skus in content.items() for s in skus.split()])


@pytest.mark.parametrize("skus,orders", [
    (["A"], "1 2 3"), (["A", "B"], "1 2"), (["A", "B", "C"], "1"), ([" a ", "B", "A"], "1 2"), (["unknown"], ""),
    (["' OR 1=1"], ""), ([f"U{i}" for i in range(60)], "")])
def test_co_purchase(baskets, skus, orders):
    assert values(P.co_purchase(baskets, skus), "order_number", sort=True) == orders.split()


def test_co_purchase_summary(baskets):
    got = P.co_purchase_summary(baskets, ["A"], 2).collect()[0]
    assert (got["matching_order_count"], got["sample_order_numbers"], got["order_numbers_truncated"]) == (3, ["1", "2"], True)
    none = P.co_purchase_summary(baskets, ["zzz"], 0).collect()[0]
    assert (none["matching_order_count"], none["sample_order_numbers"], none["order_numbers_truncated"]) == (0, [], False)
    for bad in ([], [" "], "A", [1]):
        with pytest.raises(ValueError):
            P.co_purchase(baskets, bad)
    with pytest.raises(ValueError):
        P.co_purchase_summary(baskets, ["A"], -1)


def test_co_purchase_pairs(spark, baskets):
    asked = spark.createDataFrame([("A", "B"), ("B", "A"), ("C", "A"), ("C", "nope"), ("A", "A"), ("extra", "B")],
                                  "sku_a string, sku_b string")
    assert values(P.co_purchase_pairs(baskets, asked), "sku_a", "sku_b", "order_count", sort=True) == [
        ("A", "B", 2), ("A", "C", 1), ("B", "extra", 1)]
    assert values(P.co_purchase_pairs(baskets, asked, 2), "sku_a") == ["A"]
