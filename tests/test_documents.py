import pytest
from helpers import erp, table, values

from werkbank.plans import documents as D
from werkbank.sources.schemas import BELEG, BELEGP, MITARBW


def line(i, number, kind, sku, line_type, quantity=1, price=0, name=None):
    return dict(BELEGP_ID=i, Belegnummer=number, Belegtyp=kind, Artikelnummer=sku, Zeilentyp=line_type,
                Menge=quantity, KalkpreisEuro=price, Bezeichnung=name or sku)


LINES = [
    line(1, "RA1", "R", "PC001", "H"), line(2, "RA1", "R", "CP001", "K"), line(3, "RA1", "R", "ME001", "K"),
    line(4, "RA1", "R", "AR001", "A"), line(5, "RA1", "R", "CP009", "K"),
    line(6, "RA1", "R", "PC002", "H"), line(7, "RA1", "R", "CP002", "K"),
    line(8, "RA2", "R", "CP003", "K"), line(9, "LA3", "B", "XX", "H"),
]


def test_items_and_rejects(spark):
    for pieces in (1, 3):
        lines = table(spark, BELEGP, LINES)
        items = D.order_items(lines, pieces)
        assert values(items, "document_number", "position", "sku", "parent_line_id", sort=True) == [
            ("RA1", 1, "PC001", None), ("RA1", 2, "CP001", 1), ("RA1", 3, "ME001", 1), ("RA1", 4, "AR001", None),
            ("RA1", 6, "PC002", None), ("RA1", 7, "CP002", 6)]
        assert values(D.order_item_rejects(lines, pieces), "sku", sort=True) == ["CP003", "CP009"]


def test_one_grain_for_any_length(spark):
    """A PC of 1500 components and one of two: the same columns, every component with its PC."""
    long = [line(1, "RA1", "R", "PC1", "H")] + [line(i, "RA1", "R", f"CP{i}", "K") for i in range(2, 1502)]
    short = [line(2001, "RA2", "R", "PC2", "H"), line(2002, "RA2", "R", "CP1", "K"), line(2003, "RA2", "R", "CP2", "K")]
    head = lambda number: dict(Belegnummer=number, Belegtyp="R", Status=0, EuroBrutto="100", AngelegtAm="2026-01-01 00:00:00")
    rows = D.order_360(erp(spark, beleg=[head("RA1"), head("RA2")], belegp=long + short)).collect()
    of = lambda number: sorted((r for r in rows if r["document_number"] == number), key=lambda r: r["position"])
    assert [len(of("RA1")), len(of("RA2"))] == [1501, 3]
    for number, pc in (("RA1", 1), ("RA2", 2001)):
        first, *parts = of(number)
        assert first["line_type"] == "H" and first["parent_line_id"] is None
        assert {p["parent_line_id"] for p in parts} == {pc}
        assert {r["selling_price"] for r in of(number)} == {100}


def test_order_360(spark):
    base = dict(Belegnummer="RA1", Belegtyp="R", Status=0, Name=" Doe ", Vorname="Ann", Vertreter=8,
                IhrAuftrag="0012", EuroBrutto="100.50", AngelegtAm="2026-01-01 10:00:00")
    tables = erp(spark, beleg=[
        {**base, "AngelegtAm": "2025-01-01 10:00:00", "Name": "Old"}, base,
        dict(Belegnummer="BX", Belegtyp="B", Status=0, AngelegtAm="2026-01-01 00:00:00", Vertreter=77)],
        belegp=LINES, mitarbw=[dict(Nr=8, Name="Shop")])
    found = D.order_360(tables).collect()
    rows = {r["document_number"]: r for r in found}
    order = rows["RA1"]
    assert (order["customer_name"], order["platform"], order["order_number"], order["lifecycle_state"]) == (
        "Ann Doe", "Shop", "0012", "ready_or_sent")
    assert order["tracking_number"] is None and order["production_cost"] is None
    items = sorted((r["position"], r["sku"], r["parent_line_id"]) for r in found if r["document_number"] == "RA1")
    assert [i[1:] for i in items] == [("PC001", None), ("CP001", 1), ("ME001", 1), ("AR001", None), ("PC002", None), ("CP002", 6)]
    supplier = rows["BX"]
    assert supplier["platform"] is None and supplier["sku"] is None and supplier["position"] is None
    assert supplier["lifecycle_label"] == "Unknown combination: B/0" and supplier["customer_name"] is None
    assert {r["document_number"] for r in D.order_360(tables, [" ra1 "]).collect()} == {"RA1"}


def test_channel_names_by_map_and_by_join(spark, monkeypatch):
    """As many channels as go into a map or more: the same names."""
    from werkbank.plans import sales

    beleg = table(spark, BELEG, [dict(Belegnummer=str(i), Belegtyp="R", Status=0, Vertreter=v, AngelegtAm="2026-01-01 00:00:00")
                                 for i, v in enumerate([8, 8, 9, None])])
    names = table(spark, MITARBW, [dict(Nr=8, Name="Shop"), dict(Nr=1, Name="Other")])
    for most in (10_000, 2, 1):
        monkeypatch.setattr(sales, "CHANNELS", most)
        got = sales.order_header(beleg, names)
        assert values(got, "document_number", "platform", sort=True) == [("0", "Shop"), ("1", "Shop"), ("2", None), ("3", None)]
    many = spark.range(10_001).selectExpr("cast(id AS int) AS Nr", "concat('Channel ', id) AS Name")
    assert values(sales.with_platform(beleg, many), "platform", sort=True) == sorted(
        ["Channel 8", "Channel 8", "Channel 9", None], key=repr)


def test_only_lines_on_a_chain_are_summed(spark):
    """The lines meet the wanted numbers before any sum, and all chains read the stored headers."""
    plan = D.missing_components(chain(spark))._jdf.queryExecution().optimizedPlan().toString()
    lines = plan[plan.index("Aggregate [Belegnummer"):]
    assert "LeftSemi" in lines


def shortages(spark, now, was):
    rows = [("1", side, i, c, n, k) for side, lines in (("now", now), ("was", was))
            for k, (i, c, n) in enumerate(lines)]
    lines = spark.createDataFrame(rows, "order_number string, side string, id string, quantity int, name string, line_id int")
    return values(D.compare_groups(lines), "id", "count", "name", sort=True)


def test_shortages(spark):
    assert shortages(spark, [("ME001", 1, "Current memory")], [("ME002", 2, "a"), ("ME003", 1, "b")]) == [
        ("ME001", 2, "Current memory")]
    assert shortages(spark, [], [("CP001", 1, "Processor")]) == [("CP001", 1, "Processor")]
    assert shortages(spark, [], [("CP001", 1, None), ("123", 2, "x"), (None, 5, "y")]) == [
        ("123", 2, "x"), ("CP001", 1, "")]
    assert shortages(spark, [("ME001", 1, "m"), ("GC1", 1, "g")], [("ME001", 1, "m")]) == []


def chain(spark):
    head = lambda number, kind, before, **more: dict(
        Belegnummer=number, Belegtyp=kind, LieferBelegNr=before, Status=0, Vorlage="", Adressnummer="K1",
        AngelegtAm="2026-01-01 00:00:00", **more)
    return erp(spark, beleg=[
        head("L1", "L", "M1"), head("M1", "D", "O1"), head("O1", "A", None), head("O1", "B", "X", Name="late"),
        head("L2", "L", "M2"), head("M2", "D", None), head("L3", "L", ""), {**head("L4", "L", "M1"), "Status": 2},
        {**head("L5", "L", "M1"), "Adressnummer": "K10000"}, {**head("L6", "L", "M1"), "Vorlage": "T"}],
        belegp=[line(1, "O1", "A", "ME001", "A", 4), line(2, "O1", "A", "CP001", "A", 1),
                line(3, "L1", "L", "ME009", "A", "1.5"), line(4, "L1", "L", "CP002", "A", 1),
                line(5, "L1", "B", "ME009", "A", 50)])


def test_missing_components_of_open_orders(spark):
    tables = chain(spark)
    missing = D.missing_components(tables)
    assert values(missing, "order_number", "id", "count") == [("L1", "ME009", 2.5)]
    asked = spark.createDataFrame([("L4",), ("L2",), ("nope",)], "Belegnummer string")
    assert values(D.missing_components(tables, asked), "order_number", "id", "count", sort=True) == [
        ("L4", "CP001", 1), ("L4", "ME001", 4)]
    assert values(D.shortage_totals(missing), "id", "count", "affected_orders") == [("ME009", 2.5, 1)]
    assert values(D.affected_orders(missing), "order_number", "missing_articles") == [("L1", 1)]


def _layout(rows):
    return sorted((tuple(r) for r in rows), key=repr)


def test_order_360_with_and_without_long_documents(spark, monkeypatch):
    """Documents count as long from 1, 3 or very many lines on; some have no header, no items, no number or blanks around it."""
    from werkbank.operators import ordered

    lines = LINES + [line(100 + i, "LA4 ", "L", f"CP{i}", "HKA"[i % 3]) for i in range(9)] + [
        line(None, "DA5", "D", f"X{i}", "A" if i % 2 else "H") for i in range(4)] + [line(i // 2, None, "R", f"N{i}", "H") for i in (400, 401, 402)]
    head = lambda number, kind: dict(Belegnummer=number, Belegtyp=kind, Status=0, EuroBrutto="1", AngelegtAm="2026-01-01 00:00:00")
    tables = erp(spark, belegp=lines, beleg=[head("RA1", "R"), head("RA2", "R"), head("LA4", "L"), head(" LA4", "L"), head("DA5", "D"),
                                             head(None, "R"), head("LA9", "L")])
    got = []
    for most in (1_000_000, 3, 1):
        monkeypatch.setattr(ordered, "HOT_ROWS", most)
        got.append((D.order_360(tables).columns, _layout(D.order_360(tables).collect()), _layout(D.order_items(tables["belegp"]).collect()),
                    _layout(D.order_item_rejects(tables["belegp"]).collect())))
    assert got[0] == got[1] == got[2]
    assert [len(part) for part in got[0][1:]] == [6 + 1 + 9 + 9 + 4 + 1 + 1, 6 + 9 + 4 + 3, 2]


def test_order_360_shuffles_its_lines_once(spark):
    """The lines are dealt by document alone, and the headers carry only what is shown."""
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        plan = D.order_360(erp(spark, belegp=LINES, beleg=[dict(Belegnummer="RA1", Belegtyp="R")]))._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    dealt = [row for row in plan.splitlines() if "hashpartitioning(" in row]
    assert len([row for row in dealt if "hashpartitioning(document_number" in row]) == 2 and len(dealt) == 3
    assert "Window" in plan and "Steuer" not in plan and "FileScan" not in plan


@pytest.mark.parametrize("rolled_up", [False, True])
def test_chains_read_lines_of_their_types_alone(spark, rolled_up):
    """Lines of types that no chain has go before any shuffle, and the lines that stay meet the documents, by number and type, in
    one join; numbers with blanks behind them are found as before."""
    tables = chain(spark)
    extra = [line(20 + i, n, k, "GC001", "A", 7) for i, (n, k) in enumerate([("L1", "R"), ("O1", "S"), ("L1 ", "L"), ("M1", "D"), ("O1", "A")])]
    tables["belegp"] = spark.createDataFrame(tables["belegp"].union(table(spark, BELEGP, extra)).collect(), BELEGP)
    missing = D.missing_components(tables)
    assert values(missing, "order_number", "id", "count", sort=True) == [("L1", "GC001", 7), ("L1", "ME009", 2.5)]
    result = D.shortage_totals(missing) if rolled_up else missing
    plan = result._jdf.queryExecution().optimizedPlan().toString()
    assert "IN (A,L)" in plan and plan.count("Join") == 2


def test_what_a_chain_stores_and_shuffles_is_narrow(spark):
    """The index stores a number once, and sums carry each article with its line once. Equal lines and headers of one time
    still give one answer: the least article, the greatest predecessor."""
    tables = chain(spark)
    again = [dict(Belegnummer="L1", Belegtyp="L", LieferBelegNr=before, Status=0, Vorlage="", Adressnummer="K1",
                  AngelegtAm="2026-01-01 00:00:00") for before in (None, "", "M0")]
    extra = [line(1, "O1", "A", "ME000", "A", 1), line(None, "O1", "A", "HD1", "A", 3)]
    for order in (1, -1):
        twins = {**tables, "beleg": tables["beleg"].union(table(spark, BELEG, again[::order])),
                 "belegp": table(spark, BELEGP, extra[::order]).union(tables["belegp"])}
        index = D.header_index(twins["beleg"])
        assert values(index.filter("Belegnummer = 'L1'"), "_number", "Belegtyp", "_before", "open") == [("L1", "L", "M1", True)]
        assert {f.split("#")[0] for f in index._jdf.queryExecution().optimizedPlan().toString().split("Relation [")[1].split("]")[0].split(",")} == {
            "Belegnummer", "Belegtyp", "_before", "open"}
        asked = spark.createDataFrame([("L4",)], "Belegnummer string")
        assert values(D.missing_components(twins, asked), "id", "count", sort=True) == [("CP001", 1), ("ME000", 5), (None, 3)]
    plan = D.missing_components(tables)._jdf.queryExecution().optimizedPlan().toString()
    assert "min_by" not in plan[plan.index("Aggregate [Belegnummer"):] and "max_by" not in plan
