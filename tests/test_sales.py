from datetime import date, datetime
from decimal import Decimal

import pytest
from helpers import erp, values
from pyspark.sql import functions as F

from werkbank.functions.dates import as_date
from werkbank.functions.predicates import lifecycle
from werkbank.operators.shaping import first_rows, limit_flag, numbered_page, page, to_chart, to_records
from werkbank.plans import sales as S


def order(number, created, price, **more):
    return {**dict(Belegnummer=number, Belegtyp="R", Status=0, AngelegtAm=created, Datum=created, EuroBrutto=price,
                   Vertreter=8, PLZ="70000", Vertrag=0, Lager=100, Adressnummer="K5", Netto=1, Land="DE", Ort="X",
                   Name="Doe", Vorname="Ann", _EMAIL1="a@x"), **more}


def tables(spark, orders):
    return erp(spark, beleg=orders, mitarbw=[dict(Nr=8, Name="Shop"), dict(Nr=1, Name="Market")])


SPAN = [order("1", "2025-12-31 09:00:00", 10), order("2", "2025-12-31 17:00:00", 20),
        order("3", "2026-01-04 23:59:00", 30), order("4", "2026-01-05 00:00:00", 40),
        order("5", "2027-01-05 12:00:00", 50)]


def test_day_and_week_buckets(spark):
    both = ["revenue", "order_count"]
    t = tables(spark, SPAN)
    day = S.analyze_sales(t, both, ["day"], sort_by="day")
    assert values(day, "day", "order_count", "revenue") == [
        ("2025-12-31", 2, 30), ("2026-01-04", 1, 30), ("2026-01-05", 1, 40), ("2027-01-05", 1, 50)]
    week = S.analyze_sales(t, both, ["week"], sort_by="week")
    assert values(week, "week", "order_count", "revenue") == [
        ("2025-12-29", 3, 60), ("2026-01-05", 1, 40), ("2027-01-04", 1, 50)]
    assert S.analyze_sales(t, both, ["month"]).columns == ["year", "month", *both]
    assert values(S.analyze_sales(t, both, [], date_from="2025-12", date_to="2026-01-04"), "order_count") == [3]


def test_null_zero_negative_and_empty(spark):
    t = tables(spark, [order("1", "2026-01-01 00:00:00", None, Land=None), order("2", "2026-01-01 00:00:00", 0, Land="A"),
                       order("3", "2026-01-01 00:00:00", "-5.25", Land="A")])
    got = S.analyze_sales(t, ["revenue", "order_count"], ["country"], sort_by="revenue", sort_direction="desc")
    assert values(got, "country", "revenue", "order_count") == [("A", Decimal("-5.25"), 2), (None, None, 1)]
    empty = S.analyze_sales(t, ["revenue", "order_count"], [], date_from="2030-01-01")
    assert values(empty, "revenue", "order_count") == [(None, 0)]
    assert S.analyze_sales(t, ["revenue"], ["country"], date_from="2030-01-01").count() == 0


def test_exclusions_and_filters(spark):
    moment = "2026-01-01 00:00:00"
    t = tables(spark, [
        order("ok", moment, 1), order("m", moment, 2, Vertreter=1), order("a", moment, 9, Vertreter=23),
        order("b", moment, 9, PLZ="10997"), order("c", moment, 9, Vertrag=-1), order("d", moment, 9, Lager=200),
        order("e", moment, 9, Netto=0), order("f", moment, 9, Vertreter=None), order("g", moment, 9, Vertreter=99),
        order("h", moment, 9, Belegtyp="L")])
    assert values(S.analyze_sales(t, ["revenue"], ["platform"], sort_by="platform"), "platform", "revenue") == [
        ("Market", 2), ("Shop", 1)]
    assert values(S.analyze_sales(t, ["revenue"], [], {"platform": "Market"}), "revenue") == [2]
    with pytest.raises(ValueError):
        S.analyze_sales(t, ["revenue"], [], {"street": "x"})
    with pytest.raises(ValueError):
        S.analyze_sales(t, ["revenue"], [], date_from="2026-02-01", date_to="2026-01-01")


def test_order_list(spark):
    t = tables(spark, [*SPAN, order("6", "2026-05-01 00:00:00", 1, Name="Smith", Vorname=None),
                       order("7", "2026-05-01 00:00:00", 1, Adressnummer="K000000")])
    assert values(S.filter_orders(t, limit=2), "document_number") == ["5", "6"]
    assert values(S.filter_orders(t, sort="oldest", limit=1), "document_number") == ["1"]
    with pytest.raises(ValueError):
        S.filter_orders(t, limit=0)
    many = tables(spark, [order(str(i), "2026-05-01 00:00:00", 1) for i in range(150)])
    assert S.filter_orders(many, limit=140).count() == 140
    assert values(S.filter_orders(t, customer_name="ann doe", date_to="2025-12-31"), "document_number", sort=True) == ["1", "2"]
    assert values(S.filter_orders(t, customer_name="smi%"), "customer_name") == ["Smith"]
    assert values(S.count_orders(t, lifecycle_state="ready_or_sent"), "order_count") == [6]
    assert values(S.orders_over_time(t, "week", limit=1), "period", "orders") == [(date(2025, 12, 29), 3)]
    assert values(S.lifecycle_breakdown(t), "lifecycle_state", "order_count") == [("ready_or_sent", 6)]


def test_lifecycle_arguments():
    assert lifecycle() == ("R", None) and lifecycle("in_production") == ("L", 0)
    assert lifecycle(document_type="D", status="2") == ("D", 2)
    for bad in (dict(state="in_production", document_type="R"), dict(state="in_production", status="2")):
        with pytest.raises(ValueError):
            lifecycle(**bad)


def test_date_arguments():
    assert as_date("2024-02", end=True) == date(2024, 2, 29) and as_date("2024-02") == date(2024, 2, 1)
    assert as_date(" ") is None and as_date("today", end=True) is None
    assert as_date("3daysAgo", as_of=date(2024, 1, 2)) == date(2023, 12, 30)
    with pytest.raises(ValueError):
        as_date("2024-13")


def test_emails(spark):
    t = tables(spark, [order("1", "2026-01-01 00:00:00", 1, _EMAIL1="one+tag@example.com"),
                       order("2", "2026-01-02 00:00:00", 1, _EMAIL1="two@example.com"),
                       order("3", "2026-01-02 00:00:00", 1, _EMAIL1="two@example.com"),
                       order("4", "2026-01-02 00:00:00", 1, _EMAIL1=None),
                       order("5", "2026-01-02 00:00:00", 1, Vertreter=1)])
    contacts = spark.createDataFrame([("one+tag@example.com", c) for c in "1223"], "email string, contact_id string")
    tickets = spark.createDataFrame([("2", "10"), ("3", "10"), ("3", "11")], "contact_id string, ticket_id string")
    assert values(S.email_contacts(t, contacts, tickets), "email", "invoices", "customer_service", sort=True) == [
        ("one+tag@example.com", 1, True), ("two@example.com", 2, False)]
    assert values(S.tickets_by_email(contacts, tickets), "ticket_id", sort=True) == ["10", "11"]


def test_chart_pages_records(spark):
    df = spark.createDataFrame([(2026, 2, 5.0, 1), (2026, 1, None, 2)], "year int, month int, revenue double, order_count long")
    assert values(to_chart(df, ["year", "month"], ["revenue", "order_count"]), "x", "y", "series") == [
        ("Jan 2026", 2.0, "order_count"), ("Feb 2026", 5.0, "revenue"), ("Feb 2026", 1.0, "order_count")]
    assert values(to_chart(df.limit(1).select("revenue"), [], ["revenue"]), "x", "y", "series") == [("Total", 5.0, None)]
    days = spark.range(300).selectExpr("date_add(date'2024-01-01', cast(id AS int)) AS day", "id AS a")
    days = days.withColumn("day", days["day"].cast("string"))
    assert to_chart(days, ["day"], ["a"]).count() == 300
    assert {r["truncated"] for r in to_chart(days, ["day"], ["a"], 299).collect()} == {True}
    assert {r["truncated"] for r in to_chart(days, ["day"], ["a"], 300).collect()} == {False}
    many = spark.range(30)
    assert values(page(many, ["id"], 10, 5), "id", "row_count", "next_offset")[0] == (10, 30, 15)
    assert values(page(many, ["id"], 25, 5), "next_offset")[0] is None
    assert values(numbered_page(many, ["id"], 2, 25), "id", "page_count")[0] == (25, 2)
    assert values(limit_flag(many, ["id"], 29), "truncated")[0] is True
    assert limit_flag(many, ["id"], 29).count() == 29
    assert values(limit_flag(many, ["id"], 30), "truncated")[0] is False
    odd = spark.createDataFrame([(float("nan"), date(2026, 1, 2), datetime(2026, 1, 2, 3, 4, 5), None)],
                                "x double, d date, t timestamp_ntz, n string")
    assert values(to_records(odd), "record") == ['{"x":null,"d":"2026-01-02","t":"2026-01-02T03:04:05","n":null}']
    for bad in ((0, 0), (-1, 5)):
        with pytest.raises(ValueError):
            page(many, ["id"], *bad)


@pytest.mark.parametrize("rows, n", [(0, 3), (2, 3), (500, 7), (500, 600)])
def test_first_rows_and_count_in_one_run(spark, rows, n):
    frame = spark.range(rows).selectExpr("id", "cast(id * 7919 % 1009 AS int) AS v", "if(id % 3 = 0, NULL, 'x') AS t")
    found = first_rows(frame, [F.desc("v"), "id"], n)
    want = sorted(((i * 7919 % 1009, i) for i in range(rows)), key=lambda r: (-r[0], r[1]))[:n]
    assert [(r["v"], r["id"], r["_place"], r["_total"]) for r in found.orderBy("_place").collect()] == [
        (*w, i + 1, rows) for i, w in enumerate(want)]
    plan = page(frame, [F.desc("v"), "id"], 0, 5)._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[-1]
    assert plan.count("Range (") == 1
