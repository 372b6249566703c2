"""What must hold on the provided tables whatever their content."""

import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from werkbank import registry as R
from werkbank.plans import inventory, sales, support
from werkbank.sources import demo
from werkbank.sources.support import normalise_messages

DIRECTORY = "/root/testdata/sf0.01"
Q = entry.queries()


def total(df, column):
    return df.agg(F.sum(F.col(column).cast("decimal(38,4)"))).collect()[0][0]


def test_grains_have_one_total(spark):
    erp = demo.demo_erp(spark, DIRECTORY, False)
    sums = {total(inventory.component_sales(erp, "1996-01-01", "2000-12-31", grain, category="CP"), "sold_amount")
            for grain in ("day", "week", "month", "year", "total")}
    assert len(sums) == 1
    erp = demo.demo_erp(spark, DIRECTORY)
    counts = {total(sales.analyze_sales(erp, ["order_count"], groups), "order_count")
              for groups in (["day"], ["week"], ["month"], ["year", "platform"], ["city", "postcode"], [])}
    counts |= {total(sales.orders_over_time(erp, grain, document_type="R").filter("orders > 0"), "orders")
               for grain in ("day", "week", "month")} - counts
    # orders of an unknown channel are in the time series but not in the analysis
    assert len(counts) == 2 and min(counts) == total(sales.analyze_sales(erp, ["order_count"], []), "order_count")


def test_lines_are_items_or_rejects(spark):
    lines = demo.demo_erp(spark, DIRECTORY, False)["belegp"].filter(F.col("Belegtyp").isin("D", "L", "R")).count()
    assert Q["order_items"](spark, DIRECTORY).count() + Q["order_item_rejects"](spark, DIRECTORY).count() == lines


def test_hits_and_misses_are_all_messages(spark):
    messages = normalise_messages(demo.raw_messages(spark, DIRECTORY))
    backlog = support.translation_backlog(messages, demo.translation_cache(spark, DIRECTORY), demo.TRANSLATION_SETTINGS)
    assert total(backlog, "messages") == messages.filter("trim(body) <> ''").count()
    assert backlog.select("cache_key").distinct().count() == backlog.count()


@pytest.mark.parametrize("name,key", [
    ("upsert_messages", "message_id"), ("order_headers", "document_number"), ("stream_messages", "message_id"),
    ("first_draft", "ticket_id"), ("stock_by_sku", "sku"), ("ticket_sync_status", "ticket_id")])
def test_one_row_per_key(spark, name, key):
    rows = Q[name](spark, DIRECTORY)
    assert rows.count() == rows.select(key).distinct().count() > 0


def test_known_and_unknown_skus_are_all_asked(spark):
    asked = R._wanted_skus(spark, DIRECTORY).distinct().count()
    assert Q["stock_by_sku"](spark, DIRECTORY).count() + Q["unknown_skus"](spark, DIRECTORY).count() == asked


def test_sessions_keep_every_event(spark):
    assert total(Q["website_sessions"](spark, DIRECTORY), "events") == demo.table(spark, DIRECTORY, "events").count()
