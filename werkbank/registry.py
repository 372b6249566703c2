"""Every query by name, over the provided tables."""

from __future__ import annotations

from collections.abc import Callable
from datetime import date, datetime, timedelta
from functools import reduce

from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from werkbank.functions.text import draft_text as draft_as_text
from werkbank.operators.keyed import dedupe_keep_first, latest_by, missing_ids, upsert_latest
from werkbank.operators.shaping import to_chart, to_records
from werkbank.operators.stored import scratch
from werkbank.plans import (baskets, documents, inventory, monitoring, purchasing, sales, similar, support, text,
                            traffic)
from werkbank.sources import demo, schemas, support as source
from werkbank.sources.erp import load_erp
from werkbank.streaming import jobs
from werkbank.streaming.sinks import read_latest

AS_OF = datetime(2001, 8, 2)

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}


def plain(df: DataFrame) -> DataFrame:
    """Report types: decimals as double, dates and times as ISO text."""
    columns = []
    for field in df.schema.fields:
        c = F.col(f"`{field.name}`")
        if isinstance(field.dataType, T.DecimalType):
            c = c.cast("double")
        elif isinstance(field.dataType, T.DateType):
            c = c.cast("string")
        elif isinstance(field.dataType, (T.TimestampType, T.TimestampNTZType)):
            c = F.date_format(c, "yyyy-MM-dd HH:mm:ss")
        columns.append(c.alias(field.name))
    return df.select(*columns)


def query(fn: Query) -> Query:
    QUERIES[fn.__name__] = lambda spark, sf_dir: plain(fn(spark, sf_dir))
    return fn


def as_text(df: DataFrame, *columns: str) -> DataFrame:
    """Whole numbers that may be missing, as text: a frame with NULLs would read them as
    floating point."""
    return df.withColumns({c: F.col(c).cast("string") for c in columns})


def _erp(spark: SparkSession, sf_dir: str, customers: bool = True) -> dict[str, DataFrame]:
    return demo.demo_erp(spark, sf_dir, customers)


# ---- sales -----------------------------------------------------------------------------

ALL_METRICS = ["revenue", "selling_price", "production_cost", "gross_profit", "order_count"]


@query
def analyze_sales_month(spark, sf_dir):
    return sales.analyze_sales(_erp(spark, sf_dir))


@query
def analyze_sales_week(spark, sf_dir):
    return sales.analyze_sales(_erp(spark, sf_dir), ALL_METRICS, ["week"])


@query
def analyze_sales_day(spark, sf_dir):
    return sales.analyze_sales(_erp(spark, sf_dir), ALL_METRICS, ["day", "platform"],
                               document_type=None, date_from="1996-01", date_to="2000-06")


@query
def analyze_sales_platform(spark, sf_dir):
    return sales.analyze_sales(_erp(spark, sf_dir), ALL_METRICS, ["platform", "country"])


@query
def analyze_sales_place(spark, sf_dir):
    return sales.analyze_sales(_erp(spark, sf_dir), ["revenue", "gross_profit"],
                               ["city", "postcode"], document_type="L", status=0)


@query
def analyze_sales_filtered(spark, sf_dir):
    return sales.analyze_sales(_erp(spark, sf_dir), ALL_METRICS, ["year"],
                               {"platform": "Building", "status": 0}, document_type="D")


@query
def analyze_sales_total(spark, sf_dir):
    return sales.analyze_sales(_erp(spark, sf_dir), ALL_METRICS, [])


@query
def analyze_sales_top_cities(spark, sf_dir):
    return sales.analyze_sales(_erp(spark, sf_dir), ["revenue", "order_count"], ["city"],
                               sort_by="revenue", sort_direction="desc", limit=10)


@query
def sales_chart_month(spark, sf_dir):
    result = sales.analyze_sales(_erp(spark, sf_dir), ["revenue", "order_count"], ["year", "month"])
    return to_chart(result, ["year", "month"], ["revenue", "order_count"])


@query
def filter_orders_newest(spark, sf_dir):
    return sales.filter_orders(_erp(spark, sf_dir), lifecycle_state="ready_or_sent", limit=250)


@query
def filter_orders_customer(spark, sf_dir):
    return sales.filter_orders(_erp(spark, sf_dir), customer_name="ben customer#", document_type="L",
                               number="la0", date_from="1996-01-01", date_to="2000-12-31",
                               sort="oldest", limit=50)


@query
def count_orders_production(spark, sf_dir):
    return sales.count_orders(_erp(spark, sf_dir), lifecycle_state="in_production")


@query
def count_orders_period(spark, sf_dir):
    return sales.count_orders(_erp(spark, sf_dir), date_from="1997-03", date_to="1998-02")


@query
def lifecycle_breakdown(spark, sf_dir):
    return sales.lifecycle_breakdown(_erp(spark, sf_dir), "1996-01-01", "2001-01-31")


@query
def orders_over_time_day(spark, sf_dir):
    return sales.orders_over_time(_erp(spark, sf_dir), "day")


@query
def orders_over_time_week(spark, sf_dir):
    return sales.orders_over_time(_erp(spark, sf_dir), "week")


@query
def orders_over_time_month(spark, sf_dir):
    return sales.orders_over_time(_erp(spark, sf_dir), "month")


@query
def order_headers(spark, sf_dir):
    erp = _erp(spark, sf_dir)
    return sales.order_header(erp["beleg"], erp["mitarbw"])


@query
def stored_headers(spark, sf_dir):
    """The ERP relations written as files and read by their contract."""
    folder = _scratch(spark)
    for name, rows in ((n, _erp(spark, sf_dir)[n]) for n in schemas.ERP):
        rows.write.parquet(f"{folder}/{name}.parquet")
    erp = load_erp(spark, folder)
    lines = erp["belegp"].groupBy("Belegtyp").agg(F.count("*").alias("lines"), F.sum("Menge").alias("units"))
    heads = erp["beleg"].groupBy("Belegtyp").agg(F.count("*").alias("headers"), F.sum("EuroBrutto").alias("value"))
    return heads.join(lines, "Belegtyp", "left").withColumnRenamed("Belegtyp", "document_type")


@query
def stored_relations(spark, sf_dir):
    """All six ERP relations written as files, read by their contract and summed up."""
    folder = _scratch(spark)
    for name in schemas.ERP:
        _erp(spark, sf_dir)[name].write.option("compression", "zstd").parquet(f"{folder}/{name}.parquet")
    erp = load_erp(spark, folder)
    # What is summed of each relation, and a text of which the distinct values are counted.
    shown = {"art": (F.lit(None), "HstArtikelnummer"), "beleg": (F.col("EuroBrutto"), "Belegnummer"), "belegp": (F.col("Menge"), "Artikelnummer"),
             "serie": (F.col("Id"), "Artikelnummer"), "lagerp": (F.col("Wert"), "IdSerie"), "mitarbw": (F.col("Nr"), "Name")}
    parts = [erp[name].agg(F.lit(name).alias("relation"), F.count("*").alias("row_count"), F.sum(value.cast("decimal(18,2)")).alias("total"),
                           F.countDistinct(text).alias("distinct_values")) for name, (value, text) in shown.items()]
    return reduce(DataFrame.unionByName, parts)


# ---- stock, sales of components, forecast ------------------------------------------------

SEARCHES = {
    "search_inventory_cpu": dict(cpu_manufacturer="Intel", cpu_generation=9),
    "search_inventory_cpu_model": dict(cpu_manufacturer="Intel", cpu_model="14900KF"),
    "search_inventory_amd": dict(cpu_manufacturer="AMD", cpu_generation=7),
    "search_inventory_ram": dict(ram_capacity=32, ram_ddr=5),
    "search_inventory_disk": dict(hdd_type="SSD", hdd_capacity=1000),
    "search_inventory_gpu": dict(gpu_series="Geforce", gpu_vram=8),
    "search_inventory_gpu_small": dict(gpu_manufacturer="NVIDIA", gpu_vram=2),
    "search_inventory_case": dict(case_manufacturer="coolermaster", case_model="elite 302"),
    "search_inventory_name": dict(item_name="widget", category="MB"),
    "search_inventory_ean": dict(ean=" 0000000000007 "),
    "search_inventory_producer_ean": dict(producer_ean="brand#16-31"),
    "search_inventory_amd_model": dict(cpu_manufacturer="AMD", cpu_model="7700x"),
    "search_inventory_maker": dict(cpu_manufacturer="AMD"),
    "search_inventory_ram_speed": dict(ram_speed=5600),
    "search_inventory_gpu_model": dict(gpu_manufacturer="NVIDIA", gpu_model="4060"),
    "search_inventory_radeon": dict(gpu_series="Radeon"),
    "search_inventory_gpu_least": dict(gpu_vram=1),
}


def _search(attributes):
    return lambda spark, sf_dir: plain(inventory.search_inventory(
        _erp(spark, sf_dir, False), AS_OF, **attributes))


for _name, _attributes in SEARCHES.items():
    QUERIES[_name] = _search(_attributes)


def _component_sales(grain, attributes):
    return lambda spark, sf_dir: plain(inventory.component_sales(
        _erp(spark, sf_dir, False), "1996-01-01", "2000-12-31", grain, **attributes))


QUERIES["component_sales_day"] = _component_sales("day", dict(category="CP"))
QUERIES["component_sales_week"] = _component_sales("week", dict(ram_ddr=5))
QUERIES["component_sales_month"] = _component_sales("month", dict(gpu_manufacturer="NVIDIA"))
QUERIES["component_sales_year"] = _component_sales("year", dict(hdd_type="SSD"))
QUERIES["component_sales_total"] = _component_sales("total", dict(category="TW"))


@query
def component_sales_chart(spark, sf_dir):
    sold = inventory.component_sales(_erp(spark, sf_dir, False), "1996-01-01", "2000-12-31", "year", category="MB")
    return inventory.component_chart(sold)


@query
def forecast_components(spark, sf_dir):
    return inventory.forecast_components(_erp(spark, sf_dir, False), AS_OF, 2)


def _wanted_skus(spark, sf_dir):
    """SKUs asked for: every article in lower case and, for every supplier, an unknown one."""
    known = demo.table(spark, sf_dir, "part").select(
        F.concat(F.lit(" "), F.lower(demo.sku_of(F.col("p_partkey")))).alias("sku"))
    unknown = demo.table(spark, sf_dir, "supplier").select(
        F.concat(F.lit("XX"), F.col("s_suppkey").cast("string")).alias("sku"))
    return known.unionByName(unknown)


@query
def stock_by_sku(spark, sf_dir):
    return inventory.stock_by_sku(_erp(spark, sf_dir, False), _wanted_skus(spark, sf_dir))


@query
def unknown_skus(spark, sf_dir):
    return inventory.unknown_skus(_erp(spark, sf_dir, False), _wanted_skus(spark, sf_dir))


@query
def article_attributes(spark, sf_dir):
    return as_text(inventory.article_attributes(demo.articles(spark, sf_dir)), "cpu_generation", "ram_capacity",
                   "ram_ddr", "ram_speed", "hdd_capacity", "gpu_vram")


@query
def canonical_case(spark, sf_dir):
    return inventory.canonical_case(demo.articles(spark, sf_dir))


# ---- deliveries and baskets ---------------------------------------------------------------

@query
def deliveries_waiting(spark, sf_dir):
    return purchasing.delivery_lines(_erp(spark, sf_dir, False), status="waiting")


@query
def deliveries_components(spark, sf_dir):
    return purchasing.delivery_lines(
        _erp(spark, sf_dir, False), ["HD", {"ram_capacity": 16, "ram_ddr": 5},
                                     {"cpu_manufacturer": "Intel", "cpu_generation": 7}],
        "1997-01-01", "2000-12-31", status="received")


@query
def incoming_deliveries(spark, sf_dir):
    return purchasing.incoming_deliveries(_erp(spark, sf_dir, False), limit=500, components=["CP", "GC"])


@query
def co_purchase(spark, sf_dir):
    return purchasing.co_purchase(_erp(spark, sf_dir), [" CP000000000132 ", "hd000000001791", "CP000000000132"])


@query
def co_purchase_summary(spark, sf_dir):
    found = purchasing.co_purchase_summary(_erp(spark, sf_dir), ["ME000000000002"], 5)
    return found.withColumn("sample_order_numbers", F.concat_ws(",", "sample_order_numbers"))


def _pc_pairs(erp):
    """Asked pairs: each PC article with each component built into it somewhere."""
    items = documents.order_items(erp["belegp"].filter(F.col("Belegtyp") == "R")).select(
        "document_number", "line_id", "parent_line_id", "sku")
    pcs = items.filter("parent_line_id IS NULL").select("document_number", "line_id",
                                                        F.col("sku").alias("sku_a"))
    parts = items.filter("parent_line_id IS NOT NULL").select(
        "document_number", F.col("parent_line_id").alias("line_id"), F.col("sku").alias("sku_b"))
    return parts.join(pcs, ["document_number", "line_id"]).select("sku_a", "sku_b").distinct()


@query
def co_purchase_pairs(spark, sf_dir):
    erp = _erp(spark, sf_dir)
    return purchasing.co_purchase_pairs(erp, _pc_pairs(erp))


@query
def co_purchase_frequent(spark, sf_dir):
    """All pairs that two or more invoices share."""
    return baskets.frequent_pairs(purchasing.baskets_of(_erp(spark, sf_dir)), 2)


# ---- documents ------------------------------------------------------------------------------

@query
def order_items(spark, sf_dir):
    return as_text(documents.order_items(_erp(spark, sf_dir, False)["belegp"]), "parent_line_id")


@query
def order_item_rejects(spark, sf_dir):
    return documents.order_item_rejects(_erp(spark, sf_dir, False)["belegp"])


@query
def order_360(spark, sf_dir):
    return as_text(documents.order_360(_erp(spark, sf_dir)), "position", "line_id", "parent_line_id")


@query
def missing_components(spark, sf_dir):
    return documents.missing_components(_erp(spark, sf_dir, False))


@query
def open_order_shortages(spark, sf_dir):
    return documents.shortage_totals(documents.missing_components(_erp(spark, sf_dir, False)))


@query
def affected_orders(spark, sf_dir):
    return documents.affected_orders(documents.missing_components(_erp(spark, sf_dir, False)))


# ---- forecast snapshots -------------------------------------------------------------------------

@query
def latest_forecast(spark, sf_dir):
    """From stored runs of two days, two times of day and two horizons."""
    path, noon = f"{_scratch(spark)}/forecast", AS_OF.replace(hour=12)
    runs = (noon - timedelta(days=1), 4), (AS_OF.replace(hour=8), 4), (noon, 4), (noon, 1)
    facts = inventory.forecast_facts(_erp(spark, sf_dir, False), min(as_of for as_of, _ in runs))
    for as_of, weeks in runs:
        inventory.save_forecast(inventory.forecast_components(facts, as_of, weeks), path, as_of, weeks)
    return inventory.latest_forecast(spark.read.parquet(path), AS_OF.date(), 4)


@query
def daily_forecast(spark, sf_dir):
    path = f"{_scratch(spark)}/forecast"
    erp = _erp(spark, sf_dir, False)
    jobs.daily_forecast(spark, erp, path, AS_OF.replace(hour=8), 4)
    table = jobs.daily_forecast(spark, erp, path, AS_OF.replace(hour=12), 4)
    return inventory.latest_forecast(table, AS_OF.date(), 4)


def _scratch(spark):
    return scratch(spark)


# ---- customer e-mails -----------------------------------------------------------------------------

@query
def email_contacts(spark, sf_dir):
    return sales.email_contacts(_erp(spark, sf_dir), demo.contacts(spark, sf_dir),
                                demo.contact_tickets(spark, sf_dir), "1996-01-01", "2000-12-31")


@query
def tickets_by_email(spark, sf_dir):
    return sales.tickets_by_email(demo.contacts(spark, sf_dir), demo.contact_tickets(spark, sf_dir))


# ---- tickets and conversations ----------------------------------------------------------------------

@query
def ingest_tickets(spark, sf_dir):
    pages = source.parse_ticket_pages(demo.ticket_pages(demo.table(spark, sf_dir, "conversations")))
    return support.explode_positions(latest_by(pages, ["ticket_id"], ["revision"]))


@query
def normalise_messages(spark, sf_dir):
    return source.normalise_messages(demo.raw_messages(spark, sf_dir))


@query
def upsert_messages(spark, sf_dir):
    base = demo.cached_messages(spark, sf_dir)
    later = (demo.raw_messages(spark, sf_dir).filter(F.col("position") >= 2)
             .withColumn("body", F.concat(F.lit("(edited) "), "body"))
             .withColumn("cached_at", F.col("cached_at") + F.expr("interval 60 seconds")))
    return upsert_latest(base, source.normalise_messages(later), ["message_id"], ["cached_at"])


@query
def ticket_conversation(spark, sf_dir):
    return as_text(support.ticket_conversation(
        demo.message_positions(spark, sf_dir), demo.cached_messages(spark, sf_dir)), "position")


def _turns(spark, sf_dir):
    return support.visible_turns(source.normalise_messages(demo.raw_messages(spark, sf_dir)))


@query
def conversation_context(spark, sf_dir):
    return support.conversation_context(_turns(spark, sf_dir), 3)


@query
def retrieval_context(spark, sf_dir):
    return support.retrieval_context(_turns(spark, sf_dir))


@query
def draft_query(spark, sf_dir):
    return support.draft_query(_turns(spark, sf_dir))


def _status(spark, sf_dir):
    return support.ticket_sync_status(
        demo.message_positions(spark, sf_dir), demo.cached_tickets(spark, sf_dir),
        demo.cached_messages(spark, sf_dir), demo.stored_drafts(spark, sf_dir), demo.PROMPT_VERSION)


@query
def ticket_sync_status(spark, sf_dir):
    return _status(spark, sf_dir)


@query
def sync_summary(spark, sf_dir):
    return support.sync_summary(_status(spark, sf_dir))


@query
def missing_message_ids(spark, sf_dir):
    return missing_ids(demo.message_positions(spark, sf_dir).select("message_id"),
                       demo.cached_messages(spark, sf_dir), "message_id")


# ---- drafts, logs, translations ------------------------------------------------------------------------

def _linked_logs(spark, sf_dir):
    events = demo.generation_logs(spark, sf_dir)
    return support.append_generation_log(events.limit(0), events)


@query
def generation_log_append(spark, sf_dir):
    """Stored logs of the first halves, then new events: all of them delivered once more
    under new ids."""
    events = demo.generation_logs(spark, sf_dir)
    stored = events.filter(F.col("based_on_message_id").endswith("-0"))
    again = events.withColumn("id", F.col("id") + 10_000_000).withColumn(
        "event_type", F.when(F.col("message_count") == 8, "other").otherwise(F.col("event_type")))
    return as_text(support.append_generation_log(stored, events.filter(
        ~F.col("based_on_message_id").endswith("-0")).unionByName(again)).select(
        "id", "ticket_id", "based_on_message_id", "event_type", "first_draft_id"), "first_draft_id")


@query
def rejected_events(spark, sf_dir):
    events = demo.generation_logs(spark, sf_dir).withColumn(
        "event_type", F.when(F.col("message_count") == 8, "other").otherwise(F.col("event_type")))
    return support.rejected_events(events).select("id", "ticket_id", "event_type")


@query
def rebuild_logs(spark, sf_dir):
    legacy = demo.generation_logs(spark, sf_dir).drop("id", "first_draft_id", "prompt_version", "messages_json")
    return as_text(support.rebuild_logs(legacy, schemas.GENERATION_LOGS), "first_draft_id").withColumn(
        "sources", F.concat_ws(",", "sources"))


@query
def read_reprompts(spark, sf_dir):
    return as_text(support.read_reprompts(_linked_logs(spark, sf_dir)).select(
        "id", "ticket_id", "created_at", "instructions", "response_text", "input_response_text", "first_draft_id"),
        "first_draft_id")


@query
def reprompt_search(spark, sf_dir):
    return support.search_reprompts(_linked_logs(spark, sf_dir), search="THE ", date_from=date(2024, 1, 1),
                                    date_to=date(2024, 1, 20)).select("id", "ticket_id", "created_at")


@query
def reprompt_history(spark, sf_dir):
    return as_text(support.reprompt_history(_linked_logs(spark, sf_dir), page=1, page_size=25), "first_draft_id")


@query
def reprompt_totals(spark, sf_dir):
    return support.reprompt_totals(demo.generation_logs(spark, sf_dir))


@query
def recent_logs(spark, sf_dir):
    return support.recent_logs(demo.generation_logs(spark, sf_dir)).select("id", "ticket_id", "event_type", "created_at")


@query
def first_draft(spark, sf_dir):
    return support.first_draft(demo.generation_logs(spark, sf_dir)).select(
        "ticket_id", "id", "based_on_message_id", "response_text", F.concat_ws(",", "sources").alias("sources"))


@query
def current_drafts(spark, sf_dir):
    return support.current_drafts(demo.stored_drafts(spark, sf_dir), demo.generation_logs(spark, sf_dir),
                                  demo.PROMPT_VERSION).withColumn("sources", F.concat_ws(",", "sources"))


@query
def draft_text(spark, sf_dir):
    marked = demo.stored_drafts(spark, sf_dir).withColumn("response_json", F.regexp_replace(
        "response_json", r"\\n", "&lt;br /&gt;&amp;amp;"))
    shown = support.current_drafts(marked, demo.generation_logs(spark, sf_dir), demo.PROMPT_VERSION)
    return shown.select("ticket_id", "based_on_message_id", draft_as_text(F.col("reply")).alias("reply"))


@query
def merge_sources(spark, sf_dir):
    logs = demo.generation_logs(spark, sf_dir)
    searched = F.array(F.concat(F.lit("T"), F.floor(F.col("id") / 10) + 2), F.lit(""), F.col("ticket_id"),
                       F.concat(F.lit("T"), F.floor(F.col("id") / 10) + F.col("message_count")))
    merged = support.merge_sources(logs.withColumn("searched", searched), "sources", "searched", "ticket_id")
    return merged.select("id", F.concat_ws(",", "sources").alias("sources"))


@query
def cited_tickets(spark, sf_dir):
    """Every cited ticket with the first log that cites it."""
    cited = demo.generation_logs(spark, sf_dir).select(F.explode("sources").alias("source"), "id")
    return dedupe_keep_first(cited, "source", "id")


@query
def translation_backlog(spark, sf_dir):
    return support.translation_backlog(
        source.normalise_messages(demo.raw_messages(spark, sf_dir)),
        demo.translation_cache(spark, sf_dir), demo.TRANSLATION_SETTINGS)


@query
def translated_messages(spark, sf_dir):
    return support.translated_messages(
        source.normalise_messages(demo.raw_messages(spark, sf_dir)), demo.translation_cache(spark, sf_dir),
        demo.TRANSLATION_SETTINGS).select("message_id", "translated")


# ---- similar tickets, text, traffic, monitoring -------------------------------------------------------------

def _newest_per_status(chunks):
    """One asking ticket per status: the newest, with its own status as the filter."""
    newest = latest_by(chunks.select("status", "chunk_id", "ticket_id", "vector"), ["status"], ["chunk_id"])
    return newest.select(F.col("chunk_id").alias("query_id"), "ticket_id",
                         F.lit(None).cast("string").alias("product_sku"), "status", "vector")


@query
def precedents_topk(spark, sf_dir):
    """A batch: every ticket of one status asks the whole collection, in blocks that meet cells."""
    chunks = demo.precedents(spark, sf_dir).drop("problem_text", "linked_resolution")
    asking = chunks.filter("status = '3'").select(
        F.col("chunk_id").alias("query_id"), "ticket_id", F.lit(None).cast("string").alias("product_sku"),
        F.lit(None).cast("string").alias("status"), "vector")
    return similar.precedents(asking, chunks, cells=4, blocks=3).select(
        "query_id", "rank", "ticket_id", F.round("score", 6).alias("score"))


@query
def precedents_by_status(spark, sf_dir):
    chunks = demo.precedents(spark, sf_dir)
    found = similar.precedents(_newest_per_status(chunks), chunks.drop("problem_text", "linked_resolution"), cells=2)
    return similar.precedent_payload(found, chunks).select(
        "query_id", "rank", "ticket_id", F.round("score", 6).alias("score"), "problem_text", "linked_resolution")


@query
def stored_precedents(spark, sf_dir):
    """Precedents written as a file and read by their contract."""
    folder = _scratch(spark)
    demo.precedents(spark, sf_dir).write.parquet(f"{folder}/precedents.parquet")
    return as_text(source.load_precedents(spark, folder).select(
        "chunk_id", "ticket_id", "product_sku", "status", "linked_resolution", F.length("problem_text").alias("characters"),
        F.size("vector").alias("dimensions")), "characters")


@query
def html_to_text(spark, sf_dir):
    return text.html_to_text(demo.pages(spark, sf_dir)).select("page_id", "text")


@query
def text_by_host(spark, sf_dir):
    return text.text_by_host(demo.pages(spark, sf_dir))


TRAFFIC_DAY = date(2024, 1, 31)
WEB_METRICS = list(traffic.METRICS)


def _traffic(breakdown, metrics=None):
    return lambda spark, sf_dir: plain(traffic.traffic_report(
        demo.events(spark, sf_dir), metrics or WEB_METRICS, breakdown, "28daysAgo", "yesterday", TRAFFIC_DAY))


QUERIES["website_traffic_overview"] = _traffic("overview")
QUERIES["website_traffic_date"] = _traffic("date")
QUERIES["website_traffic_type"] = _traffic("event_type")


@query
def website_traffic_page(spark, sf_dir):
    return traffic.website_traffic(demo.events(spark, sf_dir), "purchaseRevenue", "date",
                                   as_of=TRAFFIC_DAY, limit=10, offset=5)


@query
def website_traffic_chart(spark, sf_dir):
    """The first points of a web chart, and whether there are more."""
    report = traffic.traffic_report(demo.events(spark, sf_dir), ["activeUsers", "screenPageViews"], "date", "28daysAgo",
                                    "yesterday", TRAFFIC_DAY)
    return to_chart(report, ["date"], ["activeUsers", "screenPageViews"], limit=20)


@query
def website_traffic_props(spark, sf_dir):
    """Broken down by a value inside the event's properties."""
    events = demo.events(spark, sf_dir).withColumn("k", F.get_json_object("props", "$.k"))
    return traffic.traffic_report(events, ["activeUsers", "screenPageViews"], "k", "28daysAgo", "yesterday", TRAFFIC_DAY)


@query
def website_sessions(spark, sf_dir):
    return traffic.sessions(demo.events(spark, sf_dir))


@query
def traffic_records(spark, sf_dir):
    return to_records(traffic.traffic_report(
        demo.events(spark, sf_dir), ["activeUsers", "screenPageViews"], "date", "28daysAgo", "yesterday",
        TRAFFIC_DAY))


@query
def incident_states(spark, sf_dir):
    return monitoring.incident_states(demo.health_checks(demo.table(spark, sf_dir, "events")))


# ---- streams ---------------------------------------------------------------------------------------------------

def _stream(spark, sf_dir, name, event_time=None):
    # The pattern fits a table that is one file and one that is a folder of files; as a plain path, a stream takes folders alone.
    rows = spark.readStream.schema(demo.PROVIDED[name]).parquet(f"{sf_dir}/{name}.parque[t]")
    return rows if event_time is None else rows.withColumn(event_time, F.col(event_time).cast("timestamp"))


def _in_batches(spark, sf_dir, name, files=6):
    """The whole table as a stream of several batches, its rows dealt to files at random, so that
    rows of one key come apart, late and out of order."""
    path = f"{_scratch(spark)}/landed"
    rows = demo.table(spark, sf_dir, name)
    rows.repartition(files, F.xxhash64(*rows.columns)).write.parquet(path)
    return spark.readStream.schema(demo.PROVIDED[name]).option("maxFilesPerTrigger", 2).parquet(path)


def _finished(stream_job, spark, *args, **kwargs):
    folder = _scratch(spark)
    stream_job(*args, f"{folder}/table", f"{folder}/checkpoint", **kwargs).awaitTermination()
    return f"{folder}/table"


@query
def stream_messages(spark, sf_dir):
    raw = _stream(spark, sf_dir, "conversations").select(*demo.raw_message_columns())
    path = _finished(jobs.stream_messages, spark, raw)
    return read_latest(spark, path, ["message_id"], ["cached_at"])


@query
def stream_tickets(spark, sf_dir):
    landed = f"{_scratch(spark)}/landed"
    demo.ticket_pages(demo.table(spark, sf_dir, "conversations")).repartition(4, F.xxhash64("value")).write.parquet(landed)
    pages = spark.readStream.schema("revision bigint, value string").option("maxFilesPerTrigger", 1).parquet(landed)
    path = _finished(jobs.stream_tickets, spark, pages, revision="revision")
    return support.explode_positions(read_latest(spark, path, ["ticket_id"], ["revision"]))


@query
def stream_counts_day(spark, sf_dir):
    path = _finished(jobs.stream_counts, spark, _stream(spark, sf_dir, "events", "ts"))
    return read_latest(spark, path, ["period"])


@query
def stream_counts_week(spark, sf_dir):
    path = _finished(jobs.stream_counts, spark, _stream(spark, sf_dir, "orders", "o_orderdate"), at="o_orderdate", grain="week")
    return read_latest(spark, path, ["period"])


@query
def stream_sessions(spark, sf_dir):
    events = _in_batches(spark, sf_dir, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    path = _finished(jobs.stream_sessions, spark, events)
    return jobs.read_sessions(spark, path)


@query
def stream_incidents(spark, sf_dir):
    checks = demo.health_checks(_in_batches(spark, sf_dir, "events"))
    return jobs.read_incidents(spark, _finished(jobs.stream_incidents, spark, checks))


@query
def stream_messages_compacted(spark, sf_dir):
    """The update table after its batches were written together, and later messages on top."""
    raw = _stream(spark, sf_dir, "conversations").select(*demo.raw_message_columns())
    path, target = _finished(jobs.stream_messages, spark, raw), f"{_scratch(spark)}/compact"
    jobs.compact_messages(spark, path, target)
    again = source.normalise_messages(demo.raw_messages(spark, sf_dir).filter("position % 3 = 0"))
    again.write.parquet(f"{target}/batch_id=0")
    return read_latest(spark, target, ["message_id"], ["cached_at"])


@query
def stream_counts_bounded(spark, sf_dir):
    """Counts of a stream with a watermark, and its rejects: together all rows, whatever the order of the batches."""
    events = _in_batches(spark, sf_dir, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    counts = jobs.read_bounded_counts(spark, _finished(jobs.stream_bounded_counts, spark, events, delay="1 hour"))
    return counts.select("period", (F.col("n") + F.col("rejected")).alias("n"))


@query
def stream_alerts(spark, sf_dir):
    """The alerts that stand after batches in any order."""
    checks = demo.health_checks(_in_batches(spark, sf_dir, "events"))
    return jobs.read_alerts(spark, _finished(jobs.stream_alerts, spark, checks))
