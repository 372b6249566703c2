"""Supplier deliveries and baskets."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from werkbank.functions.dates import date_bounds, date_range
from werkbank.functions.predicates import component_alternatives, delivery_status, genuine_orders
from werkbank.operators.shaping import first_rows, limit_flag
from werkbank.operators.stored import stored


def delivery_lines(erp: dict[str, DataFrame], components=(), date_from=None, date_to=None,
                   provider: str | None = None, status: str | None = None) -> DataFrame:
    """Article lines of purchase documents with provider and waiting/received. Stored totals
    are kept, missing prices stay NULL, documents without a state are left out."""
    lo, hi = date_bounds(date_from, date_to)
    headers = erp["beleg"].filter((F.col("Belegtyp") == "B") & delivery_status(status)
                                  & F.col("UebernahmeOffen").isNotNull())
    if provider is not None:
        headers = headers.filter(F.lower("Name") == provider.lower())
    headers = headers.select("Belegnummer", F.col("Name").alias("provider"),
                             F.when(F.col("UebernahmeOffen") < 0, "waiting").otherwise("received").alias("status"))
    lines = erp["belegp"].filter((F.col("Belegtyp") == "B") & (F.col("Zeilentyp") == "A")
                                 & date_range(F.col("Datum"), lo, hi))
    if components:
        wanted = erp["art"].filter(component_alternatives(list(components))).select("Artikelnummer")
        lines = lines.join(wanted, "Artikelnummer", "left_semi")
    return lines.join(headers, "Belegnummer").select(
        F.col("Belegnummer").alias("delivery_number"), F.col("Artikelnummer").alias("component_sku"),
        F.col("Bezeichnung").alias("component_name"), F.col("EditMenge").alias("quantity"), "provider",
        F.col("Datum").alias("delivery_date"), F.col("Einzelpreis").alias("price_per_item"),
        F.col("Gesamtpreis").alias("price_overall"), "status")


def incoming_deliveries(erp: dict[str, DataFrame], limit: int = 10_000, **filters) -> DataFrame:
    """The newest delivery lines with a flag whether more exist."""
    if limit < 1:
        raise ValueError("a delivery list has at least one row")
    order = [F.desc("delivery_date"), "delivery_number", "component_sku", "quantity", "price_overall"]
    return limit_flag(delivery_lines(erp, **filters), order, limit)


def _invoice_numbers(erp: dict[str, DataFrame]) -> DataFrame:
    return (erp["beleg"].filter(genuine_orders("co_purchase"))
            .select(F.trim("Belegnummer").alias("order_number")).filter("order_number <> ''").distinct())


def co_purchase(erp: dict[str, DataFrame], skus: list[str]) -> DataFrame:
    """Numbers of invoices that contain every one of the SKUs. Each document is reduced to its
    number of distinct wanted SKUs before it meets the headers."""
    if not isinstance(skus, list) or not skus or any(
            not isinstance(s, str) or not s.strip() for s in skus):
        raise ValueError("give at least one article number, none of them blank")
    wanted = {s.strip().lower() for s in skus}
    full = (erp["belegp"].filter(F.col("Belegtyp") == "R")
            .filter(F.lower("Artikelnummer").isin(*sorted(wanted)))
            .select(F.trim("Belegnummer").alias("order_number"), F.lower("Artikelnummer").alias("sku"))
            .distinct().groupBy("order_number").agg(F.count("*").alias("_found"))
            .filter(F.col("_found") == len(wanted)))
    return full.join(_invoice_numbers(erp), "order_number", "left_semi").select("order_number")


def co_purchase_summary(erp: dict[str, DataFrame], skus: list[str], sample_limit: int = 20) -> DataFrame:
    """One row: number of matching invoices, a bounded sample of them, and whether the sample
    leaves some out."""
    if type(sample_limit) is not int or sample_limit < 0:
        raise ValueError("the sample is a whole number of invoices")
    sample = first_rows(co_purchase(erp, skus), ["order_number"], max(1, sample_limit))
    return (sample.agg(F.sort_array(F.collect_list(F.when(F.col("_place") <= sample_limit, F.col("order_number")))).alias(
        "sample_order_numbers"), F.coalesce(F.max("_total"), F.lit(0)).alias("matching_order_count"))
            .withColumn("order_numbers_truncated", F.col("matching_order_count") > F.size("sample_order_numbers")))


def baskets_of(erp: dict[str, DataFrame], articles: DataFrame | None = None) -> DataFrame:
    """Distinct ``order_number`` and ``sku`` of genuine invoices (of ``articles``, a column ``sku``)."""
    lines = erp["belegp"].filter(F.col("Belegtyp") == "R").select(
        F.trim("Belegnummer").alias("order_number"), F.col("Artikelnummer").alias("sku"))
    if articles is not None:
        lines = lines.join(articles, "sku", "left_semi")
    return lines.filter("sku IS NOT NULL").distinct().join(_invoice_numbers(erp), "order_number", "left_semi")


def co_purchase_pairs(erp: dict[str, DataFrame], pairs: DataFrame, min_orders: int = 1) -> DataFrame:
    """For each asked pair (``sku_a``, ``sku_b``), how many invoices contain both.

    Only asked pairs are counted: pairs are never generated from a basket. Lines of articles that
    nobody asks for go before anything is summed or dealt; the asked pairs and what is left of the baskets are
    stored, as each is read several times. A pair first meets the invoices of its
    rarer SKU and is then checked against the other one, so a very common SKU is expanded only
    for a partner that is just as common.
    """
    asked = stored(pairs.select(F.least("sku_a", "sku_b").alias("sku_a"), F.greatest("sku_a", "sku_b").alias("sku_b"))
                   .filter("sku_a <> sku_b").distinct(), "asked_pairs")
    named = asked.select(F.explode(F.array("sku_a", "sku_b")).alias("sku")).distinct()
    baskets = stored(baskets_of(erp, named), "baskets")
    support = baskets.groupBy("sku").agg(F.count("*").alias("_support"))
    of = lambda side: support.select(F.col("sku").alias(f"sku_{side}"), F.col("_support").alias(f"_{side}"))
    rated = asked.join(of("a"), "sku_a").join(of("b"), "sku_b")
    swap = F.col("_a") > F.col("_b")
    rated = rated.select("sku_a", "sku_b", F.when(swap, F.col("sku_b")).otherwise(F.col("sku_a")).alias("sku"),
                         F.when(swap, F.col("sku_a")).otherwise(F.col("sku_b")).alias("_other"))
    candidates = rated.join(baskets, "sku").select("sku_a", "sku_b", "order_number", F.col("_other").alias("sku"))
    return (candidates.join(baskets, ["order_number", "sku"], "left_semi")
            .groupBy("sku_a", "sku_b").agg(F.count("*").alias("order_count"))
            .filter(F.col("order_count") >= min_orders))
