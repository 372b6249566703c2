"""Order items, full order views and missing components along document chains."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, functions as F

from werkbank.functions.predicates import genuine_orders
from werkbank.functions.text import sku_group
from werkbank.operators.keyed import latest_by
from werkbank.operators.ordered import hot_keys, running_last_by_key
from werkbank.operators.stored import stored
from werkbank.plans.sales import order_header

ITEM_TYPES = ("D", "L", "R")


def _line_type():
    return F.upper(F.trim(F.coalesce("Zeilentyp", F.lit(""))))


KEY = ["document_number", "document_type"]


def _placed_lines(belegp: DataFrame, pieces: int | None) -> list[DataFrame]:
    """Lines with their position and the id of the PC that is open at the line. Any line that
    is not a component closes the PC before it; a PC line opens its own. The lines of very long
    documents are a table of their own, the second, if there are any."""
    text = lambda c: F.coalesce(F.trim(F.col(c)), F.lit(""))
    lines = belegp.filter(F.col("Belegtyp").isin(*ITEM_TYPES)).select(
        F.trim("Belegnummer").alias("document_number"), F.col("Belegtyp").alias("document_type"),
        F.col("BELEGP_ID").alias("line_id"), _line_type().alias("line_type"),
        text("Artikelnummer").alias("sku"), text("Bezeichnung").alias("name"),
        F.coalesce("Menge", F.lit(0)).alias("quantity"), F.coalesce("KalkpreisEuro", F.lit(0)).alias("price"))
    opener = F.when(F.col("line_type") != "K", F.struct(
        F.when(F.col("line_type") == "H", F.col("line_id")).alias("pc"), F.col("line_id").alias("at")))
    parts = running_last_by_key(lines, KEY, "line_id", opener, hot_keys(lines, KEY), pieces)
    return [p.withColumn("pc_line_id", F.col("last_mark.pc")).drop("last_mark") for p in parts if p is not None]


def _items(placed: DataFrame) -> DataFrame:
    parent = F.when(F.col("line_type") == "K", F.col("pc_line_id"))
    return (placed.filter((F.col("line_type") != "K") | F.col("pc_line_id").isNotNull())
            .withColumn("parent_line_id", parent).drop("pc_line_id"))


def order_items(belegp: DataFrame, pieces: int | None = None) -> DataFrame:
    """One row per document line; components carry the line id of their PC."""
    return _items(reduce(DataFrame.unionByName, _placed_lines(belegp, pieces)))


def order_item_rejects(belegp: DataFrame, pieces: int | None = None) -> DataFrame:
    """Components that stand before any PC of their document."""
    placed = reduce(DataFrame.unionByName, _placed_lines(belegp, pieces))
    return placed.filter((F.col("line_type") == "K") & F.col("pc_line_id").isNull()).drop("pc_line_id")


def order_360(erp: dict[str, DataFrame], numbers: list[str] | None = None) -> DataFrame:
    """Newest header per document with platform and state labels, and its items (of workshop,
    delivery and invoice documents): one row per line, the header's columns beside it, components
    with the line of their PC in ``parent_line_id``. A document without items is one row without
    line columns. The grain is the same however many lines a document has."""
    beleg, belegp = erp["beleg"], erp["belegp"]
    if numbers is not None:
        wanted = [n.strip().upper() for n in numbers]
        beleg = beleg.filter(F.upper(F.trim("Belegnummer")).isin(*wanted))
        belegp = belegp.filter(F.upper(F.trim("Belegnummer")).isin(*wanted))
    # The lines come dealt by document, so the outer join shuffles the headers alone.
    items, *long = [_items(p) for p in _placed_lines(belegp, None)]
    header = order_header(beleg, erp["mitarbw"])
    if not long:
        return header.join(items, KEY, "left")
    # Documents of very many lines meet their headers in an inner join, which the adaptive planner can split. The headers
    # are stored, as both joins read them.
    header, found = stored(header, "headers"), long[0].select(*KEY).distinct()
    return header.join(found, KEY, "left_anti").join(items, KEY, "left").unionByName(
        header.join(found, KEY, "left_semi").join(long[0], KEY))


def open_orders(beleg: DataFrame) -> DataFrame:
    """Numbers of production documents that are open, of real customers, no templates."""
    return beleg.filter(genuine_orders("open")).select("Belegnummer").distinct()


def compare_groups(lines: DataFrame) -> DataFrame:
    """Shortages per order and SKU group from lines ``(order_number, side, id, quantity, name,
    line_id)`` of the sides ``now`` and ``was``: groups with more units in the original than
    now. The shown article is the first of the group in the current lines, else the first in
    the original."""
    return _compare(lines.filter("id IS NOT NULL").withColumn("_group", sku_group(F.col("id"))))


def _compare(lines: DataFrame) -> DataFrame:
    now, was = F.col("side") == "now", F.col("side") == "was"
    item = F.struct("id", F.coalesce("name", F.lit("")).alias("name"))
    units = lambda side: F.sum(F.when(side, F.col("quantity")))
    first = lambda side: F.min_by(item, F.when(side, F.col("line_id")))
    grouped = lines.groupBy("order_number", "_group").agg(
        (units(was) - F.coalesce(units(now), F.lit(0))).alias("count"),
        F.coalesce(first(now), first(was)).alias("_item"))
    return grouped.filter(F.col("count") > 0).select(
        "order_number", F.col("_item.id").alias("id"), F.col("_item.name").alias("name"), "count")


def header_index(beleg: DataFrame) -> DataFrame:
    """One stored row per document number: the type and predecessor of its newest customer header, and whether it is an
    open order. Supplier purchases may re-use the number of a customer document but belong to no chain. Orders,
    middles and originals of all chains are read from here, so the headers are read once."""
    newest = beleg.filter(F.col("Belegtyp") != "B").groupBy("Belegnummer").agg(
        F.max(F.struct("AngelegtAm", "Belegtyp", "LieferBelegNr")).alias("_head"),
        F.max(F.coalesce(genuine_orders("open"), F.lit(False))).alias("open"))
    index = stored(newest.select("Belegnummer", "_head.Belegtyp", F.when(
        F.col("_head.LieferBelegNr") != "", F.rtrim("_head.LieferBelegNr")).alias("_before"), "open"), "header_index")
    return index.withColumn("_number", F.rtrim("Belegnummer"))


def _document_groups(belegp: DataFrame, wanted: DataFrame) -> DataFrame:
    """Units and first article per document and SKU group, of the documents and types in ``wanted``
    (columns ``_number``, ``Belegnummer``, ``Belegtyp``); lines of all others go first, those of other types before
    any shuffle. However many lines a document has, it is a few rows from here on."""
    item = F.struct(F.col("BELEGP_ID").alias("line_id"), F.col("Artikelnummer").alias("id"), F.col("Bezeichnung").alias("name"))
    types = [r[0] for r in wanted.select("Belegtyp").distinct().collect()]
    lines = belegp.filter(F.col("Belegtyp").isin(types) & F.col("Artikelnummer").isNotNull())
    same = wanted.select("_number", F.col("Belegnummer").alias("_full"), F.col("Belegtyp").alias("_type"))
    on = (F.rtrim("Belegnummer") == F.col("_number")) & (F.col("Belegnummer") == F.col("_full")) & (F.col("Belegtyp") == F.col("_type"))
    groups = (lines.join(same, on, "left_semi")
              .groupBy("Belegnummer", "Belegtyp", sku_group(F.col("Artikelnummer")).alias("_group"))
              .agg(F.sum("Menge").alias("quantity"), F.min(F.when(F.col("BELEGP_ID").isNotNull(), item)).alias("_first")))
    return groups.select(F.rtrim("Belegnummer").alias("_number"), "_group", "quantity", "_first.id", "_first.name", "_first.line_id")


def missing_components(erp: dict[str, DataFrame], numbers: DataFrame | None = None) -> DataFrame:
    """What each open order (or each of ``numbers``, column ``Belegnummer``) lacks against the
    original document two predecessors back.

    The chain is followed on an index of the headers first, and its ends are stored. Only lines of documents on it are
    summed, per document and SKU group, before they meet the orders, so neither a very long document nor one that very
    many orders come from multiplies lines. The joins along the chain compare numbers without trailing blanks;
    as these keys are new columns, both sides are plain shuffles and the adaptive planner can split a
    common predecessor.
    """
    index = header_index(erp["beleg"])
    start = index.filter("open") if numbers is None else index.join(numbers.select("Belegnummer"), "Belegnummer", "left_semi")
    start = start.filter("_before IS NOT NULL").select(F.col("Belegnummer").alias("order_number"), F.col("_before").alias("_middle"))
    middle = index.filter("_before IS NOT NULL").select(F.col("_number").alias("_middle"), "_before")
    sides = stored(start.join(middle, "_middle").select("order_number", F.explode(F.array(
        F.struct(F.lit("now").alias("side"), F.rtrim("order_number").alias("_number")),
        F.struct(F.lit("was").alias("side"), F.col("_before").alias("_number")))).alias("_s")).select(
        "order_number", "_s.*"), "chain_ends")
    wanted = stored(index.select("_number", "Belegnummer", "Belegtyp").join(sides.select("_number").distinct(), "_number", "left_semi"),
                    "chain_documents")
    groups = _document_groups(erp["belegp"].filter(F.col("Belegtyp") != "B"), wanted)
    return _compare(sides.join(groups, "_number"))


def shortage_totals(missing: DataFrame) -> DataFrame:
    """Shortages rolled up per article: units and affected orders."""
    return missing.groupBy("id", "name").agg(
        F.sum("count").alias("count"), F.countDistinct("order_number").alias("affected_orders"))


def affected_orders(missing: DataFrame) -> DataFrame:
    """The distinct orders that lack something, with their number of missing articles."""
    return missing.groupBy("order_number").agg(F.count("*").alias("missing_articles"))
