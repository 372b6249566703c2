"""Stock, component sales, demand forecast and article attributes.

Facts are summed per key before any join, so joins see one row per lot or article and a
popular article is reduced on the map side.
"""

from __future__ import annotations

from datetime import datetime, timedelta

from pyspark.sql import Column, DataFrame, functions as F

from werkbank.functions import constants as K
from werkbank.functions.dates import at, bucket, date_bounds, date_range
from werkbank.functions.predicates import article_predicate
from werkbank.operators.keyed import missing_ids
from werkbank.operators.stored import stored


def open_purchases(erp: dict[str, DataFrame], articles: DataFrame | None = None) -> DataFrame:
    """Units on purchase documents that are still open, per article (of ``articles``); number and
    type together identify a document. Both join sides are plain shuffles, so the adaptive
    planner can split a document of very many lines."""
    documents = erp["beleg"].filter((F.col("Belegtyp") == "B") & (F.col("UebernahmeOffen") < 0))
    lines = erp["belegp"].filter(F.col("Belegtyp") == "B").select("Belegnummer", "Artikelnummer", "Menge")
    if articles is not None:
        lines = lines.join(articles, "Artikelnummer", "left_semi")
    return (lines.join(documents.select("Belegnummer"), "Belegnummer", "left_semi").groupBy("Artikelnummer")
            .agg(F.coalesce(F.sum("Menge"), F.lit(0)).alias("ordered_amount")))


def search_inventory(erp: dict[str, DataFrame], as_of: datetime, max_age_days: int = 5000,
                     **attributes) -> DataFrame:
    """Stock and open purchases of the articles that match the attributes.

    Stock counts lines with units left, entered in the last ``max_age_days`` days, of serials
    that are not of type ``O``; the average price is over stock lines, not units. Open
    purchases are shown for articles with some stock line of non-zero value.

    The few wanted articles come first: serials, stock lines and purchase lines of all others go
    before anything is summed, and stock is read once for both of its uses.
    """
    wanted = erp["art"].filter(article_predicate(**attributes)).select(
        "Artikelnummer", "Bezeichnung", "EANNummer", "HstArtikelnummer")
    serial = erp["serie"].join(wanted.select("Artikelnummer"), "Artikelnummer", "left_semi")
    lines = erp["lagerp"].join(serial.withColumnRenamed("Id", "IdSerie"), "IdSerie")
    counts = (F.col("Bestand") > 0) & (F.col("AngelegtAm") >= at(as_of - timedelta(days=max_age_days)))
    of = lambda c: F.when(counts, F.col(c))
    lots = lines.groupBy("IdSerie", "Artikelnummer", "SCTyp").agg(
        F.sum(of("Bestand")).alias("_units"), F.min(of("Wert")).alias("_min"), F.max(of("Wert")).alias("_max"),
        F.sum(of("Wert")).alias("_value"), F.count(of("Wert")).alias("_priced"),
        F.count_if(counts).alias("_lines"), F.bool_or(F.col("Wert") != 0).alias("_valued"))
    here = (F.col("SCTyp") != "O") & (F.col("_lines") > 0)
    own = lambda c: F.when(here, F.col(c))
    stock = lots.groupBy("Artikelnummer").agg(
        F.sum(own("_units")).alias("item_count"), F.min(own("_min")).alias("minimum_price"),
        F.max(own("_max")).alias("maximum_price"),
        (F.sum(own("_value")).cast("double") / F.nullif(F.sum(own("_priced")), F.lit(0))).alias("average_price"),
        F.count_if(here).alias("_here"), F.bool_or("_valued").alias("_valued"))
    ordered = open_purchases(erp, wanted.select("Artikelnummer"))
    return (wanted.join(stock.filter("_here > 0"), "Artikelnummer").join(ordered, "Artikelnummer", "left")
            .select(F.col("Artikelnummer").alias("sku"), F.col("Bezeichnung").alias("name"),
                    F.col("EANNummer").alias("ean"), F.col("HstArtikelnummer").alias("producer_ean"),
                    "item_count", "minimum_price", "maximum_price", "average_price",
                    F.when(F.col("Bezeichnung").isNotNull() & F.col("_valued"), F.col("ordered_amount"))
                    .alias("ordered_amount")))


def component_sales(erp: dict[str, DataFrame], date_from, date_to, group_by: str = "month",
                    **attributes) -> DataFrame:
    """Units sold on invoices per article and period. Periods without sales do not appear."""
    lo, hi = date_bounds(date_from, date_to)
    if lo is None or hi is None:
        raise ValueError("component sales need both ends of the period")
    articles = erp["art"].filter(F.col("ArtikelGruppe").isin(*K.COMPONENT_GROUPS)
                                 & article_predicate(**attributes))
    sold = (erp["belegp"].filter((F.col("Belegtyp") == "R") & date_range(F.col("Datum"), lo, hi))
            .groupBy("Artikelnummer", bucket(F.col("Datum"), group_by).alias("period"))
            .agg(F.coalesce(F.sum("Menge"), F.lit(0)).alias("sold_amount")))
    return sold.join(articles.select("Artikelnummer", "Bezeichnung"), "Artikelnummer").select(
        F.col("Artikelnummer").alias("sku"), F.col("Bezeichnung").alias("name"), "period", "sold_amount")


def component_chart(sales: DataFrame) -> DataFrame:
    """Points ``(x, y, series)`` of component sales, all of them: the period (or the article
    where there is none) against units, one series per article."""
    article = F.concat(F.col("sku"), F.lit(" - "), F.col("name"))
    return sales.select(F.coalesce(F.col("period").cast("string"), article).alias("x"),
                        F.col("sold_amount").cast("double").alias("y"), article.alias("series"))


def forecast_demand(usage: DataFrame, weeks: int) -> DataFrame:
    """Forecast and quantity to buy from three 28-day bands ``u1, u2, u3`` (newest first),
    ``stock`` and ``incoming``. Articles that need nothing are dropped."""
    if not 1 <= weeks <= 52:
        raise ValueError("a forecast covers one to 52 weeks")
    weekly = lambda band, weight: F.col(band).cast("double") / 4 * weight
    # Weights of the bands.
    forecast = (weekly("u1", 0.50) + weekly("u2", 0.30) + weekly("u3", 0.20)) * weeks
    return (usage.withColumn("weekly_forecast", forecast)
            .withColumn("stock_coverage", F.col("weekly_forecast") - F.col("stock").cast("double")
                        - F.col("incoming").cast("double"))
            .filter("stock_coverage > 0"))


def _sold(erp: dict[str, DataFrame], since: datetime) -> DataFrame:
    return erp["belegp"].filter((F.col("Belegtyp") == "R") & (F.col("Datum") >= at(since - timedelta(days=84)))).select(
        "Artikelnummer", "Datum", "Menge")


def _units_in_stock(erp: dict[str, DataFrame]) -> DataFrame:
    return (erp["lagerp"].groupBy("IdSerie").agg(F.sum("Bestand").alias("_units"))
            .join(erp["serie"], F.col("IdSerie") == F.col("Id"))
            .groupBy("Artikelnummer").agg(F.sum("_units").alias("_stock")))


def forecast_facts(erp: dict[str, DataFrame], since: datetime) -> dict[str, DataFrame]:
    """What the forecasts of ``since`` and later read, stored once for all of them, in place of ``erp``: units sold per
    article and time, units in stock and on open purchases per article, and the articles."""
    sold = _sold(erp, since).groupBy("Artikelnummer", "Datum").agg(F.sum("Menge").alias("Menge"))
    return {"art": erp["art"], "sold": stored(sold, "sold"), "in_stock": stored(_units_in_stock(erp), "in_stock"),
            "ordered": stored(open_purchases(erp), "ordered")}


def forecast_components(erp: dict[str, DataFrame], as_of: datetime, weeks: int = 1) -> DataFrame:
    """Components to buy for the next weeks: sold at least twice in 84 days, with a forecast
    above stock and open purchases. One pass over the lines gives the popularity and the
    three bands; the newest band has no upper bound. ``erp`` may be the ``forecast_facts`` of an earlier day."""
    facts = erp if "sold" in erp else {"art": erp["art"], "sold": _sold(erp, as_of), "in_stock": _units_in_stock(erp),
                                       "ordered": open_purchases(erp)}
    edge = [at(as_of - timedelta(days=d)) for d in (28, 56, 84)]
    date = F.col("Datum")
    band = lambda condition: F.sum(F.when(condition, F.col("Menge")).otherwise(0))
    used = (facts["sold"].filter(date >= edge[2])
            .groupBy("Artikelnummer").agg(
                F.sum("Menge").alias("_sold"), band(date >= edge[0]).alias("u1"),
                band((date >= edge[1]) & (date < edge[0])).alias("u2"), band(date < edge[1]).alias("u3"))
            .filter("_sold >= 2"))
    components = facts["art"].filter(F.col("ArtikelGruppe").isin(*K.COMPONENT_GROUPS))
    popular = used.join(components.select("Artikelnummer", "Bezeichnung"), "Artikelnummer")
    usage = (popular.join(facts["in_stock"], "Artikelnummer", "left")
             .join(facts["ordered"], "Artikelnummer", "left")
             .select(F.col("Artikelnummer").alias("sku"), F.col("Bezeichnung").alias("name"),
                     "u1", "u2", "u3", F.coalesce("_stock", F.lit(0)).alias("stock"),
                     F.coalesce("ordered_amount", F.lit(0)).alias("incoming")))
    return forecast_demand(usage, weeks).select("sku", "name", "weekly_forecast", "stock_coverage")


def save_forecast(forecast: DataFrame, path: str, as_of: datetime, weeks: int) -> None:
    """Add a run to the snapshot table, partitioned by day, horizon and run. Writing the same
    run again replaces it, so a job that failed half-way can simply be repeated."""
    stamp = as_of.strftime("%Y-%m-%dT%H:%M:%S.%f")
    (forecast.withColumn("run_id", F.lit(f"{stamp}/{weeks}"))
     .withColumn("run_date", F.lit(as_of.date())).withColumn("created_at", at(as_of))
     .withColumn("weeks", F.lit(weeks))
     .write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
     .partitionBy("run_date", "weeks", "run_id").parquet(path))


def latest_forecast(snapshots: DataFrame, run_date, weeks: int) -> DataFrame:
    """Rows of the newest run of a day and horizon, most needed first. The filter prunes the
    partitions of the snapshot table."""
    runs = snapshots.filter((F.col("run_date") == F.lit(run_date)) & (F.col("weeks") == weeks))
    newest = runs.agg(F.max_by("run_id", "created_at")).scalar()
    return (runs.filter(F.col("run_id") == newest)
            .select("sku", "name", "weekly_forecast", "stock_coverage")
            .orderBy(F.desc("stock_coverage"), "name", "sku"))


def stock_by_sku(erp: dict[str, DataFrame], wanted: DataFrame) -> DataFrame:
    """Stock of the requested SKUs (column ``sku``), compared without case or outer blanks and
    shown as requested. Articles without stock give 0; unknown SKUs are left out."""
    units = (erp["lagerp"].groupBy("IdSerie").agg(F.sum("Bestand").alias("_units"))
             .join(erp["serie"], F.col("IdSerie") == F.col("Id"))
             .groupBy(F.lower(F.trim("Artikelnummer")).alias("_key")).agg(F.sum("_units").alias("_units")))
    known = erp["art"].select(F.lower(F.trim("Artikelnummer")).alias("_key")).distinct()
    asked = wanted.select(F.trim("sku").alias("sku")).distinct().withColumn("_key", F.lower("sku"))
    return (asked.join(known, "_key", "left_semi").join(units, "_key", "left")
            .select("sku", F.coalesce("_units", F.lit(0)).alias("current_stock")))


def unknown_skus(erp: dict[str, DataFrame], wanted: DataFrame) -> DataFrame:
    """Requested SKUs that no article has."""
    asked = wanted.select(F.trim("sku").alias("sku")).distinct().withColumn("_key", F.lower("sku"))
    known = erp["art"].select(F.lower(F.trim("Artikelnummer")).alias("_key"))
    return missing_ids(asked, known, "_key").select("sku")


def article_attributes(art: DataFrame) -> DataFrame:
    """The attributes that article filters ask for, read from each name as columns."""
    name, group = F.col("Bezeichnung"), F.col("ArtikelGruppe")

    def found(category: str, pattern: str, index: int = 1) -> Column:
        text = F.regexp_extract(name, pattern, index)
        return F.when((group == category) & (text != ""), text)

    intel = r"(?i)^Intel Core (?:i|Ultra )(\d+)[- ](\d+(?:[A-Z][A-Z0-9]*)?)(?: .*)?$"
    amd = r"(?i)^AMD Ryzen (\d+) (\d+(?:[A-Z][A-Z0-9]*)?)(?: .*)?$"
    vram = F.coalesce(found("GC", r"(?i)(\d+)GB").cast("int"),
                      F.when((group == "GC") & name.ilike("%1024MB%"), 1)
                      .when((group == "GC") & name.ilike("%2048MB%"), 2))
    return art.select(
        F.col("Artikelnummer").alias("sku"), group.alias("category"),
        F.when((group == "CP") & name.ilike("Intel Core %"), "Intel")
        .when((group == "CP") & name.ilike("AMD Ryzen %"), "AMD").alias("cpu_manufacturer"),
        F.coalesce(found("CP", intel, 1), found("CP", amd, 1)).cast("int").alias("cpu_generation"),
        F.upper(F.coalesce(found("CP", intel, 2), found("CP", amd, 2))).alias("cpu_model"),
        found("ME", r"(?i)^(\d+)GB").cast("int").alias("ram_capacity"),
        found("ME", r"(?i)DDR(\d)").cast("int").alias("ram_ddr"),
        found("ME", r"(?i)DDR\d (\d+)").cast("int").alias("ram_speed"),
        F.upper(found("HD", r"(?i)(HDD|SSD)")).alias("hdd_type"),
        found("HD", r"(?i)^(\d+)Gb (?:HDD|SSD)").cast("int").alias("hdd_capacity"),
        F.when((group == "GC") & name.ilike("Radeon %"), "AMD")
        .when((group == "GC") & (name.ilike("Geforce %") | name.ilike("Quadro %")
                                 | name.ilike("Nvidia %")), "NVIDIA").alias("gpu_manufacturer"),
        F.initcap(found("GC", r"(?i)^(Geforce|Radeon|Quadro|Nvidia) ")).alias("gpu_series"),
        vram.alias("gpu_vram"))


def canonical_case(art: DataFrame) -> DataFrame:
    """Cases with maker and model in the spelling of the reference list, compared without
    case; a longer name matches the longest listed start. Unlisted names are flagged.

    The list is fixed (about 130 names), so it is a literal array in the expression.
    """
    listed = F.array(*[F.struct(F.lit(f"{maker} {model}".lower()).alias("key"),
                                F.lit(maker).alias("maker"), F.lit(model).alias("model"))
                       for maker, models in K.CASE_MODELS.items() for model in models])
    name = F.lower(F.trim("Bezeichnung"))
    hits = F.filter(listed, lambda c: (name == c["key"]) | name.startswith(F.concat(c["key"], F.lit(" "))))
    best = F.array_max(F.transform(hits, lambda c: F.struct(
        F.length(c["key"]).alias("size"), c["maker"].alias("maker"), c["model"].alias("model"))))
    return (art.filter(F.col("ArtikelGruppe") == "TW").withColumn("_hit", best)
            .select(F.col("Artikelnummer").alias("sku"), F.col("Bezeichnung").alias("name"),
                    F.col("_hit.maker").alias("case_manufacturer"), F.col("_hit.model").alias("case_model"),
                    F.col("_hit").isNotNull().alias("listed")))
