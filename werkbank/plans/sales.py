"""Order lists, counts, sales analysis and customer e-mails."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from werkbank.functions import constants as K
from werkbank.functions.dates import bucket, date_bounds, date_range
from werkbank.functions.predicates import genuine_orders, lifecycle, name_matches
from werkbank.functions.text import full_name, listed_name, matches
from werkbank.operators.keyed import latest_by
from werkbank.operators.ordered import spread_join
from werkbank.operators.shaping import sort_head

METRICS = {"revenue": "EuroBrutto", "selling_price": "EuroBrutto",
           "production_cost": "UebernahmeOffen", "gross_profit": "ErloesEuro"}
GROUPS = ("year", "month", "week", "day", "platform", "country", "city", "postcode")
FILTERS = {"country": "Land", "city": "Ort", "postcode": "PLZ", "customer_number": "Adressnummer",
           "document_type": "Belegtyp", "status": "Status", "platform": "platform"}


#: Channels that travel as one map.
CHANNELS = 10_000


def _group_column(name: str) -> Column:
    created = F.col("AngelegtAm")
    return {
        "year": F.year(created), "month": F.month(created),
        "day": F.date_format(created, "yyyy-MM-dd"),
        "week": F.date_format(F.date_trunc("week", created), "yyyy-MM-dd"),
        "country": F.col("Land"), "city": F.col("Ort"), "postcode": F.col("PLZ"),
    }[name].alias(name)


def apply_filters(df: DataFrame, filters: dict, columns: dict[str, str] = FILTERS) -> DataFrame:
    """Exact-match filters by public name; a name outside the list raises."""
    for name, value in filters.items():
        if name not in columns:
            raise ValueError(f"no such filter: {name}")
        df = df.filter(F.col(columns[name]) == value)
    return df


def analyze_sales(erp: dict[str, DataFrame], metrics=("revenue", "order_count"),
                  group_by=("year", "month"), filters: dict | None = None, date_from=None,
                  date_to=None, document_type: str | None = "R", status: int | None = None,
                  sort_by: str | None = None, sort_direction: str = "asc",
                  limit: int | None = None) -> DataFrame:
    """Sums of order values and order counts by period, channel and place.

    Orders of an unknown channel are left out. Headers are summed per channel number before
    the channel table is joined, so the join sees one row per group and channel, not one per
    order. A sum over only NULL is NULL; no groups give one row even for no orders.
    """
    lo, hi = date_bounds(date_from, date_to)
    metrics, groups = list(metrics), list(group_by)
    if not metrics or set(metrics) - set(METRICS) - {"order_count"}:
        raise ValueError("unknown or missing metrics")
    if set(groups) - set(GROUPS):
        raise ValueError("unknown group")
    if "month" in groups and "year" not in groups:
        groups.insert(groups.index("month"), "year")
    if limit is not None and limit < 1:
        raise ValueError("a limited analysis keeps at least one row")
    filters = dict(filters or {})
    by_platform = {k: filters.pop(k) for k in list(filters) if k == "platform"}

    orders = erp["beleg"].filter(genuine_orders("analysis") & date_range(F.col("AngelegtAm"), lo, hi))
    if document_type is not None:
        orders = orders.filter(F.col("Belegtyp") == document_type)
    if status is not None:
        orders = orders.filter(F.col("Status") == int(status))
    orders = apply_filters(orders, filters)

    own = [g for g in groups if g != "platform"]
    sums = sorted({METRICS[m] for m in metrics if m in METRICS})
    partial = orders.groupBy("Vertreter", *[_group_column(g) for g in own]).agg(
        F.count("*").alias("_orders"), *[F.sum(c).alias(c) for c in sums])
    channels = erp["mitarbw"].select(F.col("Nr").alias("Vertreter"), F.col("Name").alias("platform"))
    known = apply_filters(partial.join(channels, "Vertreter", "inner"), by_platform)
    totals = [F.coalesce(F.sum("_orders"), F.lit(0)).alias(m) if m == "order_count"
              else F.sum(METRICS[m]).alias(m) for m in metrics]
    result = known.groupBy(*groups).agg(*totals) if groups else known.agg(*totals)
    if sort_by is None and limit is None:
        return result
    return sort_head(result, sort_by, groups, sort_direction == "desc", limit)


def order_list_filter(erp: dict[str, DataFrame], number=None, document_type=None, status=None,
                      customer_name=None, date_from=None, date_to=None) -> DataFrame:
    """Headers that pass the given filters. The exclusion of internal documents applies only
    when there is some filter."""
    lo, hi = date_bounds(date_from, date_to)
    orders, given = erp["beleg"], False
    if number:
        orders, given = orders.filter(matches(F.col("Belegnummer"), f"%{number.strip()}%")), True
    if document_type is not None:
        orders, given = orders.filter(F.col("Belegtyp") == document_type), True
    if status is not None:
        orders, given = orders.filter(F.col("Status") == int(status)), True
    if customer_name:
        orders, given = orders.filter(name_matches(customer_name)), True
    if lo is not None or hi is not None:
        orders, given = orders.filter(date_range(F.col("AngelegtAm"), lo, hi)), True
    return orders.filter(genuine_orders("list")) if given else orders


def filter_orders(erp: dict[str, DataFrame], lifecycle_state=None, number=None, document_type=None,
                  status=None, customer_name=None, date_from=None, date_to=None,
                  sort: str = "newest", limit: int = 20) -> DataFrame:
    """The ``limit`` newest or oldest orders that match; equal times by document number."""
    if limit < 1:
        raise ValueError("an order list has at least one row")
    kind, state = lifecycle(lifecycle_state, document_type, status)
    found = order_list_filter(erp, number, kind, state, customer_name, date_from, date_to)
    created = F.col("AngelegtAm")
    order = {"newest": created.desc(), "oldest": created.asc()}[sort]
    top = found.orderBy(order, "Belegnummer").limit(limit)
    return top.select(
        F.col("Belegnummer").alias("document_number"), F.col("IhrAuftrag").alias("order_number"),
        F.col("Belegtyp").alias("document_type"), F.col("Status").alias("order_status"),
        created.alias("creation_date"),
        listed_name(F.col("Name"), F.col("Vorname")).alias("customer_name"),
        F.col("Land").alias("country"), F.col("Strasse").alias("address"),
        F.col("EuroBrutto").alias("selling_price"), F.col("UebernahmeOffen").alias("production_cost"),
        F.col("ErloesEuro").alias("gross_profit"))


def count_orders(erp: dict[str, DataFrame], lifecycle_state=None, document_type=None, status=None,
                 date_from=None, date_to=None) -> DataFrame:
    """One row with the number of matching orders."""
    kind, state = lifecycle(lifecycle_state, document_type, status)
    return order_list_filter(erp, None, kind, state, None, date_from, date_to).agg(
        F.count("*").alias("order_count"))


def interpret_state(df: DataFrame, document_type: str = "document_type",
                    status: str = "order_status") -> DataFrame:
    """Add labels of the (type, status) pair. The table of states is fixed and small, so it is
    an expression, not a join."""
    kind, state = F.col(document_type), F.col(status)
    names = ("document_type_label", "document_status_label", "lifecycle_state", "lifecycle_label",
             "is_current_stage")
    unknown = F.concat(F.lit("Unknown combination: "), F.coalesce(kind, F.lit("None")), F.lit("/"),
                       F.coalesce(state.cast("string"), F.lit("None")))
    fallback = (F.lit("Unknown document type"), F.lit("Unknown status"), F.lit("unknown"), unknown,
                F.lit(False))
    for i, (name, default) in enumerate(zip(names, fallback)):
        column = F.when(F.lit(False), default)
        for known_kind, known_state, *labels in K.ORDER_STATES:
            column = column.when((kind == known_kind) & (state == known_state), F.lit(labels[i]))
        df = df.withColumn(name, column.otherwise(default))
    return df


def with_platform(headers: DataFrame, mitarbw: DataFrame, most: int | None = None) -> DataFrame:
    """Headers with the name of their channel, NULL for an unknown one. A few channels hold most
    headers, so the headers are not dealt by channel: up to ``most`` channels (by default ``CHANNELS``) go to them as one
    map. A larger channel table is joined, the rows of crowded channels dealt over pieces. Which of both
    it is comes from a count of the channels up to that number; the result is the same."""
    most = CHANNELS if most is None else most
    channels = mitarbw.filter("Nr IS NOT NULL").select(F.col("Nr").alias("Vertreter"), F.col("Name").alias("platform"))
    if channels.limit(most + 1).count() > most:
        return spread_join(headers, channels, ["Vertreter"], "Belegnummer", "left")
    names = channels.agg(F.map_from_entries(F.collect_list(F.struct("Vertreter", "platform")))).scalar()
    return headers.withColumn("platform", F.try_element_at(names, F.col("Vertreter")))


def order_header(beleg: DataFrame, mitarbw: DataFrame) -> DataFrame:
    """The newest header per document number with platform, customer and state labels. An
    unknown channel keeps the order."""
    # Only what is shown, as the newest row is carried whole.
    shown = beleg.select("Belegnummer", "IhrAuftrag", "Belegtyp", "Status", "AngelegtAm", "Vorname", "Name", "Land", "EuroBrutto",
                         "UebernahmeOffen", "ErloesEuro", "_TRACKING", "FreierText1", "_FIRMENNAME", "_EMAIL1", "_MOBILNUMMER",
                         "Sprache", "Vertreter")
    newest = latest_by(shown, ["Belegnummer"], ["AngelegtAm", "Belegtyp"])
    trimmed = lambda column, name: F.trim(F.col(column)).alias(name)
    header = with_platform(newest, mitarbw).select(
        trimmed("Belegnummer", "document_number"), trimmed("IhrAuftrag", "order_number"),
        F.upper(F.trim("Belegtyp")).alias("document_type"), F.col("Status").alias("order_status"),
        F.col("AngelegtAm").alias("date_created"),
        full_name(F.col("Vorname"), F.col("Name")).alias("customer_name"),
        trimmed("Land", "country"), F.col("EuroBrutto").alias("selling_price"),
        F.col("UebernahmeOffen").alias("production_cost"), F.col("ErloesEuro").alias("gross_profit"),
        trimmed("_TRACKING", "tracking_number"), trimmed("FreierText1", "tax_number"),
        trimmed("_FIRMENNAME", "company_name"), trimmed("_EMAIL1", "email"),
        trimmed("_MOBILNUMMER", "phone_number"), trimmed("Sprache", "language"),
        trimmed("platform", "platform"))
    return interpret_state(header)


def lifecycle_breakdown(erp: dict[str, DataFrame], date_from=None, date_to=None) -> DataFrame:
    """Orders per document type and status with labels; stages are not added together."""
    lo, hi = date_bounds(date_from, date_to)
    counted = (erp["beleg"].filter(F.col("Belegtyp").isin("D", "L", "R"))
               .filter(genuine_orders("list") & date_range(F.col("AngelegtAm"), lo, hi))
               .groupBy(F.col("Belegtyp").alias("document_type"), F.col("Status").alias("order_status"))
               .agg(F.count("*").alias("order_count")))
    return interpret_state(counted)


def orders_over_time(erp: dict[str, DataFrame], grain: str, date_from=None, date_to=None,
                     document_type: str = "R", limit: int | None = None) -> DataFrame:
    """Orders per day, week (Monday) or month; orders without a date are left out. ``limit``
    keeps the first buckets, as a chart does."""
    if grain not in ("day", "week", "month"):
        raise ValueError(f"orders are counted by day, week or month, not {grain!r}")
    lo, hi = date_bounds(date_from, date_to)
    counted = (erp["beleg"].filter(F.col("Belegtyp") == document_type)
               .filter(genuine_orders("analysis") & date_range(F.col("AngelegtAm"), lo, hi))
               .filter(F.col("AngelegtAm").isNotNull())
               .groupBy(bucket(F.col("AngelegtAm"), grain).alias("period"))
               .agg(F.count("*").alias("orders")))
    return counted if limit is None else counted.orderBy("period").limit(limit)


def tickets_by_email(contacts: DataFrame, tickets: DataFrame) -> DataFrame:
    """Distinct (email, ticket_id) over all contacts of an address."""
    known = contacts.select("email", "contact_id").distinct()
    owned = tickets.select("contact_id", "ticket_id").distinct()
    return known.join(owned, "contact_id").select("email", "ticket_id").distinct()


def email_contacts(erp: dict[str, DataFrame], contacts: DataFrame, tickets: DataFrame,
                   date_from=None, date_to=None) -> DataFrame:
    """E-mails of the own shop's invoices with whether the address ever opened a ticket.

    Invoices are not de-duplicated: ``invoices`` is how often an address occurs. Counting
    before the look-up means that an address on very many invoices meets the tickets once.
    """
    lo, hi = date_bounds(date_from, date_to)
    invoices = (erp["beleg"].filter(genuine_orders("email") & date_range(F.col("Datum"), lo, hi))
                .groupBy(F.col("_EMAIL1").alias("email")).agg(F.count("*").alias("invoices")))
    with_ticket = tickets.select("contact_id").distinct()
    served = (contacts.select("email", "contact_id").distinct().join(with_ticket, "contact_id", "left_semi")
              .select("email").distinct().withColumn("_served", F.lit(True)))
    return invoices.join(served, "email", "left").select(
        "email", "invoices", F.coalesce("_served", F.lit(False)).alias("customer_service"))
