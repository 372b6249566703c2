"""SQL twins of the registered queries, for an independent check on small data."""

from __future__ import annotations

from werkbank import oracle_erp as V
from werkbank.functions.constants import CASE_MODELS

ORACLE: dict[str, str] = {}

_sales_views = V.with_views(V.MITARBW, V.BELEG)
_METRICS = {
    "revenue": "CAST(sum(EuroBrutto) AS DOUBLE) AS revenue",
    "selling_price": "CAST(sum(EuroBrutto) AS DOUBLE) AS selling_price",
    "production_cost": "CAST(sum(UebernahmeOffen) AS DOUBLE) AS production_cost",
    "gross_profit": "CAST(sum(ErloesEuro) AS DOUBLE) AS gross_profit",
    "order_count": "count(*) AS order_count",
}
_GROUPS = {
    "year": "CAST(year(AngelegtAm) AS INTEGER) AS year", "month": "CAST(month(AngelegtAm) AS INTEGER) AS month",
    "week": "strftime(date_trunc('week', AngelegtAm), '%Y-%m-%d') AS week",
    "day": "strftime(AngelegtAm, '%Y-%m-%d') AS day", "platform": "m.Name AS platform",
    "country": "Land AS country", "city": "Ort AS city", "postcode": "PLZ AS postcode",
}


def _analysis(metrics, groups, where="Belegtyp = 'R'", tail=""):
    columns = [_GROUPS[g] for g in groups] + [_METRICS[m] for m in metrics]
    by = "GROUP BY " + ", ".join(str(i + 1) for i in range(len(groups))) if groups else ""
    return (f"{_sales_views}SELECT {', '.join(columns)} FROM beleg JOIN mitarbw m ON Vertreter = m.Nr "
            f"WHERE {V.SALES} AND Netto <> 0 AND {where} {by} {tail}")


_ALL = list(_METRICS)
ORACLE["analyze_sales_month"] = _analysis(["revenue", "order_count"], ["year", "month"])
ORACLE["analyze_sales_week"] = _analysis(_ALL, ["week"])
ORACLE["analyze_sales_day"] = _analysis(
    _ALL, ["day", "platform"], "AngelegtAm >= TIMESTAMP '1996-01-01' AND AngelegtAm < TIMESTAMP '2000-07-01'")
ORACLE["analyze_sales_platform"] = _analysis(_ALL, ["platform", "country"])
ORACLE["analyze_sales_place"] = _analysis(["revenue", "gross_profit"], ["city", "postcode"],
                                          "Belegtyp = 'L' AND Status = 0")
ORACLE["analyze_sales_filtered"] = _analysis(
    _ALL, ["year"], "Belegtyp = 'D' AND m.Name = 'Building' AND Status = 0")
ORACLE["analyze_sales_total"] = _analysis(_ALL, [])
ORACLE["analyze_sales_top_cities"] = _analysis(
    ["revenue", "order_count"], ["city"], tail="ORDER BY revenue DESC, city LIMIT 10")
ORACLE["sales_chart_month"] = f"""
SELECT strftime(make_date(year, month, 1), '%b %Y') AS x, y, series FROM (
  SELECT year, month, revenue AS y, 'revenue' AS series, 1 AS r FROM ({_analysis(["revenue"], ["year", "month"])})
  UNION ALL
  SELECT year, month, CAST(order_count AS DOUBLE), 'order_count', 2
  FROM ({_analysis(["order_count"], ["year", "month"])}))
WHERE y IS NOT NULL ORDER BY year, month, r"""

_LIST = f"{V.SALES} AND Adressnummer <> 'K000000'"
_LIST_COLUMNS = """SELECT Belegnummer AS document_number, IhrAuftrag AS order_number, Belegtyp AS document_type,
  Status AS order_status, strftime(AngelegtAm, '%Y-%m-%d %H:%M:%S') AS creation_date,
  trim(coalesce(Name, '') || ' ' || coalesce(Vorname, '')) AS customer_name, Land AS country,
  Strasse AS address, CAST(EuroBrutto AS DOUBLE) AS selling_price,
  CAST(UebernahmeOffen AS DOUBLE) AS production_cost, CAST(ErloesEuro AS DOUBLE) AS gross_profit FROM beleg"""
_beleg = V.with_views(V.BELEG)
ORACLE["filter_orders_newest"] = (f"{_beleg}{_LIST_COLUMNS} WHERE {_LIST} AND Belegtyp = 'R' AND Status = 0 "
                                  "ORDER BY AngelegtAm DESC, Belegnummer LIMIT 250")
ORACLE["filter_orders_customer"] = f"""{_beleg}{_LIST_COLUMNS} WHERE {_LIST} AND Belegtyp = 'L'
  AND Belegnummer ILIKE '%la0%' AND AngelegtAm >= TIMESTAMP '1996-01-01' AND AngelegtAm < TIMESTAMP '2001-01-01'
  AND (trim(coalesce(Name, '') || ' ' || coalesce(Vorname, '')) ILIKE '%ben customer#%'
    OR trim(coalesce(Vorname, '') || ' ' || coalesce(Name, '')) ILIKE '%ben customer#%'
    OR Name ILIKE '%ben customer#%' OR Vorname ILIKE '%ben customer#%')
  ORDER BY AngelegtAm, Belegnummer LIMIT 50"""
ORACLE["count_orders_production"] = (f"{_beleg}SELECT count(*) AS order_count FROM beleg "
                                     f"WHERE {_LIST} AND Belegtyp = 'L' AND Status = 0")
ORACLE["count_orders_period"] = (
    f"{_beleg}SELECT count(*) AS order_count FROM beleg WHERE {_LIST} AND Belegtyp = 'R' "
    "AND AngelegtAm >= TIMESTAMP '1997-03-01' AND AngelegtAm < TIMESTAMP '1998-03-01'")
ORACLE["lifecycle_breakdown"] = f"""{_beleg}
SELECT t AS document_type, Status AS order_status, n AS order_count, {V.STATE_COLUMNS}
FROM (SELECT Belegtyp AS t, Status, CAST(Status AS VARCHAR) AS s, count(*) AS n FROM beleg
      WHERE {_LIST} AND Belegtyp IN ('D', 'L', 'R')
        AND AngelegtAm >= TIMESTAMP '1996-01-01' AND AngelegtAm < TIMESTAMP '2001-02-01'
      GROUP BY Belegtyp, Status)"""
for _grain in ("day", "week", "month"):
    ORACLE[f"orders_over_time_{_grain}"] = (
        f"{_beleg}SELECT strftime(date_trunc('{_grain}', AngelegtAm), '%Y-%m-%d') AS period, count(*) AS orders "
        f"FROM beleg WHERE {V.SALES} AND Netto <> 0 AND Belegtyp = 'R' GROUP BY 1 ORDER BY 1")
_HEADER = f"""SELECT Belegnummer AS document_number, IhrAuftrag AS order_number, t AS document_type,
  Status AS order_status, strftime(AngelegtAm, '%Y-%m-%d %H:%M:%S') AS date_created,
  CASE WHEN trim(coalesce(Vorname, '')) = '' THEN nullif(trim(Name), '') ELSE trim(Vorname) || ' ' || trim(Name) END
    AS customer_name,
  Land AS country, CAST(EuroBrutto AS DOUBLE) AS selling_price, CAST(UebernahmeOffen AS DOUBLE) AS production_cost,
  CAST(ErloesEuro AS DOUBLE) AS gross_profit, tracking AS tracking_number, FreierText1 AS tax_number,
  firma AS company_name, email, phone AS phone_number, Sprache AS language, platform, {V.STATE_COLUMNS}
FROM (SELECT newest.*, m.Name AS platform, Belegtyp AS t, CAST(Status AS VARCHAR) AS s
      FROM newest LEFT JOIN mitarbw m ON Vertreter = m.Nr)"""
ORACLE["stored_headers"] = V.with_views(V.BELEG, V.PURCHASE, V.HEADERS, V.SALES_LINES, V.ORIGINAL_LINES, V.PURCHASE_LINES) + """
SELECT Belegtyp AS document_type, headers, value, lines, units
FROM (SELECT Belegtyp, count(*) AS headers, CAST(sum(EuroBrutto) AS DOUBLE) AS value FROM heads GROUP BY 1)
LEFT JOIN (SELECT Belegtyp, count(*) AS lines, CAST(sum(Menge) AS DOUBLE) AS units FROM (
  SELECT Belegtyp, Menge FROM sales_lines UNION ALL SELECT Belegtyp, Menge FROM original_lines
  UNION ALL SELECT 'B', Menge FROM purchase_lines) GROUP BY 1) USING (Belegtyp)"""
ORACLE["stored_relations"] = V.with_views(V.ART, V.BELEG, V.PURCHASE, V.HEADERS, V.SALES_LINES, V.ORIGINAL_LINES, V.PURCHASE_LINES, V.SERIE,
                                          V.LAGERP, V.MITARBW) + """
SELECT 'art' AS relation, count(*) AS row_count, CAST(NULL AS DOUBLE) AS total, count(DISTINCT HstArtikelnummer) AS distinct_values FROM art
UNION ALL SELECT 'beleg', count(*), CAST(sum(EuroBrutto) AS DOUBLE), count(DISTINCT Belegnummer) FROM heads
UNION ALL SELECT 'belegp', count(*), CAST(sum(CAST(Menge AS DECIMAL(18,2))) AS DOUBLE), count(DISTINCT Artikelnummer) FROM (
  SELECT Menge, Artikelnummer FROM sales_lines UNION ALL SELECT Menge, Artikelnummer FROM original_lines
  UNION ALL SELECT Menge, Artikelnummer FROM purchase_lines)
UNION ALL SELECT 'serie', count(*), CAST(sum(Id) AS DOUBLE), count(DISTINCT Artikelnummer) FROM serie
UNION ALL SELECT 'lagerp', count(*), CAST(sum(Wert) AS DOUBLE), count(DISTINCT IdSerie) FROM lagerp
UNION ALL SELECT 'mitarbw', count(*), CAST(sum(Nr) AS DOUBLE), count(DISTINCT Name) FROM mitarbw"""
ORACLE["order_headers"] = V.with_views(V.MITARBW, V.BELEG, V.PURCHASE, V.HEADERS) + _HEADER

# ---- inventory -----------------------------------------------------------------------------

_stock_views = V.with_views(V.ART, V.SERIE, V.LAGERP, V.PURCHASE, V.PURCHASE_LINES)


def _search(where):
    return f"""{_stock_views}
SELECT s.Artikelnummer AS sku, s.Bezeichnung AS name, s.EANNummer AS ean, s.HstArtikelnummer AS producer_ean,
  item_count, minimum_price, maximum_price, average_price, ordered_amount
FROM (SELECT Bezeichnung, a.Artikelnummer, EANNummer, HstArtikelnummer,
        CAST(sum(Bestand) AS DOUBLE) AS item_count, CAST(min(Wert) AS DOUBLE) AS minimum_price,
        CAST(max(Wert) AS DOUBLE) AS maximum_price, CAST(sum(Wert) AS DOUBLE) / count(Wert) AS average_price
      FROM lagerp JOIN serie ON Id = IdSerie JOIN art a ON a.Artikelnummer = serie.Artikelnummer
      WHERE SCTyp <> 'O' AND Bestand > 0 AND AngelegtAm >= TIMESTAMP '2001-08-02' - INTERVAL 5000 DAY AND {where}
      GROUP BY ALL) s
LEFT JOIN (SELECT p.Artikelnummer, CAST(coalesce(sum(Menge), 0) AS DOUBLE) AS ordered_amount
      FROM purchase JOIN purchase_lines p ON p.Belegnummer = purchase.Belegnummer
      WHERE UebernahmeOffen < 0 AND p.Artikelnummer IN (
        SELECT a.Artikelnummer FROM lagerp JOIN serie ON Id = IdSerie JOIN art a ON a.Artikelnummer = serie.Artikelnummer
        WHERE Wert <> 0 AND {where})
      GROUP BY p.Artikelnummer) o ON o.Artikelnummer = s.Artikelnummer"""


ORACLE["search_inventory_cpu"] = _search("ArtikelGruppe = 'CP' AND Bezeichnung ILIKE 'Intel Core i9-%'")
ORACLE["search_inventory_cpu_model"] = _search(
    "ArtikelGruppe = 'CP' AND regexp_matches(Bezeichnung, '^Intel Core (i.*-|Ultra .* )14900KF( .*)?$')")
ORACLE["search_inventory_amd"] = _search("ArtikelGruppe = 'CP' AND Bezeichnung ILIKE 'AMD Ryzen 7 %'")
ORACLE["search_inventory_ram"] = _search(
    "ArtikelGruppe = 'ME' AND Bezeichnung ILIKE '32GB%' AND Bezeichnung ILIKE '%DDR5%'")
ORACLE["search_inventory_disk"] = _search("ArtikelGruppe = 'HD' AND Bezeichnung ILIKE '1000Gb SSD%'")
ORACLE["search_inventory_gpu"] = _search(
    "ArtikelGruppe = 'GC' AND regexp_matches(Bezeichnung, '^(Geforce|Quadro|Nvidia) ') AND Bezeichnung ILIKE '%8GB%'")
ORACLE["search_inventory_gpu_small"] = _search(
    "ArtikelGruppe = 'GC' AND regexp_matches(Bezeichnung, '^(Geforce|Quadro|Nvidia) ') AND Bezeichnung ILIKE '%2048MB%'")
ORACLE["search_inventory_case"] = _search(
    "ArtikelGruppe = 'TW' AND (lower(Bezeichnung) = 'coolermaster elite 302' "
    "OR Bezeichnung ILIKE 'CoolerMaster Elite 302 %')")
ORACLE["search_inventory_name"] = _search("ArtikelGruppe = 'MB' AND Bezeichnung ILIKE '%widget%'")

ORACLE["search_inventory_ean"] = _search("EANNummer = '0000000000007'")
ORACLE["search_inventory_producer_ean"] = _search("HstArtikelnummer = 'Brand#16-31'")
ORACLE["search_inventory_amd_model"] = _search(
    "ArtikelGruppe = 'CP' AND regexp_matches(Bezeichnung, '^AMD Ryzen .* 7700X( .*)?$')")
ORACLE["search_inventory_maker"] = _search("ArtikelGruppe = 'CP' AND Bezeichnung ILIKE 'AMD Ryzen %'")
ORACLE["search_inventory_ram_speed"] = _search("ArtikelGruppe = 'ME' AND Bezeichnung ILIKE '%5600%'")
ORACLE["search_inventory_gpu_model"] = _search(
    "ArtikelGruppe = 'GC' AND regexp_matches(Bezeichnung, '^(Geforce|Quadro|Nvidia) ') AND Bezeichnung ILIKE '%4060%'")
ORACLE["search_inventory_radeon"] = _search("ArtikelGruppe = 'GC' AND Bezeichnung ILIKE 'Radeon %'")
ORACLE["search_inventory_gpu_least"] = _search("ArtikelGruppe = 'GC' AND Bezeichnung ILIKE '%1024MB%'")

_line_views = V.with_views(V.ART, V.SALES_LINES)


def _component_sales(grain, where):
    period = ("CAST(NULL AS VARCHAR)" if grain == "total"
              else f"strftime(date_trunc('{grain}', Datum), '%Y-%m-%d')")
    return f"""{_line_views}SELECT a.Artikelnummer AS sku, a.Bezeichnung AS name, {period} AS period,
  CAST(sum(Menge) AS DOUBLE) AS sold_amount
FROM sales_lines l JOIN art a ON a.Artikelnummer = l.Artikelnummer
WHERE Belegtyp = 'R' AND Datum >= TIMESTAMP '1996-01-01' AND Datum < TIMESTAMP '2001-01-01' AND {where}
GROUP BY 1, 2, 3"""


ORACLE["component_sales_day"] = _component_sales("day", "ArtikelGruppe = 'CP'")
ORACLE["component_sales_week"] = _component_sales("week", "ArtikelGruppe = 'ME' AND a.Bezeichnung LIKE '%DDR5%'")
ORACLE["component_sales_month"] = _component_sales(
    "month", "ArtikelGruppe = 'GC' AND a.Bezeichnung NOT LIKE 'Radeon %'")
ORACLE["component_sales_year"] = _component_sales("year", "ArtikelGruppe = 'HD' AND a.Bezeichnung LIKE '%SSD%'")
ORACLE["component_sales_total"] = _component_sales("total", "ArtikelGruppe = 'TW'")

ORACLE["component_sales_chart"] = f"""SELECT period AS x, sold_amount AS y, sku || ' - ' || name AS series
FROM ({_component_sales("year", "ArtikelGruppe = 'MB'")})"""

_FORECAST_VIEWS = V.with_views(V.ART, V.SALES_LINES, V.SERIE, V.LAGERP, V.PURCHASE, V.PURCHASE_LINES)


def _forecast_body(day, weeks):
    now = f"TIMESTAMP '{day}'"
    return f"""SELECT sku, name, weekly_forecast, weekly_forecast - stock - incoming AS stock_coverage FROM (
  SELECT a.Artikelnummer AS sku, a.Bezeichnung AS name,
    (CAST(u1 AS DOUBLE) / 4 * 0.5::DOUBLE + CAST(u2 AS DOUBLE) / 4 * 0.3::DOUBLE
      + CAST(u3 AS DOUBLE) / 4 * 0.2::DOUBLE) * {weeks} AS weekly_forecast,
    CAST(coalesce(stock, 0) AS DOUBLE) AS stock, CAST(coalesce(incoming, 0) AS DOUBLE) AS incoming
  FROM (SELECT Artikelnummer, sum(Menge) AS sold,
          sum(CASE WHEN Datum >= {now} - INTERVAL 28 DAY THEN Menge ELSE 0 END) AS u1,
          sum(CASE WHEN Datum >= {now} - INTERVAL 56 DAY AND Datum < {now} - INTERVAL 28 DAY THEN Menge ELSE 0 END) AS u2,
          sum(CASE WHEN Datum < {now} - INTERVAL 56 DAY THEN Menge ELSE 0 END) AS u3
        FROM sales_lines WHERE Belegtyp = 'R' AND Datum >= {now} - INTERVAL 84 DAY GROUP BY 1 HAVING sum(Menge) >= 2) u
  JOIN art a ON a.Artikelnummer = u.Artikelnummer
  LEFT JOIN (SELECT Artikelnummer, sum(Bestand) AS stock FROM lagerp JOIN serie ON Id = IdSerie GROUP BY 1) s
    ON s.Artikelnummer = u.Artikelnummer
  LEFT JOIN (SELECT Artikelnummer, sum(Menge) AS incoming FROM purchase_lines l JOIN purchase p
      ON p.Belegnummer = l.Belegnummer WHERE UebernahmeOffen < 0 GROUP BY 1) i ON i.Artikelnummer = u.Artikelnummer)
WHERE weekly_forecast - stock - incoming > 0"""


ORACLE["forecast_components"] = _FORECAST_VIEWS + _forecast_body("2001-08-02", 2)
_asked = """asked AS (
  SELECT lower((['CP','GC','ME','HD','MB','TW'])[p_partkey % 6 + 1] || lpad(CAST(p_partkey AS VARCHAR), 12, '0')) AS sku
  FROM part UNION SELECT 'XX' || CAST(s_suppkey AS VARCHAR) FROM supplier)"""
ORACLE["stock_by_sku"] = V.with_views(V.ART, V.SERIE, V.LAGERP, _asked) + """
SELECT asked.sku, CAST(coalesce(sum(Bestand), 0) AS DOUBLE) AS current_stock
FROM asked JOIN art ON lower(art.Artikelnummer) = lower(asked.sku)
LEFT JOIN serie ON serie.Artikelnummer = art.Artikelnummer LEFT JOIN lagerp ON IdSerie = Id GROUP BY 1"""
ORACLE["unknown_skus"] = V.with_views(V.ART, _asked) + """
SELECT sku FROM asked WHERE lower(sku) NOT IN (SELECT lower(Artikelnummer) FROM art)"""

_CPU = r"^Intel Core (?:i|Ultra )(\d+)[- ](\d+(?:[A-Z][A-Z0-9]*)?)(?: .*)?$"
_AMD = r"^AMD Ryzen (\d+) (\d+(?:[A-Z][A-Z0-9]*)?)(?: .*)?$"


def _taken(category, pattern, group=1):
    return (f"CASE WHEN ArtikelGruppe = '{category}' THEN "
            f"nullif(regexp_extract(Bezeichnung, '{pattern}', {group}), '') END")


ORACLE["article_attributes"] = V.with_views(V.ART) + f"""
SELECT Artikelnummer AS sku, ArtikelGruppe AS category,
  CASE WHEN ArtikelGruppe = 'CP' AND Bezeichnung LIKE 'Intel Core %' THEN 'Intel'
    WHEN ArtikelGruppe = 'CP' AND Bezeichnung LIKE 'AMD Ryzen %' THEN 'AMD' END AS cpu_manufacturer,
  coalesce({_taken('CP', _CPU)}, {_taken('CP', _AMD)}) AS cpu_generation,
  coalesce({_taken('CP', _CPU, 2)}, {_taken('CP', _AMD, 2)}) AS cpu_model,
  {_taken('ME', '^([0-9]+)GB')} AS ram_capacity,
  {_taken('ME', 'DDR([0-9])')} AS ram_ddr,
  {_taken('ME', 'DDR[0-9] ([0-9]+)')} AS ram_speed,
  {_taken('HD', '(HDD|SSD)')} AS hdd_type,
  {_taken('HD', '^([0-9]+)Gb (?:HDD|SSD)')} AS hdd_capacity,
  CASE WHEN ArtikelGruppe = 'GC' AND Bezeichnung LIKE 'Radeon %' THEN 'AMD'
    WHEN ArtikelGruppe = 'GC' THEN 'NVIDIA' END AS gpu_manufacturer,
  {_taken('GC', '^(Geforce|Radeon|Quadro|Nvidia) ')} AS gpu_series,
  (CASE WHEN ArtikelGruppe <> 'GC' THEN NULL WHEN Bezeichnung LIKE '%1024MB%' THEN '1'
    WHEN Bezeichnung LIKE '%2048MB%' THEN '2'
    ELSE nullif(regexp_extract(Bezeichnung, '([0-9]+)GB', 1), '') END) AS gpu_vram
FROM art"""

_quoted = lambda text: "'" + text.replace("'", "''") + "'"
_cases = "cases(maker, model) AS (VALUES " + ", ".join(
    f"({_quoted(maker)}, {_quoted(model)})" for maker, models in CASE_MODELS.items() for model in models) + ")"
ORACLE["canonical_case"] = V.with_views(V.ART, _cases) + """
SELECT Artikelnummer AS sku, Bezeichnung AS name, maker AS case_manufacturer, model AS case_model,
  maker IS NOT NULL AS listed
FROM (SELECT Artikelnummer, Bezeichnung, maker, model,
        row_number() OVER (PARTITION BY Artikelnummer ORDER BY length(maker || model) DESC) AS r
      FROM (SELECT * FROM art WHERE ArtikelGruppe = 'TW') a LEFT JOIN cases
        ON lower(Bezeichnung) = lower(maker || ' ' || model)
        OR starts_with(lower(Bezeichnung), lower(maker || ' ' || model) || ' '))
WHERE r = 1"""

# ---- deliveries and baskets -----------------------------------------------------------------

_purchase_views = V.with_views(V.ART, V.PURCHASE, V.PURCHASE_LINES)


def _deliveries(where):
    return f"""{_purchase_views}SELECT l.Belegnummer AS delivery_number, l.Artikelnummer AS component_sku,
  l.Bezeichnung AS component_name, CAST(EditMenge AS DOUBLE) AS quantity, p.Name AS provider,
  strftime(Datum, '%Y-%m-%d %H:%M:%S') AS delivery_date, CAST(Einzelpreis AS DOUBLE) AS price_per_item,
  CAST(Gesamtpreis AS DOUBLE) AS price_overall,
  CASE WHEN UebernahmeOffen < 0 THEN 'waiting' ELSE 'received' END AS status
FROM purchase_lines l JOIN purchase p ON p.Belegnummer = l.Belegnummer
LEFT JOIN art a ON a.Artikelnummer = l.Artikelnummer
WHERE Zeilentyp = 'A' AND UebernahmeOffen IS NOT NULL AND {where}"""


ORACLE["deliveries_waiting"] = _deliveries("UebernahmeOffen < 0")
ORACLE["deliveries_components"] = _deliveries(
    "UebernahmeOffen >= 0 AND Datum >= TIMESTAMP '1997-01-01' AND Datum < TIMESTAMP '2001-01-01' AND ("
    "l.Artikelnummer LIKE '%HD%' OR (ArtikelGruppe = 'ME' AND a.Bezeichnung LIKE '16GB%' AND a.Bezeichnung LIKE '%DDR5%') "
    "OR (ArtikelGruppe = 'CP' AND a.Bezeichnung LIKE 'Intel Core i7-%'))")
_CPUS = _deliveries("(l.Artikelnummer LIKE '%CP%' OR l.Artikelnummer LIKE '%GC%')")
ORACLE["incoming_deliveries"] = f"""SELECT *, (SELECT count(*) > 500 FROM ({_CPUS})) AS truncated FROM ({_CPUS})
ORDER BY delivery_date DESC, delivery_number, component_sku, quantity, price_overall LIMIT 500"""

_basket_views = V.with_views(V.BELEG, V.SALES_LINES)
def _matching(skus):
    listed = ", ".join(f"'{s}'" for s in skus)
    return f"""SELECT l.Belegnummer AS order_number FROM sales_lines l JOIN beleg b
  ON b.Belegnummer = l.Belegnummer AND b.Belegtyp = l.Belegtyp
WHERE {V.SALES} AND b.Belegtyp = 'R' AND lower(Artikelnummer) IN ({listed})
GROUP BY 1 HAVING count(DISTINCT lower(Artikelnummer)) = {len(skus)}"""


ORACLE["co_purchase"] = _basket_views + _matching(["cp000000000132", "hd000000001791"])
ORACLE["co_purchase_summary"] = f"""{_basket_views}, found AS ({_matching(["me000000000002"])})
SELECT (SELECT count(*) FROM found) AS matching_order_count,
  (SELECT count(*) FROM found) > count(*) AS order_numbers_truncated,
  coalesce(string_agg(order_number, ',' ORDER BY order_number), '') AS sample_order_numbers
FROM (SELECT order_number FROM found ORDER BY order_number LIMIT 5)"""

_PLACED = """placed AS (
  SELECT *, max(CASE WHEN Zeilentyp <> 'K' THEN BELEGP_ID END) OVER w AS open_id,
    row_number() OVER (PARTITION BY Belegnummer ORDER BY BELEGP_ID) AS position
  FROM sales_lines WINDOW w AS (PARTITION BY Belegnummer ORDER BY BELEGP_ID
    ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)),
items AS (
  SELECT p.*, CASE WHEN p.Zeilentyp = 'K' AND o.Zeilentyp = 'H' THEN o.BELEGP_ID END AS parent_id,
    o.Artikelnummer AS parent_sku
  FROM placed p LEFT JOIN sales_lines o ON o.Belegnummer = p.Belegnummer AND o.BELEGP_ID = p.open_id)"""
ORACLE["co_purchase_pairs"] = f"""{_basket_views}, {_PLACED},
pairs AS (SELECT DISTINCT least(parent_sku, Artikelnummer) AS sku_a, greatest(parent_sku, Artikelnummer) AS sku_b
  FROM items WHERE parent_id IS NOT NULL AND Belegtyp = 'R' AND parent_sku <> Artikelnummer),
basket AS (SELECT DISTINCT l.Belegnummer, Artikelnummer FROM sales_lines l JOIN beleg b
  ON b.Belegnummer = l.Belegnummer WHERE {V.SALES} AND b.Belegtyp = 'R')
SELECT sku_a, sku_b, count(*) AS order_count FROM pairs JOIN basket a ON a.Artikelnummer = sku_a
JOIN basket b ON b.Artikelnummer = sku_b AND b.Belegnummer = a.Belegnummer GROUP BY 1, 2"""

ORACLE["co_purchase_frequent"] = f"""{_basket_views},
basket AS (SELECT DISTINCT l.Belegnummer, Artikelnummer FROM sales_lines l JOIN beleg b
  ON b.Belegnummer = l.Belegnummer WHERE {V.SALES} AND b.Belegtyp = 'R')
SELECT a.Artikelnummer AS sku_a, b.Artikelnummer AS sku_b, count(*) AS order_count FROM basket a JOIN basket b
  ON a.Belegnummer = b.Belegnummer AND a.Artikelnummer < b.Artikelnummer GROUP BY 1, 2 HAVING count(*) >= 2"""

# ---- documents --------------------------------------------------------------------------------

_item_views = V.with_views(V.SALES_LINES, _PLACED)
_ITEM = """Belegnummer AS document_number, Belegtyp AS document_type, BELEGP_ID AS line_id,
  Zeilentyp AS line_type, Artikelnummer AS sku, coalesce(Bezeichnung, '') AS name,
  CAST(Menge AS DOUBLE) AS quantity, CAST(KalkpreisEuro AS DOUBLE) AS price, position"""
ORACLE["order_items"] = f"""{_item_views}SELECT {_ITEM}, CAST(parent_id AS VARCHAR) AS parent_line_id
FROM items WHERE Zeilentyp <> 'K' OR parent_id IS NOT NULL"""
ORACLE["order_item_rejects"] = f"""{_item_views}SELECT {_ITEM} FROM items
WHERE Zeilentyp = 'K' AND parent_id IS NULL"""
ORACLE["order_360"] = f"""{V.with_views(V.MITARBW, V.BELEG, V.PURCHASE, V.HEADERS, V.SALES_LINES, _PLACED)}
SELECT h.*, line_id, line_type, sku, name, quantity, price, position, parent_line_id FROM ({_HEADER}) h LEFT JOIN (
  SELECT Belegnummer, Belegtyp, CAST(BELEGP_ID AS VARCHAR) AS line_id, Zeilentyp AS line_type, Artikelnummer AS sku,
    coalesce(Bezeichnung, '') AS name, CAST(Menge AS DOUBLE) AS quantity, CAST(KalkpreisEuro AS DOUBLE) AS price,
    CAST(position AS VARCHAR) AS position, CAST(parent_id AS VARCHAR) AS parent_line_id
  FROM items WHERE Zeilentyp <> 'K' OR parent_id IS NOT NULL) i
ON i.Belegnummer = h.document_number AND i.Belegtyp = h.document_type"""

_MISSING = f"""{V.with_views(V.BELEG, V.CHAIN, V.SALES_LINES, V.ORIGINAL_LINES)},
links AS (
  SELECT b.Belegnummer AS order_number, c.LieferBelegNr AS original FROM beleg b
  JOIN (SELECT Belegnummer, LieferBelegNr FROM beleg QUALIFY row_number() OVER (
    PARTITION BY Belegnummer ORDER BY AngelegtAm DESC, Belegtyp DESC) = 1) n ON n.Belegnummer = b.Belegnummer
  JOIN chain c ON c.Belegnummer = n.LieferBelegNr
  WHERE Adressnummer NOT IN ('K10000', 'DE00000', 'K000000') AND Vorlage = '' AND b.Belegtyp = 'L' AND Status = 0
    AND c.LieferBelegNr IS NOT NULL AND EXISTS (SELECT 1 FROM orders
      WHERE 'UA' || lpad(CAST(o_orderkey AS VARCHAR), 12, '0') = c.LieferBelegNr)),
was AS (SELECT order_number, left(Artikelnummer, 2) AS g, sum(Menge) AS q,
    arg_min(Artikelnummer, BELEGP_ID) AS id, arg_min(coalesce(Bezeichnung, ''), BELEGP_ID) AS name
  FROM links JOIN original_lines ON Belegnummer = original GROUP BY 1, 2),
cur AS (SELECT order_number, left(Artikelnummer, 2) AS g, sum(Menge) AS q,
    arg_min(Artikelnummer, BELEGP_ID) AS id, arg_min(coalesce(Bezeichnung, ''), BELEGP_ID) AS name
  FROM links JOIN sales_lines ON Belegnummer = order_number GROUP BY 1, 2),
missing AS (SELECT w.order_number, coalesce(c.id, w.id) AS id, coalesce(c.name, w.name) AS name,
    CAST(w.q - coalesce(c.q, 0) AS DOUBLE) AS count
  FROM was w LEFT JOIN cur c ON c.order_number = w.order_number AND c.g = w.g WHERE w.q > coalesce(c.q, 0))
"""
ORACLE["missing_components"] = _MISSING + "SELECT * FROM missing"
ORACLE["open_order_shortages"] = _MISSING + """SELECT id, name, sum(count) AS count,
  count(DISTINCT order_number) AS affected_orders FROM missing GROUP BY 1, 2"""
ORACLE["affected_orders"] = _MISSING + """SELECT order_number, count(*) AS missing_articles
FROM missing GROUP BY 1"""

# ---- snapshots and e-mails -----------------------------------------------------------------------

_run = _FORECAST_VIEWS + _forecast_body("2001-08-02 12:00:00", 4)
ORACLE["latest_forecast"] = _run
ORACLE["daily_forecast"] = _run

_MAIL = """contacts AS (
  SELECT lower(replace(c_name, '#', '')) || '@example.com' AS email, unnest(CASE c_custkey % 5 WHEN 0 THEN []
      WHEN 1 THEN ['C' || CAST(c_custkey AS VARCHAR), 'C' || CAST(c_custkey AS VARCHAR), 'D' || CAST(c_custkey AS VARCHAR)]
      ELSE ['C' || CAST(c_custkey AS VARCHAR)] END) AS contact_id FROM customer),
owned AS (
  SELECT CASE WHEN c_custkey % 10 = 1 THEN 'D' ELSE 'C' END || CAST(c_custkey AS VARCHAR) AS contact_id,
    unnest(['T' || CAST(c_custkey AS VARCHAR), 'T' || CAST(c_custkey + 1 AS VARCHAR)]) AS ticket_id
  FROM customer WHERE c_custkey % 3 <> 0)"""
ORACLE["email_contacts"] = V.with_views(V.BELEG, _MAIL) + """
SELECT email, count(*) AS invoices, email IN (SELECT c.email FROM contacts c JOIN owned o USING (contact_id))
  AS customer_service
FROM beleg WHERE Belegtyp = 'R' AND PLZ <> '10997' AND Vertrag <> -1 AND Lager = 100 AND Netto <> 0
  AND email IS NOT NULL AND Vertreter = 8 AND Datum >= TIMESTAMP '1996-01-01' AND Datum < TIMESTAMP '2001-01-01'
GROUP BY email"""
ORACLE["tickets_by_email"] = "WITH " + _MAIL + """
SELECT DISTINCT email, ticket_id FROM contacts JOIN owned USING (contact_id)"""

# ---- tickets ---------------------------------------------------------------------------------------

_T = "'T' || CAST(conv_id AS VARCHAR)"
_M = "'M' || CAST(conv_id AS VARCHAR) || '-' || CAST(turn AS VARCHAR)"
_AT = "TIMESTAMP '2024-01-01' + to_seconds(conv_id * 3600 + turn * 60)"
_MSG = f"""msg AS (
  SELECT {_M} AS message_id, {_T} AS ticket_id,
    CASE role WHEN 'user' THEN 'Customer' WHEN 'assistant' THEN 'Support' ELSE '' END AS role,
    CASE WHEN role IN ('user', 'assistant') THEN coalesce(text, '') ELSE '' END AS body,
    CAST(turn AS INTEGER) AS position, role IN ('user', 'assistant') AS visible, {_AT} AS cached_at, conv_id, turn
  FROM conversations)"""
_CACHED = "cached AS (SELECT * FROM msg WHERE (conv_id * 8 + turn) % 23 <> 0)"
_stamp = lambda c: f"strftime({c}, '%Y-%m-%d %H:%M:%S')"
_MESSAGE = f"message_id, ticket_id, role, body, position, visible, {_stamp('cached_at')} AS cached_at"
ORACLE["ingest_tickets"] = f"""
SELECT {_T} AS ticket_id, CAST(i AS INTEGER) AS position, 'M' || CAST(conv_id AS VARCHAR) || '-' || CAST(i AS VARCHAR) AS message_id
FROM (SELECT conv_id, unnest(range(max(turn) + 1)) AS i FROM conversations GROUP BY conv_id)"""
ORACLE["normalise_messages"] = f"WITH {_MSG} SELECT {_MESSAGE} FROM msg"
ORACLE["upsert_messages"] = f"""WITH {_MSG}, {_CACHED},
edited AS (SELECT * REPLACE (CASE WHEN visible THEN '(edited) ' || body ELSE '' END AS body,
    cached_at + INTERVAL 60 SECOND AS cached_at) FROM msg WHERE turn >= 2)
SELECT {_MESSAGE} FROM edited UNION ALL
SELECT {_MESSAGE} FROM cached WHERE message_id NOT IN (SELECT message_id FROM edited)"""
ORACLE["ticket_conversation"] = f"""WITH {_MSG}, {_CACHED},
broken AS (SELECT DISTINCT ticket_id FROM msg WHERE message_id NOT IN (SELECT message_id FROM cached))
SELECT ticket_id, CAST(position AS VARCHAR) AS position, role, body AS text, true AS complete FROM cached
WHERE visible AND ticket_id NOT IN (SELECT ticket_id FROM broken)
UNION ALL SELECT ticket_id, NULL, NULL, NULL, false FROM broken"""
_TURNS = f"""{_MSG}, turns AS (
  SELECT ticket_id AS conv_id, position AS turn, CASE role WHEN 'Customer' THEN 'user' ELSE 'assistant' END AS role,
    body AS text, row_number() OVER (PARTITION BY ticket_id ORDER BY position DESC) AS back
  FROM msg WHERE visible AND length(body) > 0)"""
ORACLE["conversation_context"] = f"""WITH {_TURNS}
SELECT conv_id, turn, CASE WHEN back <= 3 THEN 'recent' ELSE 'older' END AS part, role || ': ' || text AS line FROM turns"""
ORACLE["retrieval_context"] = f"""WITH {_TURNS}
SELECT conv_id, coalesce(string_agg(text, ' ' ORDER BY turn) FILTER (role = 'user'), '') AS context
FROM turns WHERE back <= 3 GROUP BY conv_id"""
ORACLE["draft_query"] = f"""WITH {_TURNS}, asked AS (
  SELECT conv_id, string_agg(text, chr(10) || chr(10) ORDER BY turn) AS q FROM (SELECT *,
    row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) AS r FROM turns WHERE role = 'user') WHERE r <= 3 GROUP BY 1)
SELECT t.conv_id, coalesce(q, text) AS query FROM turns t LEFT JOIN asked a ON a.conv_id = t.conv_id WHERE back = 1"""
_DRAFTS = f"""drafts AS (
  SELECT {_T} AS ticket_id, 'M' || CAST(conv_id AS VARCHAR) || '-' || CAST(turn // 4 * 4 AS VARCHAR) AS based_on_message_id,
    text, conv_id % 3 AS shape, CASE WHEN conv_id % 6 = 5 THEN 'v1' ELSE 'v2' END AS prompt_version
  FROM conversations WHERE role = 'assistant' AND turn % 4 = 1)"""
_STATUS = f"""WITH {_MSG}, {_CACHED}, {_DRAFTS},
remote AS (SELECT ticket_id, arg_max(message_id, position) AS remote_last_message_id FROM msg GROUP BY 1),
known AS (SELECT ticket_id, arg_max(message_id, position) AS cached_last_message_id FROM msg
  WHERE conv_id % 7 <> 0 AND (conv_id % 4 <> 1 OR turn < 2) GROUP BY 1),
status AS (SELECT r.ticket_id, remote_last_message_id, cached_last_message_id,
  coalesce(cached_last_message_id = remote_last_message_id, false) AS is_current,
  (SELECT count(*) FROM msg m WHERE m.ticket_id = r.ticket_id AND m.message_id NOT IN (SELECT message_id FROM cached))
    AS messages_to_fetch,
  NOT EXISTS (SELECT 1 FROM drafts d WHERE d.ticket_id = r.ticket_id AND prompt_version = 'v2'
    AND d.based_on_message_id = remote_last_message_id) AS draft_missing
FROM remote r LEFT JOIN known k ON k.ticket_id = r.ticket_id)"""
ORACLE["ticket_sync_status"] = _STATUS + " SELECT * FROM status"
ORACLE["sync_summary"] = _STATUS + """ SELECT count(*) AS tickets,
  count(*) FILTER (is_current) AS was_current, CAST(sum(messages_to_fetch) AS BIGINT) AS messages_to_fetch,
  count(*) FILTER (draft_missing) AS drafts_to_generate, count(*) FILTER (messages_to_fetch > 0) AS incomplete_tickets
FROM status"""
ORACLE["missing_message_ids"] = f"""WITH {_MSG}, {_CACHED}
SELECT message_id FROM msg WHERE message_id NOT IN (SELECT message_id FROM cached)"""

# ---- logs and drafts ----------------------------------------------------------------------------------

_LOGS = f"""logs AS (
  SELECT conv_id * 10 + turn AS id, {_T} AS ticket_id,
    'M' || CAST(conv_id AS VARCHAR) || '-' || CAST(turn // 4 * 4 AS VARCHAR) AS based_on_message_id,
    CASE WHEN turn % 4 = 1 THEN 'first_draft' ELSE 'reprompt' END AS event_type, text AS response_text,
    CASE WHEN turn % 8 <> 5 THEN ['T' || CAST(conv_id + 1 AS VARCHAR), 'T' || CAST(conv_id + 2 AS VARCHAR)]
      ELSE CAST([] AS VARCHAR[]) END AS sources,
    CASE WHEN turn % 4 = 1 THEN '' ELSE 'Revise ' || {_M} END AS instructions,
    CAST(turn + 1 AS INTEGER) AS message_count, {_AT} AS created_at,
    CASE WHEN turn % 4 <> 1 THEN 'Draft: ' || text END AS input_response_text, conv_id, turn
  FROM conversations WHERE role = 'assistant' AND NOT (turn % 4 = 1 AND conv_id % 5 = 0)),
linked AS (SELECT l.*, f.id AS first_draft_id FROM logs l LEFT JOIN logs f ON f.ticket_id = l.ticket_id
  AND f.based_on_message_id = l.based_on_message_id AND f.event_type = 'first_draft' AND l.event_type = 'reprompt'
  AND f.id < l.id)"""
_log = f"WITH {_LOGS}\n"
_created = f"{_stamp('created_at')} AS created_at"
ORACLE["generation_log_append"] = f"""{_log}, stored AS (SELECT * FROM logs WHERE based_on_message_id LIKE '%-0'),
events AS (SELECT id, ticket_id, based_on_message_id, event_type, created_at FROM logs
    WHERE based_on_message_id NOT LIKE '%-0'
  UNION ALL SELECT id + 10000000, ticket_id, based_on_message_id, event_type, created_at FROM logs WHERE message_count <> 8),
fresh AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY ticket_id, based_on_message_id ORDER BY created_at, id) AS r
    FROM events WHERE event_type = 'first_draft') e
  WHERE r = 1 AND NOT EXISTS (SELECT 1 FROM stored s WHERE s.event_type = 'first_draft' AND s.ticket_id = e.ticket_id
    AND s.based_on_message_id = e.based_on_message_id)),
firsts AS (SELECT id, ticket_id, based_on_message_id FROM fresh UNION ALL
  SELECT id, ticket_id, based_on_message_id FROM stored WHERE event_type = 'first_draft')
SELECT id, ticket_id, based_on_message_id, event_type, CAST(NULL AS VARCHAR) AS first_draft_id FROM fresh
UNION ALL SELECT e.id, e.ticket_id, e.based_on_message_id, e.event_type, CAST(f.id AS VARCHAR) FROM events e LEFT JOIN firsts f
  ON f.ticket_id = e.ticket_id AND f.based_on_message_id = e.based_on_message_id AND f.id < e.id
WHERE e.event_type = 'reprompt'"""
ORACLE["rejected_events"] = _log + "SELECT id, ticket_id, 'other' AS event_type FROM logs WHERE message_count = 8"
ORACLE["rebuild_logs"] = f"""{_log}, n AS (SELECT *, row_number() OVER (ORDER BY created_at, ticket_id,
    based_on_message_id, event_type, response_text) AS nr FROM logs)
SELECT n.nr AS id, n.ticket_id, n.based_on_message_id, n.event_type, n.response_text,
  array_to_string(n.sources, ',') AS sources, n.instructions, n.message_count,
  {_stamp('n.created_at')} AS created_at, CAST(NULL AS VARCHAR) AS messages_json, n.input_response_text,
  CAST(f.nr AS VARCHAR) AS first_draft_id, '' AS prompt_version
FROM n LEFT JOIN n f ON n.event_type = 'reprompt' AND f.event_type = 'first_draft' AND f.ticket_id = n.ticket_id
  AND f.based_on_message_id = n.based_on_message_id"""
ORACLE["read_reprompts"] = f"""{_log}SELECT id, ticket_id, {_created}, instructions, response_text,
  input_response_text, CAST(first_draft_id AS VARCHAR) AS first_draft_id FROM linked WHERE event_type = 'reprompt'"""
ORACLE["reprompt_search"] = f"""{_log}SELECT id, ticket_id, {_created} FROM logs WHERE event_type = 'reprompt'
  AND created_at < TIMESTAMP '2024-01-21'
  AND contains(lower(instructions || ' ' || coalesce(input_response_text, '') || ' ' || response_text || ' '), 'the ')"""
ORACLE["reprompt_history"] = f"""{_log}SELECT id, ticket_id, {_created}, instructions, CAST(first_draft_id AS VARCHAR) AS first_draft_id,
  (SELECT count(*) FROM logs WHERE event_type = 'reprompt') AS row_count,
  (SELECT greatest(1, (count(*) + 24) // 25) FROM logs WHERE event_type = 'reprompt') AS page_count
FROM linked WHERE event_type = 'reprompt' ORDER BY linked.created_at DESC, id DESC LIMIT 25"""
ORACLE["reprompt_totals"] = _log + """SELECT count(*) AS reprompts, count(DISTINCT ticket_id) AS tickets
FROM logs WHERE event_type = 'reprompt'"""
ORACLE["recent_logs"] = f"""{_log}SELECT id, ticket_id, event_type, {_created} FROM logs
ORDER BY logs.created_at DESC, id DESC"""
ORACLE["first_draft"] = _log + """SELECT ticket_id, id, based_on_message_id, response_text,
  array_to_string(sources, ',') AS sources FROM (SELECT *, row_number() OVER (PARTITION BY ticket_id
  ORDER BY created_at, id) AS r FROM logs WHERE event_type = 'first_draft') WHERE r = 1"""
ORACLE["current_drafts"] = f"""WITH {_LOGS}, {_DRAFTS}
SELECT d.ticket_id, d.based_on_message_id, d.text AS reply,
  CASE WHEN shape = 1 THEN 'A,B' ELSE coalesce(array_to_string(l.sources, ','), '') END AS sources
FROM drafts d LEFT JOIN logs l ON l.ticket_id = d.ticket_id AND l.based_on_message_id = d.based_on_message_id
  AND l.event_type = 'first_draft' WHERE prompt_version = 'v2'"""
ORACLE["draft_text"] = f"""WITH {_DRAFTS}
SELECT ticket_id, based_on_message_id, replace(text, chr(10), chr(10) || '&amp;') AS reply
FROM drafts WHERE prompt_version = 'v2'"""
ORACLE["merge_sources"] = _log + """SELECT id, array_to_string(list_filter([a, b, c, d], lambda x: x IS NOT NULL), ',') AS sources
FROM (SELECT id, sources[1] AS a, sources[2] AS b,
  CASE WHEN len(sources) = 0 THEN 'T' || CAST(conv_id + 2 AS VARCHAR) END AS c,
  CASE WHEN message_count > 2 OR len(sources) = 0 AND message_count <> 2
    THEN 'T' || CAST(conv_id + message_count AS VARCHAR) END AS d FROM logs)"""
ORACLE["cited_tickets"] = _log + """SELECT source, min(id) AS id
FROM (SELECT unnest(sources) AS source, id FROM logs) GROUP BY 1"""

_KEY = """sha256('{"instructions": "Translate to French.", "model": "local", "options": {"temperature": 0}, "text": '
  || CAST(to_json(TXT) AS VARCHAR) || ', "think": false}')"""
_KNOWN = f"known AS (SELECT DISTINCT {_KEY.replace('TXT', 'text')} AS k, text FROM conversations WHERE turn = 0)"
ORACLE["translation_backlog"] = f"""WITH {_MSG}, {_KNOWN}
SELECT {_KEY.replace('TXT', 'body')} AS cache_key, body AS text, count(*) AS messages,
  {_KEY.replace('TXT', 'body')} IN (SELECT k FROM known) AS cached
FROM msg WHERE trim(body) <> '' GROUP BY body"""
ORACLE["translated_messages"] = f"""WITH {_MSG}
SELECT message_id, CASE WHEN trim(body) = '' THEN body
  WHEN body IN (SELECT text FROM conversations WHERE turn = 0) THEN 'FR ' || body END AS translated FROM msg"""

# ---- similar tickets, text, traffic --------------------------------------------------------------------

ORACLE["precedents_topk"] = """
WITH v AS (SELECT vec_id, label, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS e FROM embeddings),
r AS (SELECT a.vec_id AS query_id, c.vec_id, list_cosine_similarity(a.e, c.e) AS score,
    row_number() OVER (PARTITION BY a.vec_id ORDER BY list_cosine_similarity(a.e, c.e) DESC, c.vec_id) AS rank
  FROM v a, v c WHERE a.label = 3)
SELECT CAST(query_id AS VARCHAR) AS query_id, CAST(rank AS INTEGER) AS rank, 'T' || CAST(vec_id AS VARCHAR) AS ticket_id,
  round(score, 6) AS score FROM r WHERE rank <= 5 AND vec_id <> query_id"""
ORACLE["precedents_by_status"] = """
WITH v AS (SELECT vec_id, label, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS e FROM embeddings),
q AS (SELECT label, max(vec_id) AS query_id FROM embeddings GROUP BY label),
s AS (SELECT query_id, c.vec_id, list_cosine_similarity(a.e, c.e) AS score
  FROM q JOIN v a ON a.vec_id = query_id JOIN v c ON c.label = q.label),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s)
SELECT CAST(query_id AS VARCHAR) AS query_id, CAST(rank AS INTEGER) AS rank, 'T' || CAST(vec_id AS VARCHAR) AS ticket_id,
  round(score, 6) AS score, text AS problem_text, lang AS linked_resolution
FROM r LEFT JOIN documents ON doc_id = vec_id WHERE rank <= 5 AND vec_id <> query_id"""

ORACLE["stored_precedents"] = """
SELECT vec_id AS chunk_id, 'T' || CAST(vec_id AS VARCHAR) AS ticket_id, source AS product_sku, CAST(label AS VARCHAR) AS status,
  lang AS linked_resolution, CAST(length(text) AS VARCHAR) AS characters, CAST(len(embedding) AS INTEGER) AS dimensions
FROM embeddings LEFT JOIN documents ON vec_id = doc_id"""

# The pages' own letters: the engine reads them back from references.
_TEXT_OF = r"""array_to_string(list_filter(list_transform(string_split(regexp_replace(html,
  '<script\b.*?</script\s*>|<style\b.*?</style\s*>|<!--.*?-->|<!doctype[^>]*>|</?[a-z][^>]*>', chr(1), 'gis'), chr(1)),
  lambda r: regexp_replace(regexp_replace(replace(replace(replace(r, '&quot;', '"'), '&copy;', '©'), '&middot;', '·'),
    '&amp(;|\b)', '&', 'g'),
    '^\s+|\s+$', '', 'g')), lambda r: r <> ''), chr(10))"""
ORACLE["html_to_text"] = f"SELECT page_id, {_TEXT_OF} AS text FROM pages"
ORACLE["text_by_host"] = f"""SELECT regexp_extract(url, '^[a-z]+://([^/?#]+)', 1) AS host, count(*) AS pages,
  CAST(sum(length({_TEXT_OF})) AS BIGINT) AS characters FROM pages GROUP BY 1"""

_CHOSEN = "chosen AS (SELECT * FROM events WHERE ts >= TIMESTAMP '2024-01-03' AND ts < TIMESTAMP '2024-01-31')"


def _sessions(source):
    return f"""marked AS (SELECT *, sum(opens) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS session FROM (
    SELECT *, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) <= INTERVAL 30 MINUTE THEN 0 ELSE 1 END AS opens
    FROM {source})),
sess AS (SELECT user_id, session, min(ts) AS started, max(ts) AS ended, count(*) AS events,
    count(*) FILTER (event_type = 'view') AS views, count(*) FILTER (event_type = 'purchase') AS purchases,
    arg_min(event_type, event_id) AS event_type FROM marked GROUP BY 1, 2)"""


def _traffic(by_event, by_session, name):
    group = "GROUP BY 1" if name else ""
    key = lambda e: f"{e} AS {name}, " if name else ""
    events = f"""SELECT {key(by_event)}count(DISTINCT user_id) AS activeUsers,
  count(*) FILTER (event_type = 'view') AS screenPageViews, count(*) FILTER (event_type = 'purchase') AS ecommercePurchases,
  CAST(coalesce(sum(CAST(value AS DECIMAL(18,2))) FILTER (event_type = 'purchase'), 0) AS DOUBLE) AS purchaseRevenue FROM chosen {group}"""
    visits = f"""SELECT {key(by_session)}count(*) AS sessions, CAST(count(*) FILTER (ended - started > INTERVAL 10 SECOND
  OR purchases > 0 OR views >= 2) AS DOUBLE) / count(*) AS engagementRate FROM sess {group}"""
    join = f"FULL JOIN v USING ({name})" if name else "CROSS JOIN v"
    return f"WITH {_CHOSEN}, {_sessions('chosen')}, e AS ({events}), v AS ({visits}) SELECT * FROM e {join}"


ORACLE["website_traffic_overview"] = _traffic("", "", "")
ORACLE["website_traffic_date"] = _traffic("strftime(ts, '%Y-%m-%d')", "strftime(started, '%Y-%m-%d')", "date")
ORACLE["website_traffic_type"] = _traffic("event_type", "event_type", "event_type")
ORACLE["website_traffic_page"] = f"""WITH {_CHOSEN}, d AS (SELECT strftime(ts, '%Y-%m-%d') AS date,
  CAST(coalesce(sum(CAST(value AS DECIMAL(18,2))) FILTER (event_type = 'purchase'), 0) AS DOUBLE) AS purchaseRevenue
  FROM chosen GROUP BY 1)
SELECT *, (SELECT count(*) FROM d) AS row_count, CASE WHEN (SELECT count(*) FROM d) > 15 THEN 15 END AS next_offset
FROM d ORDER BY date LIMIT 10 OFFSET 5"""
_points = """SELECT strftime(ts, '%Y-%m-%d') AS x, CAST(count(DISTINCT user_id) AS DOUBLE) AS y, 'activeUsers' AS series, 1 AS r
  FROM chosen GROUP BY 1 UNION ALL
  SELECT strftime(ts, '%Y-%m-%d'), CAST(count(*) FILTER (event_type = 'view') AS DOUBLE), 'screenPageViews', 2 FROM chosen GROUP BY 1"""
ORACLE["website_traffic_chart"] = f"""WITH {_CHOSEN}, points AS ({_points})
SELECT x, y, series, (SELECT count(*) > 20 FROM points) AS truncated FROM points ORDER BY x, r LIMIT 20"""
ORACLE["website_traffic_props"] = f"""WITH {_CHOSEN}
SELECT json_extract_string(props, '$.k') AS k, count(DISTINCT user_id) AS activeUsers,
  count(*) FILTER (event_type = 'view') AS screenPageViews FROM chosen GROUP BY 1"""
ORACLE["website_sessions"] = f"""WITH {_sessions('events')}
SELECT user_id, CAST(session AS BIGINT) AS session, {_stamp('started')} AS started, {_stamp('ended')} AS ended,
  events, views, purchases, event_type FROM sess"""
ORACLE["traffic_records"] = f"""WITH {_CHOSEN}
SELECT '{{"date":"' || strftime(ts, '%Y-%m-%d') || '","activeUsers":' || CAST(count(DISTINCT user_id) AS VARCHAR)
  || ',"screenPageViews":' || CAST(count(*) FILTER (event_type = 'view') AS VARCHAR) || '}}' AS record
FROM chosen GROUP BY strftime(ts, '%Y-%m-%d')"""
ORACLE["incident_states"] = """WITH told AS (SELECT user_id AS service, event_id AS run_id, event_type,
  event_type = 'error' AS failing,
  coalesce(last_value(CASE WHEN event_type <> 'signup' THEN event_type = 'error' END IGNORE NULLS) OVER
    (PARTITION BY user_id ORDER BY event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), false) AS notified_before
  FROM events)
SELECT service, run_id, failing, notified_before,
  CASE WHEN failing THEN 'problem' WHEN notified_before THEN 'recovered' END AS alert,
  CASE WHEN event_type = 'signup' THEN notified_before ELSE failing END AS notified
FROM told"""

# ---- streams: the batch results ------------------------------------------------------------------------------

ORACLE["stream_tickets"] = ORACLE["ingest_tickets"]
ORACLE["stream_messages"] = ORACLE["normalise_messages"]
ORACLE["stream_counts_day"] = "SELECT strftime(ts, '%Y-%m-%d') AS period, count(*) AS n FROM events GROUP BY 1"
ORACLE["stream_counts_week"] = """SELECT strftime(date_trunc('week', o_orderdate), '%Y-%m-%d') AS period, count(*) AS n
FROM orders GROUP BY 1"""
ORACLE["stream_sessions"] = ORACLE["website_sessions"]
ORACLE["stream_incidents"] = ORACLE["incident_states"]
ORACLE["stream_messages_compacted"] = ORACLE["normalise_messages"]
ORACLE["stream_counts_bounded"] = ORACLE["stream_counts_day"]
ORACLE["stream_alerts"] = f"""SELECT CAST(service AS VARCHAR) AS service, run_id, alert FROM ({ORACLE["incident_states"]})
WHERE alert IS NOT NULL"""
