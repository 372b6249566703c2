"""The ERP views over the provided tables as SQL, written independently of ``sources.demo``."""

ART = """art AS (
  SELECT (['CP','GC','ME','HD','MB','TW'])[p_partkey % 6 + 1] || lpad(CAST(p_partkey AS VARCHAR), 12, '0') AS Artikelnummer,
    CASE p_partkey % 6
      WHEN 0 THEN CASE
        WHEN (p_partkey // 6) % 5 < 3 THEN 'Intel Core i' || (['3','5','7','9'])[p_size % 4 + 1] || '-'
          || CAST(10 + p_size % 5 AS VARCHAR) || (['3','5','7','9'])[p_size % 4 + 1] || '00'
          || (['','K','KF'])[(p_partkey // 6) % 3 + 1]
          || CASE WHEN (p_partkey // 6) % 4 = 3 THEN ' Tray' ELSE '' END
        WHEN (p_partkey // 6) % 5 = 3 THEN 'AMD Ryzen ' || (['3','5','7','9'])[p_size % 4 + 1] || ' '
          || CAST(5 + p_size % 5 AS VARCHAR) || (['3','5','7','9'])[p_size % 4 + 1] || '00'
          || (['X','','X3D'])[p_size % 3 + 1]
        ELSE 'Intel Core Ultra ' || (['5','7','9'])[p_size % 3 + 1] || ' 2' || (['5','7','9'])[p_size % 3 + 1]
          || '5' || (['','K'])[(p_partkey // 6) % 2 + 1] END
      WHEN 1 THEN CASE
        WHEN (p_partkey // 6) % 5 < 2 THEN 'Geforce RTX ' || (['3060','4060','4070','5080'])[p_size % 4 + 1]
          || ' ' || (['4','8','12','16'])[(p_partkey // 6) % 4 + 1] || 'GB'
        WHEN (p_partkey // 6) % 5 = 2 THEN 'Radeon RX ' || (['6600','7700','7900'])[p_size % 3 + 1]
          || ' ' || (['8','16'])[(p_partkey // 6) % 2 + 1] || 'GB'
        WHEN (p_partkey // 6) % 5 = 3 THEN 'Quadro P1000 2048MB'
        ELSE 'Nvidia T400 1024MB' END
      WHEN 2 THEN (['8','16','32','64'])[p_size % 4 + 1] || 'GB DDR' || (['4','5'])[(p_partkey // 6) % 2 + 1]
        || ' ' || (['3200','5600','6000'])[(p_partkey // 6) % 3 + 1]
      WHEN 3 THEN (['500','1000','2000'])[p_size % 3 + 1] || 'Gb ' || (['SSD','HDD'])[(p_partkey // 6) % 2 + 1]
        || ' ' || p_brand
      WHEN 4 THEN p_name || ' ' || p_brand
      ELSE (['CoolerMaster Elite 302','coolermaster elite 490','NZXT H510 Black','Kolink Punisher RGB',
             'Corsair Obsidian 500D Window','Nameless Tower'])[(p_partkey // 6) % 6 + 1]
        || (([' TG','','']))[p_size % 3 + 1] END AS Bezeichnung,
    (['CP','GC','ME','HD','MB','TW'])[p_partkey % 6 + 1] AS ArtikelGruppe,
    CASE WHEN p_partkey % 17 <> 0 THEN lpad(CAST(p_partkey AS VARCHAR), 13, '0') END AS EANNummer,
    p_brand || '-' || CAST(p_size AS VARCHAR) AS HstArtikelnummer
  FROM part)"""

MITARBW = """mitarbw AS (
  SELECT DISTINCT CASE c_mktsegment WHEN 'AUTOMOBILE' THEN 1 WHEN 'BUILDING' THEN 8 WHEN 'FURNITURE' THEN 2
      WHEN 'HOUSEHOLD' THEN 3 WHEN 'MACHINERY' THEN 23 END AS Nr,
    upper(left(c_mktsegment, 1)) || lower(substr(c_mktsegment, 2)) AS Name
  FROM customer)"""

BELEG = """beleg AS (
  SELECT kind || 'A' || lpad(CAST(o_orderkey AS VARCHAR), 12, '0') AS Belegnummer,
    CASE WHEN shift = 0 THEN kind ELSE 'S' END AS Belegtyp,
    CASE WHEN shift <> 0 THEN 1 WHEN kind <> 'R' AND o_orderpriority = '5-LOW' THEN 2 ELSE 0 END AS Status,
    o_orderdate + to_days(shift) AS AngelegtAm, o_orderdate + to_days(shift) AS Datum,
    CASE WHEN o_orderkey % 11 <> 0 THEN 'EXT-' || CAST(o_orderkey AS VARCHAR) END AS IhrAuftrag,
    c_name AS Name, ([NULL, '  ', 'Ada', 'Ben'])[c_custkey % 4 + 1] AS Vorname,
    CASE WHEN c_custkey % 10 = 0 THEN 'Company ' || CAST(c_custkey AS VARCHAR) END AS firma,
    CASE WHEN c_custkey % 13 <> 0 THEN lower(replace(c_name, '#', '')) || '@example.com' END AS email,
    '+49' || CAST(c_custkey AS VARCHAR) AS phone,
    CASE WHEN kind = 'R' THEN 'TR' || CAST(o_orderkey AS VARCHAR) END AS tracking,
    CASE WHEN c_custkey % 10 = 0 THEN 'DE' || CAST(c_custkey AS VARCHAR) END AS FreierText1,
    (['DE','FR','EN'])[n_nationkey % 3 + 1] AS Sprache, n_name AS Land,
    'Street ' || CAST(c_custkey % 100 AS VARCHAR) AS Strasse,
    CASE WHEN c_custkey % 31 = 0 THEN '10997' ELSE CAST(10000 + c_custkey % 90000 AS VARCHAR) END AS PLZ,
    'City ' || CAST(c_custkey % 50 AS VARCHAR) AS Ort, gross AS EuroBrutto,
    CASE WHEN o_orderkey % 19 <> 0 THEN cost END AS UebernahmeOffen,
    CASE WHEN o_orderkey % 19 <> 0 THEN CAST(gross - cost AS DECIMAL(18,2)) END AS ErloesEuro,
    CASE WHEN o_orderkey % 23 = 0 THEN 0 ELSE gross - CAST(gross * 0.19 AS DECIMAL(18,2)) END AS Netto,
    CASE WHEN c_custkey % 37 = 0 THEN NULL WHEN c_custkey % 29 = 0 THEN 99
      ELSE CASE c_mktsegment WHEN 'AUTOMOBILE' THEN 1 WHEN 'BUILDING' THEN 8 WHEN 'FURNITURE' THEN 2
        WHEN 'HOUSEHOLD' THEN 3 WHEN 'MACHINERY' THEN 23 END END AS Vertreter,
    CASE WHEN o_custkey % 41 = 0 THEN -1 ELSE 0 END AS Vertrag,
    CASE WHEN o_custkey % 7 = 3 THEN 200 ELSE 100 END AS Lager,
    CASE WHEN o_custkey = 0 THEN 'K000000' ELSE 'K' || CAST(o_custkey AS VARCHAR) END AS Adressnummer,
    CASE WHEN shift <> 0 THEN NULL WHEN kind = 'L' AND o_orderkey % 9 <> 0 THEN 'ZA' || lpad(CAST(o_orderkey AS VARCHAR), 12, '0')
      WHEN kind = 'L' THEN '' END AS LieferBelegNr,
    CASE WHEN o_orderkey % 43 = 0 THEN 'T' ELSE '' END AS Vorlage
  FROM (SELECT *, CASE o_orderstatus WHEN 'F' THEN 'R' WHEN 'O' THEN 'L' ELSE 'D' END AS kind,
          CAST(o_totalprice + abs(shift) AS DECIMAL(18,2)) AS gross,
          CAST(CAST(o_totalprice + abs(shift) AS DECIMAL(18,2)) * 0.8 AS DECIMAL(18,2)) AS cost
        FROM (SELECT *, CAST(unnest(CASE o_orderkey % 17 WHEN 0 THEN [0, 1] WHEN 1 THEN [0, -1] ELSE [0] END) AS INTEGER)
            AS shift FROM orders)) o
  LEFT JOIN customer ON o_custkey = c_custkey LEFT JOIN nation ON c_nationkey = n_nationkey)"""

CHAIN = """chain AS (
  SELECT 'ZA' || lpad(CAST(o_orderkey AS VARCHAR), 12, '0') AS Belegnummer, 'Z' AS Belegtyp,
    CASE WHEN o_orderkey % 5 <> 0 THEN 'UA' || lpad(CAST(o_orderkey AS VARCHAR), 12, '0') END AS LieferBelegNr
  FROM orders WHERE o_orderstatus = 'O')"""

PURCHASE = """purchase AS (
  SELECT Belegnummer, s_name AS Name, CASE WHEN mix % 11 = 0 THEN NULL WHEN mix % 3 = 0 AND y >= 2001 THEN -5
      WHEN mix % 3 = 1 THEN 0 ELSE 7 END AS UebernahmeOffen
  FROM (SELECT DISTINCT l_suppkey, l_suppkey + month(l_shipdate) AS mix, year(l_shipdate) AS y,
          'B' || lpad(CAST(l_suppkey AS VARCHAR), 9, '0') || '-' || strftime(l_shipdate, '%Y%m') AS Belegnummer
        FROM lineitem) LEFT JOIN supplier ON l_suppkey = s_suppkey)"""

_LINE = """CAST(l_linenumber AS BIGINT) * 1000000000000000000 + l_partkey * 1000000000 + l_suppkey % 10000000 * 100
      + CAST(l_quantity AS BIGINT) AS BELEGP_ID,
    (['CP','GC','ME','HD','MB','TW'])[l_partkey % 6 + 1] || lpad(CAST(l_partkey AS VARCHAR), 12, '0') AS Artikelnummer,
    CASE WHEN l_partkey % 14 <> 0 THEN 'Item ' || CAST(l_partkey AS VARCHAR) END AS Bezeichnung,
    CASE WHEN l_linenumber = 6 AND l_returnflag = 'R' THEN CAST(-l_quantity AS DECIMAL(18,4))
      WHEN l_linenumber = 4 THEN CAST(l_quantity / 2 AS DECIMAL(18,4))
      ELSE CAST(l_quantity AS DECIMAL(18,4)) END AS Menge,
    CAST(l_quantity AS DECIMAL(18,4)) AS EditMenge, l_shipdate AS Datum,
    CAST(l_extendedprice AS DECIMAL(18,2)) AS KalkpreisEuro,
    CASE WHEN l_linenumber <> 3 THEN CAST(l_extendedprice AS DECIMAL(18,2)) END AS Einzelpreis,
    CAST(l_extendedprice AS DECIMAL(18,2)) AS Gesamtpreis"""

SALES_LINES = f"""sales_lines AS (
  SELECT kind || 'A' || lpad(CAST(l_orderkey AS VARCHAR), 12, '0') AS Belegnummer, kind AS Belegtyp, {_LINE},
    CASE l_linenumber WHEN 1 THEN 'H' WHEN 7 THEN 'A' ELSE 'K' END AS Zeilentyp
  FROM lineitem JOIN (SELECT o_orderkey,
      CASE o_orderstatus WHEN 'F' THEN 'R' WHEN 'O' THEN 'L' ELSE 'D' END AS kind FROM orders)
    ON l_orderkey = o_orderkey
  WHERE NOT (kind = 'L' AND l_linenumber = 5))"""

ORIGINAL_LINES = f"""original_lines AS (
  SELECT 'UA' || lpad(CAST(l_orderkey AS VARCHAR), 12, '0') AS Belegnummer, 'U' AS Belegtyp, {_LINE}
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey WHERE o_orderstatus = 'O')"""

# All headers with the columns of the header view, and the newest of each number.
HEADERS = """heads AS (
  SELECT Belegnummer, Belegtyp, Status, AngelegtAm, IhrAuftrag, Name, Vorname, Land, EuroBrutto, UebernahmeOffen,
    ErloesEuro, tracking, FreierText1, firma, email, phone, Sprache, Vertreter FROM beleg
  UNION ALL SELECT kind || 'A' || lpad(CAST(o_orderkey AS VARCHAR), 12, '0'), kind, 2, o_orderdate, NULL, NULL, NULL, NULL,
    NULL, NULL, NULL, NULL, NULL, NULL, NULL, NULL, NULL, NULL
  FROM orders, (VALUES ('Z'), ('U')) AS k(kind) WHERE o_orderstatus = 'O'
  UNION ALL SELECT p.Belegnummer, 'B', 0, strptime(right(p.Belegnummer, 6) || '01', '%Y%m%d'), NULL, p.Name, NULL, NULL, NULL,
    p.UebernahmeOffen, NULL, NULL, NULL, NULL, NULL, NULL, NULL, NULL FROM purchase p),
newest AS (SELECT * FROM heads QUALIFY row_number() OVER (PARTITION BY Belegnummer ORDER BY AngelegtAm DESC, Belegtyp DESC) = 1)"""

PURCHASE_LINES = f"""purchase_lines AS (
  SELECT 'B' || lpad(CAST(l_suppkey AS VARCHAR), 9, '0') || '-' || strftime(l_shipdate, '%Y%m') AS Belegnummer,
    {_LINE}, CASE WHEN l_linenumber = 7 THEN 'T' ELSE 'A' END AS Zeilentyp
  FROM lineitem)"""

SERIE = """serie AS (
  SELECT DISTINCT l_partkey * 4 + l_suppkey % 4 AS Id,
    (['CP','GC','ME','HD','MB','TW'])[l_partkey % 6 + 1] || lpad(CAST(l_partkey AS VARCHAR), 12, '0') AS Artikelnummer,
    CASE WHEN (l_partkey * 4 + l_suppkey % 4) % 9 = 0 THEN 'O' ELSE 'S' END AS SCTyp
  FROM lineitem)"""

LAGERP = """lagerp AS (
  SELECT l_partkey * 4 + l_suppkey % 4 AS IdSerie,
    CAST(CASE WHEN l_linenumber = 2 AND l_returnflag = 'R' THEN l_quantity ELSE 0 END AS DECIMAL(18,4)) AS Bestand,
    CAST(CASE WHEN l_linenumber = 5 THEN 0 ELSE l_extendedprice END AS DECIMAL(18,2)) AS Wert,
    l_shipdate AS AngelegtAm
  FROM lineitem)"""

# Header tests of the reports; NULL in a tested column drops the row.
SALES = "Vertreter NOT IN (23, 0, 28) AND PLZ <> '10997' AND Vertrag <> -1 AND Lager = 100"

STATE_COLUMNS = """
  CASE t || '/' || s WHEN 'D/0' THEN 'Werkstattschein' WHEN 'D/2' THEN 'Werkstattschein'
    WHEN 'L/0' THEN 'Lieferschein' WHEN 'L/2' THEN 'Lieferschein' WHEN 'R/0' THEN 'Rechnung'
    ELSE 'Unknown document type' END AS document_type_label,
  CASE t || '/' || s WHEN 'D/0' THEN 'Active' WHEN 'D/2' THEN 'Completed' WHEN 'L/0' THEN 'Active'
    WHEN 'L/2' THEN 'Completed' WHEN 'R/0' THEN 'Final stage' ELSE 'Unknown status' END AS document_status_label,
  CASE t || '/' || s WHEN 'D/0' THEN 'confirmed_workshop' WHEN 'D/2' THEN 'workshop_stage_completed'
    WHEN 'L/0' THEN 'in_production' WHEN 'L/2' THEN 'production_completed' WHEN 'R/0' THEN 'ready_or_sent'
    ELSE 'unknown' END AS lifecycle_state,
  CASE t || '/' || s WHEN 'D/0' THEN 'Confirmed and at workshop stage'
    WHEN 'D/2' THEN 'Workshop stage completed' WHEN 'L/0' THEN 'Currently in production'
    WHEN 'L/2' THEN 'Production stage completed'
    WHEN 'R/0' THEN 'Ready for shipment, invoiced, or already shipped'
    ELSE 'Unknown combination: ' || t || '/' || s END AS lifecycle_label,
  (t || '/' || s) IN ('D/0', 'L/0', 'R/0') AS is_current_stage"""


def with_views(*views: str) -> str:
    return "WITH " + ",\n".join(views) + "\n"
