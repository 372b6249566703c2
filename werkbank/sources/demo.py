"""ERP and support views over the provided TPC-H-like tables.

The provided tables have no ERP schema, so each view derives one with per-row rules (the
same rules are written independently as SQL in the oracle). Article numbers and line texts
depend on the part key alone, so document lines need no join with ``part``.
"""

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from werkbank.sources.schemas import ERP, conform

# Letters and the references that stand for them in the pages.
SPELLED = {"ä": "&auml;", "ö": "&ouml", "ü": "&uuml;", "ß": "&szlig;", "é": "&#233;", "è": "&#xE8;", "ê": "&ecirc;",
           "ç": "&ccedil", "ñ": "&ntilde;", "ó": "&#xf3;", "í": "&iacute;"}
GROUPS = ("CP", "GC", "ME", "HD", "MB", "TW")
CHANNELS = {"AUTOMOBILE": 1, "BUILDING": 8, "FURNITURE": 2, "HOUSEHOLD": 3, "MACHINERY": 23}


# The provided tables that the views read, so that no job runs only to learn a schema.
PROVIDED = {
    "nation": "n_nationkey int, n_name string, n_regionkey int",
    "customer": "c_custkey bigint, c_name string, c_nationkey int, c_acctbal double, c_mktsegment string",
    "supplier": "s_suppkey bigint, s_name string, s_nationkey int, s_acctbal double",
    "part": "p_partkey bigint, p_name string, p_brand string, p_type string, p_size int, p_retailprice double",
    "orders": "o_orderkey bigint, o_custkey bigint, o_orderstatus string, o_totalprice double, "
              "o_orderdate timestamp_ntz, o_orderpriority string",
    "lineitem": "l_orderkey bigint, l_partkey bigint, l_suppkey bigint, l_linenumber int, l_quantity double, "
                "l_extendedprice double, l_discount double, l_tax double, l_returnflag string, "
                "l_linestatus string, l_shipdate timestamp_ntz",
    "events": "event_id bigint, ts timestamp_ntz, user_id bigint, event_type string, value double, props string",
    "documents": "doc_id bigint, text string, lang string, source string, n_chars bigint",
    "embeddings": "vec_id bigint, embedding array<float>, label int",
    "pages": "page_id bigint, url string, html string",
    "conversations": "conv_id bigint, turn bigint, role string, text string",
}


def table(spark: SparkSession, directory: str, name: str) -> DataFrame:
    return spark.read.schema(PROVIDED[name]).parquet(f"{directory}/{name}.parquet")


def _pick(index: Column, *values) -> Column:
    return F.elt((index + 1).cast("int"), *[F.lit(v).cast("string") for v in values])


def _text(*parts) -> Column:
    return F.concat(*[F.lit(p) if isinstance(p, str) else p.cast("string") for p in parts])


def sku_of(key: Column) -> Column:
    return _text(_pick(key % 6, *GROUPS), F.lpad(key.cast("string"), 12, "0"))


def articles(spark: SparkSession, directory: str) -> DataFrame:
    tier = "elt(p_size % 4 + 1, '3', '5', '7', '9')"
    ultra = "elt(p_size % 3 + 1, '5', '7', '9')"
    cpu = f"""CASE
        WHEN k % 5 < 3 THEN concat('Intel Core i', {tier}, '-', 10 + p_size % 5, {tier}, '00',
            elt(k % 3 + 1, '', 'K', 'KF'), if(k % 4 = 3, ' Tray', ''))
        WHEN k % 5 = 3 THEN concat('AMD Ryzen ', {tier}, ' ', 5 + p_size % 5, {tier}, '00',
            elt(p_size % 3 + 1, 'X', '', 'X3D'))
        ELSE concat('Intel Core Ultra ', {ultra}, ' 2', {ultra}, '5', elt(k % 2 + 1, '', 'K')) END"""
    gpu = """CASE
        WHEN k % 5 < 2 THEN concat('Geforce RTX ', elt(p_size % 4 + 1, '3060', '4060', '4070', '5080'), ' ',
            elt(k % 4 + 1, '4', '8', '12', '16'), 'GB')
        WHEN k % 5 = 2 THEN concat('Radeon RX ', elt(p_size % 3 + 1, '6600', '7700', '7900'), ' ',
            elt(k % 2 + 1, '8', '16'), 'GB')
        WHEN k % 5 = 3 THEN 'Quadro P1000 2048MB' ELSE 'Nvidia T400 1024MB' END"""
    name = f"""CASE p_partkey % 6 WHEN 0 THEN {cpu} WHEN 1 THEN {gpu}
        WHEN 2 THEN concat(elt(p_size % 4 + 1, '8', '16', '32', '64'), 'GB DDR', elt(k % 2 + 1, '4', '5'), ' ',
            elt(k % 3 + 1, '3200', '5600', '6000'))
        WHEN 3 THEN concat(elt(p_size % 3 + 1, '500', '1000', '2000'), 'Gb ', elt(k % 2 + 1, 'SSD', 'HDD'), ' ',
            p_brand)
        WHEN 4 THEN concat(p_name, ' ', p_brand)
        ELSE concat(elt(k % 6 + 1, 'CoolerMaster Elite 302', 'coolermaster elite 490', 'NZXT H510 Black',
            'Kolink Punisher RGB', 'Corsair Obsidian 500D Window', 'Nameless Tower'),
            elt(p_size % 3 + 1, ' TG', '', '')) END"""
    return (table(spark, directory, "part")
            .selectExpr("p_partkey", "p_size", "p_name", "p_brand", "cast(p_partkey div 6 AS int) AS k")
            .select(sku_of(F.col("p_partkey")).alias("Artikelnummer"), F.expr(name).alias("Bezeichnung"),
                    _pick(F.col("p_partkey") % 6, *GROUPS).alias("ArtikelGruppe"),
                    F.expr("if(p_partkey % 17 <> 0, lpad(p_partkey, 13, '0'), NULL)").alias("EANNummer"),
                    F.expr("concat(p_brand, '-', p_size)").alias("HstArtikelnummer")))


_CHANNEL = "CASE c_mktsegment " + " ".join(f"WHEN '{s}' THEN {n}" for s, n in CHANNELS.items()) + " END"


def _sales_headers(spark: SparkSession, directory: str, customers: bool) -> DataFrame:
    # Some numbers have a second header of another type, a day later or a day earlier.
    orders = table(spark, directory, "orders").selectExpr(
        "*", "CASE o_orderstatus WHEN 'F' THEN 'R' WHEN 'O' THEN 'L' ELSE 'D' END AS kind",
        "explode(CASE o_orderkey % 17 WHEN 0 THEN array(0, 1) WHEN 1 THEN array(0, -1) ELSE array(0) END) AS shift",
        "lpad(o_orderkey, 12, '0') AS padded").selectExpr(
        "*", "cast(o_totalprice + abs(shift) AS decimal(18,2)) AS gross",
        "o_orderdate + make_dt_interval(shift) AS made")
    cost = "if(o_orderkey % 19 <> 0, cast(gross * 0.8BD AS decimal(18,2)), NULL)"
    tax = "cast(gross * 0.19BD AS decimal(18,2))"
    core = orders.selectExpr(
        "concat(kind, 'A', padded) AS Belegnummer", "if(shift = 0, kind, 'S') AS Belegtyp",
        "CASE WHEN shift <> 0 THEN 1 WHEN kind <> 'R' AND o_orderpriority = '5-LOW' THEN 2 ELSE 0 END AS Status",
        "made AS AngelegtAm", "made AS Datum",
        "if(o_orderkey % 11 <> 0, concat('EXT-', o_orderkey), NULL) AS IhrAuftrag",
        "if(kind = 'R', concat('TR', o_orderkey), NULL) AS _TRACKING",
        "gross AS EuroBrutto", f"{cost} AS UebernahmeOffen", f"gross - {cost} AS ErloesEuro", f"{tax} AS Steuer",
        f"if(o_orderkey % 23 = 0, 0, gross - {tax}) AS Netto",
        "if(o_custkey % 41 = 0, -1, 0) AS Vertrag", "if(o_custkey % 7 = 3, 200, 100) AS Lager",
        "if(o_custkey = 0, 'K000000', concat('K', o_custkey)) AS Adressnummer",
        "CASE WHEN shift <> 0 THEN NULL WHEN kind = 'L' AND o_orderkey % 9 <> 0 THEN concat('ZA', padded) "
        "WHEN kind = 'L' THEN '' END "
        "AS LieferBelegNr",
        "if(o_orderkey % 43 = 0, 'T', '') AS Vorlage", "o_custkey AS _custkey")
    if not customers:
        return core
    people = table(spark, directory, "customer").join(
        table(spark, directory, "nation"), F.expr("c_nationkey = n_nationkey"), "left").selectExpr(
        "c_custkey AS _c", "c_name AS Name",
        "elt(cast(c_custkey % 4 + 1 AS int), cast(NULL AS string), '  ', 'Ada', 'Ben') AS Vorname",
        "if(c_custkey % 10 = 0, concat('Company ', c_custkey), NULL) AS _FIRMENNAME",
        "if(c_custkey % 13 <> 0, concat(lower(replace(c_name, '#', '')), '@example.com'), NULL) AS _EMAIL1",
        "concat('+49', c_custkey) AS _MOBILNUMMER",
        "if(c_custkey % 10 = 0, concat('DE', c_custkey), NULL) AS FreierText1",
        "elt(n_nationkey % 3 + 1, 'DE', 'FR', 'EN') AS Sprache", "n_name AS Land",
        "concat('Street ', c_custkey % 100) AS Strasse",
        "if(c_custkey % 31 = 0, '10997', cast(10000 + c_custkey % 90000 AS string)) AS PLZ",
        "concat('City ', c_custkey % 50) AS Ort",
        f"CASE WHEN c_custkey % 37 = 0 THEN NULL WHEN c_custkey % 29 = 0 THEN 99 ELSE {_CHANNEL} END AS Vertreter")
    return core.join(people, F.expr("_custkey = _c"), "left")


def _chain_headers(spark: SparkSession, directory: str) -> DataFrame:
    """Intermediate (Z) and original (U) documents behind each delivery note."""
    notes = table(spark, directory, "orders").filter("o_orderstatus = 'O'").selectExpr(
        "o_orderkey", "lpad(o_orderkey, 12, '0') AS padded", "2 AS Status", "o_orderdate AS AngelegtAm",
        "o_orderdate AS Datum", "'' AS Vorlage", "concat('K', o_custkey) AS Adressnummer")
    common = ["Status", "AngelegtAm", "Datum", "Vorlage", "Adressnummer"]
    middle = notes.selectExpr("concat('ZA', padded) AS Belegnummer", "'Z' AS Belegtyp",
                              "if(o_orderkey % 5 <> 0, concat('UA', padded), NULL) AS LieferBelegNr", *common)
    original = notes.selectExpr("concat('UA', padded) AS Belegnummer", "'U' AS Belegtyp",
                                "cast(NULL AS string) AS LieferBelegNr", *common)
    return middle.union(original)


_PURCHASE = "concat('B', lpad(l_suppkey, 9, '0'), '-', year(l_shipdate) * 100 + month(l_shipdate))"


def _purchase_headers(spark: SparkSession, directory: str) -> DataFrame:
    documents = table(spark, directory, "lineitem").selectExpr(
        "l_suppkey", f"{_PURCHASE} AS Belegnummer",
        "cast(trunc(l_shipdate, 'MM') AS timestamp_ntz) AS Datum").distinct()
    suppliers = table(spark, directory, "supplier").selectExpr("s_suppkey AS l_suppkey", "s_name AS Name")
    return documents.join(suppliers, "l_suppkey", "left").selectExpr(
        "Belegnummer", "'B' AS Belegtyp", "0 AS Status", "Datum AS AngelegtAm", "Datum", "Name",
        """CASE WHEN (l_suppkey + month(Datum)) % 11 = 0 THEN NULL
             WHEN (l_suppkey + month(Datum)) % 3 = 0 AND year(Datum) >= 2001 THEN -5
             WHEN (l_suppkey + month(Datum)) % 3 = 1 THEN 0 ELSE 7 END AS UebernahmeOffen""")


def _sku(key: str) -> str:
    groups = ", ".join(f"'{g}'" for g in GROUPS)
    return f"concat(elt(cast({key} % 6 + 1 AS int), {groups}), lpad({key}, 12, '0'))"


def _lines(df: DataFrame, number: str, kind: str, line_type: str) -> DataFrame:
    return df.selectExpr(
        "l_linenumber * 1000000000000000000 + l_partkey * 1000000000 + l_suppkey % 10000000 * 100 "
        "+ cast(l_quantity AS int) AS BELEGP_ID",
        f"{number} AS Belegnummer", f"{kind} AS Belegtyp", f"{_sku('l_partkey')} AS Artikelnummer",
        "if(l_partkey % 14 <> 0, concat('Item ', l_partkey), NULL) AS Bezeichnung",
        """cast(CASE WHEN l_linenumber = 6 AND l_returnflag = 'R' THEN -l_quantity
             WHEN l_linenumber = 4 THEN l_quantity / 2 ELSE l_quantity END AS decimal(18,4)) AS Menge""",
        "cast(l_quantity AS decimal(18,4)) AS EditMenge", "l_shipdate AS Datum",
        "cast(l_extendedprice AS decimal(18,2)) AS KalkpreisEuro",
        "if(l_linenumber <> 3, cast(l_extendedprice AS decimal(18,2)), NULL) AS Einzelpreis",
        "cast(l_extendedprice AS decimal(18,2)) AS Gesamtpreis", f"{line_type} AS Zeilentyp")


def document_lines(spark: SparkSession, directory: str) -> DataFrame:
    line = table(spark, directory, "lineitem")
    orders = table(spark, directory, "orders").selectExpr(
        "o_orderkey AS l_orderkey", "CASE o_orderstatus WHEN 'F' THEN 'R' WHEN 'O' THEN 'L' ELSE 'D' END AS kind")
    # A delivery has its current lines and those of its original, from one join.
    sold = line.join(orders, "l_orderkey").selectExpr(
        "*", "explode(CASE WHEN kind <> 'L' THEN array(kind) WHEN l_linenumber <> 5 THEN array('L', 'U') ELSE array('U') END) AS type")
    role = "CASE l_linenumber WHEN 1 THEN 'H' WHEN 7 THEN 'A' ELSE 'K' END"
    # Spelled out, so that who asks for purchases alone reads none of these.
    kind = "CASE type WHEN 'R' THEN 'R' WHEN 'L' THEN 'L' WHEN 'U' THEN 'U' ELSE 'D' END"
    sales = _lines(sold, "concat(type, 'A', lpad(l_orderkey, 12, '0'))", kind, role)
    purchases = _lines(line, _PURCHASE, "'B'", "if(l_linenumber = 7, 'T', 'A')")
    return sales.union(purchases)


def _lot() -> Column:
    return F.expr("l_partkey * 4 + l_suppkey % 4")


class _Tables(dict):
    """Tables that are built when they are first asked for."""

    def __init__(self, builders):
        super().__init__()
        self._builders = builders

    def __missing__(self, name: str) -> DataFrame:
        self[name] = conform(self._builders[name](), ERP[name])
        return self[name]


def _serials(spark: SparkSession, directory: str) -> DataFrame:
    return table(spark, directory, "lineitem").select(_lot().alias("Id"), "l_partkey").distinct().select(
        "Id", sku_of(F.col("l_partkey")).alias("Artikelnummer"),
        F.expr("if(Id % 9 = 0, 'O', 'S')").alias("SCTyp"))


def _stock(spark: SparkSession, directory: str) -> DataFrame:
    """Stock lines of all lots; only what was returned has units."""
    return table(spark, directory, "lineitem").select(
        _lot().alias("IdSerie"), F.expr("if(l_linenumber = 2 AND l_returnflag = 'R', l_quantity, 0)").alias("Bestand"),
        F.expr("if(l_linenumber = 5, 0, l_extendedprice)").alias("Wert"), F.col("l_shipdate").alias("AngelegtAm"))


def _channels(spark: SparkSession, directory: str) -> DataFrame:
    return table(spark, directory, "customer").select("c_mktsegment").distinct().selectExpr(
        f"{_CHANNEL} AS Nr", "initcap(c_mktsegment) AS Name")


def _headers(spark: SparkSession, directory: str, customers: bool) -> DataFrame:
    return _sales_headers(spark, directory, customers).unionByName(
        _chain_headers(spark, directory), allowMissingColumns=True).unionByName(
        _purchase_headers(spark, directory), allowMissingColumns=True)


def demo_erp(spark: SparkSession, directory: str, customers: bool = True) -> dict[str, DataFrame]:
    """The six ERP relations. Without ``customers`` the header columns that come from the
    customer table are NULL and that table is not read."""
    return _Tables({
        "art": lambda: articles(spark, directory), "beleg": lambda: _headers(spark, directory, customers),
        "belegp": lambda: document_lines(spark, directory), "serie": lambda: _serials(spark, directory),
        "lagerp": lambda: _stock(spark, directory), "mitarbw": lambda: _channels(spark, directory)})


# ---- support ---------------------------------------------------------------------------------

PROMPT_VERSION = "v2"
TRANSLATION_SETTINGS = {"instructions": "Translate to French.", "model": "local", "think": False,
                        "options": {"temperature": 0}}
_AT = "timestamp_ntz'2024-01-01 00:00:00' + make_dt_interval(0, cast(conv_id AS int), cast(turn AS int))"


def _message_id(conv: Column, turn: Column) -> Column:
    return _text("M", conv, "-", turn)


def ticket_pages(conversations: DataFrame) -> DataFrame:
    """Two response pages per ticket, in the three page shapes: one half-way through the conversation and one at
    its end, each with the ids of the messages so far."""
    last = conversations.groupBy("conv_id").agg(F.max("turn").alias("last"))
    asked = last.select("conv_id", F.explode(F.array_distinct(F.array(F.floor(F.col("last") / 2), "last"))).alias("turn"))
    turn, conv = F.col("turn"), F.col("conv_id")
    ids = F.transform(F.sequence(F.lit(0), turn.cast("int")), lambda i: _message_id(conv, i))
    ticket = F.to_json(F.struct(_text("T", conv).alias("id"), ids.alias("messages_ids")))
    shape = (conv + turn) % 3
    body = (F.when(shape == 0, F.concat(F.lit('{"data":['), ticket, F.lit(', 7, "x"]}')))
            .when(shape == 1, F.concat(F.lit('{"data":{"data":['), ticket, F.lit("]}}")))
            .otherwise(F.concat(F.lit('{"data":'), ticket, F.lit("}"))))
    return asked.select(turn.alias("revision"), body.alias("value"))


def raw_messages(spark: SparkSession, directory: str) -> DataFrame:
    return table(spark, directory, "conversations").select(*raw_message_columns())


def raw_message_columns() -> list[Column]:
    conv, turn, role = F.col("conv_id"), F.col("turn"), F.col("role")
    return [
        _message_id(conv, turn).alias("message_id"), _text("T", conv).alias("ticket_id"),
        F.when(role == "user", "Incoming").when(role == "assistant", "Outgoing").otherwise("Internal")
        .alias("direction"),
        F.col("text").alias("body"), turn.cast("int").alias("position"),
        F.expr(_AT).alias("cached_at")]


def message_positions(spark: SparkSession, directory: str) -> DataFrame:
    return table(spark, directory, "conversations").select(
        _text("T", F.col("conv_id")).alias("ticket_id"), F.col("turn").cast("int").alias("position"),
        _message_id(F.col("conv_id"), F.col("turn")).alias("message_id"))


def cached_messages(spark: SparkSession, directory: str) -> DataFrame:
    """Messages in the cache: a few were never fetched."""
    source = table(spark, directory, "conversations").filter((F.col("conv_id") * 8 + F.col("turn")) % 23 != 0)
    from werkbank.sources.support import normalise_messages
    return normalise_messages(source.select(*raw_message_columns()))


def cached_tickets(spark: SparkSession, directory: str) -> DataFrame:
    """Cached last message per ticket; some tickets are behind, some unknown."""
    behind = (F.col("conv_id") % 4 != 1) | (F.col("turn") < 2)
    return (table(spark, directory, "conversations").filter((F.col("conv_id") % 7 != 0) & behind)
            .groupBy(_text("T", F.col("conv_id")).alias("ticket_id"))
            .agg(F.max_by(_message_id(F.col("conv_id"), F.col("turn")), "turn").alias("last_message_id")))


def generation_logs(spark: SparkSession, directory: str) -> DataFrame:
    """Drafts (assistant turns 1 and 5) and reprompts (turns 3 and 7) per half of a
    conversation; every fifth conversation has lost its first drafts."""
    conv, turn = F.col("conv_id"), F.col("turn")
    first = turn % 4 == 1
    base = F.floor(turn / 4) * 4
    made = conv * 10 + turn
    return (table(spark, directory, "conversations").filter((F.col("role") == "assistant"))
            .filter(~(first & (conv % 5 == 0)))
            .select(made.alias("id"), _text("T", conv).alias("ticket_id"),
                    _message_id(conv, base).alias("based_on_message_id"),
                    F.when(first, "first_draft").otherwise("reprompt").alias("event_type"),
                    F.col("text").alias("response_text"),
                    F.when(turn % 8 != 5, F.array(_text("T", conv + 1), _text("T", conv + 2)))
                    .otherwise(F.array().cast("array<string>")).alias("sources"),
                    F.when(first, "").otherwise(_text("Revise ", _message_id(conv, turn))).alias("instructions"),
                    (turn + 1).cast("int").alias("message_count"),
                    F.expr(_AT).alias("created_at"),
                    F.lit(None).cast("string").alias("messages_json"),
                    F.when(~first, _text("Draft: ", F.col("text"))).alias("input_response_text"),
                    F.lit(None).cast("bigint").alias("first_draft_id"),
                    F.lit(PROMPT_VERSION).alias("prompt_version")))


def stored_drafts(spark: SparkSession, directory: str) -> DataFrame:
    """Drafts as stored: objects with or without sources, and bare texts; two versions."""
    conv, turn = F.col("conv_id"), F.col("turn")
    text = F.to_json(F.struct(F.col("text").alias("t")))
    quoted = F.substring(text, F.lit(6), F.length(text) - 6)
    body = (F.when(conv % 3 == 0, F.concat(F.lit('{"reply":'), quoted, F.lit("}")))
            .when(conv % 3 == 1, F.concat(F.lit('{"reply":'), quoted, F.lit(',"sources":["A","B"]}')))
            .otherwise(quoted))
    return (table(spark, directory, "conversations").filter((F.col("role") == "assistant") & (turn % 4 == 1))
            .select(_text("T", conv).alias("ticket_id"),
                    _message_id(conv, F.floor(turn / 4) * 4).alias("based_on_message_id"),
                    body.alias("response_json"),
                    F.expr(_AT).alias("created_at"),
                    F.when(conv % 6 == 5, "v1").otherwise(PROMPT_VERSION).alias("prompt_version")))


def translation_cache(spark: SparkSession, directory: str) -> DataFrame:
    """Cached translations of the texts of opening turns."""
    from werkbank.plans.support import translation_key
    return (table(spark, directory, "conversations").filter(F.col("turn") == 0)
            .select(translation_key(F.col("text"), TRANSLATION_SETTINGS).alias("cache_key"),
                    _text("FR ", F.col("text")).alias("translated_text")).distinct())


def contacts(spark: SparkSession, directory: str) -> DataFrame:
    """Contacts of a mail address: none, one, or the same one twice and another."""
    c = F.col("c_custkey")
    ids = (F.when(c % 5 == 0, F.array().cast("array<string>"))
           .when(c % 5 == 1, F.array(_text("C", c), _text("C", c), _text("D", c)))
           .otherwise(F.array(_text("C", c))))
    return table(spark, directory, "customer").select(
        _text(F.lower(F.regexp_replace("c_name", "#", "")), "@example.com").alias("email"),
        F.explode(ids).alias("contact_id"))


def contact_tickets(spark: SparkSession, directory: str) -> DataFrame:
    """Tickets of contacts; a third of the contacts has none."""
    c = F.col("c_custkey")
    return (table(spark, directory, "customer").filter(c % 3 != 0)
            .select(_text(F.when(c % 10 == 1, "D").otherwise("C"), c).alias("contact_id"),
                    F.explode(F.array(_text("T", c), _text("T", c + 1))).alias("ticket_id")))


def precedents(spark: SparkSession, directory: str) -> DataFrame:
    """Precedent tickets with vectors: the documents that have one."""
    vectors = table(spark, directory, "embeddings")
    texts = table(spark, directory, "documents")
    return vectors.join(texts, F.col("vec_id") == F.col("doc_id"), "left").select(
        F.col("vec_id").alias("chunk_id"), _text("T", F.col("vec_id")).alias("ticket_id"),
        F.col("source").alias("product_sku"), F.col("label").cast("string").alias("status"),
        F.col("text").alias("problem_text"), F.col("lang").alias("linked_resolution"),
        F.col("embedding").alias("vector"))


def health_checks(events: DataFrame) -> DataFrame:
    """Checks of a service (the user id) from its events: an error is a failed check, and the
    alert mail of a sign-up event is not accepted."""
    return events.select(
        F.col("user_id").alias("service"), F.col("event_id").alias("run_id"),
        (F.col("event_type") != "error").alias("healthy"), (F.col("event_type") != "signup").alias("mail_accepted"))


def pages(spark: SparkSession, directory: str) -> DataFrame:
    """Web pages whose accented letters are written as references: named, old names without a
    semicolon, decimal and hexadecimal numbers."""
    html = F.col("html")
    for letter, reference in SPELLED.items():
        html = F.replace(html, F.lit(letter), F.lit(reference))
    return table(spark, directory, "pages").withColumn("html", html)


def events(spark: SparkSession, directory: str) -> DataFrame:
    return table(spark, directory, "events").withColumn("ts", F.col("ts").cast("timestamp"))
