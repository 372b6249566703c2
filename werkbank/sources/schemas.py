"""Column contracts of the ERP relations and the support tables."""

from pyspark.sql import DataFrame, types as T

MONEY = T.DecimalType(18, 2)
QUANTITY = T.DecimalType(18, 4)
_S, _I, _L, _B, _TS = (T.StringType(), T.IntegerType(), T.LongType(), T.BooleanType(),
                       T.TimestampType())
_WALL = T.TimestampNTZType()  # ERP times are wall-clock times


def _schema(**columns: T.DataType) -> T.StructType:
    return T.StructType([T.StructField(name, kind) for name, kind in columns.items()])


ART = _schema(Artikelnummer=_S, Bezeichnung=_S, ArtikelGruppe=_S, EANNummer=_S,
              HstArtikelnummer=_S)

BELEG = _schema(
    Belegnummer=_S, Belegtyp=_S, Status=_I, AngelegtAm=_WALL, Datum=_WALL, IhrAuftrag=_S,
    Name=_S, Vorname=_S, _FIRMENNAME=_S, _EMAIL1=_S, _MOBILNUMMER=_S, _TRACKING=_S,
    FreierText1=_S, Sprache=_S, Land=_S, Strasse=_S, PLZ=_S, Ort=_S, EuroBrutto=MONEY,
    UebernahmeOffen=MONEY, ErloesEuro=MONEY, Steuer=MONEY, Netto=MONEY, Vertreter=_I,
    Vertrag=_I, Lager=_I, Adressnummer=_S, LieferBelegNr=_S, Vorlage=_S)

BELEGP = _schema(
    BELEGP_ID=_L, Belegnummer=_S, Belegtyp=_S, Artikelnummer=_S, Bezeichnung=_S,
    Menge=QUANTITY, EditMenge=QUANTITY, Datum=_WALL, KalkpreisEuro=MONEY, Einzelpreis=MONEY,
    Gesamtpreis=MONEY, Zeilentyp=_S)

SERIE = _schema(Id=_L, Artikelnummer=_S, SCTyp=_S)
LAGERP = _schema(IdSerie=_L, Bestand=QUANTITY, Wert=MONEY, AngelegtAm=_WALL)
MITARBW = _schema(Nr=_I, Name=_S)

ERP = {"art": ART, "beleg": BELEG, "belegp": BELEGP, "serie": SERIE, "lagerp": LAGERP,
       "mitarbw": MITARBW}

MESSAGES = _schema(message_id=_S, ticket_id=_S, role=_S, body=_S, position=_I, visible=_B,
                   cached_at=_TS)
TICKETS = _schema(ticket_id=_S, last_message_id=_S, message_ids=T.ArrayType(_S), synced_at=_TS)
DRAFTS = _schema(ticket_id=_S, based_on_message_id=_S, response_json=_S, created_at=_TS,
                 prompt_version=_S)
TRANSLATIONS = _schema(cache_key=_S, translated_text=_S, created_at=_TS)
GENERATION_LOGS = _schema(
    id=_L, ticket_id=_S, based_on_message_id=_S, event_type=_S, response_text=_S,
    sources=T.ArrayType(_S), instructions=_S, message_count=_I, created_at=_TS,
    messages_json=_S, input_response_text=_S, first_draft_id=_L, prompt_version=_S)
PRECEDENTS = _schema(chunk_id=_L, ticket_id=_S, product_sku=_S, status=_S, problem_text=_S,
                     linked_resolution=_S, vector=T.ArrayType(T.FloatType()))
FORECAST = _schema(run_id=_S, run_date=T.DateType(), created_at=_WALL, weeks=_I, sku=_S, name=_S,
                   weekly_forecast=T.DoubleType(), stock_coverage=T.DoubleType())


def conform(df: DataFrame, schema: T.StructType) -> DataFrame:
    """Select and cast the columns of ``schema``; a missing column becomes NULL, and so does a
    text that is no time where a time is wanted."""
    present = set(df.columns)

    def cast(field: T.StructField) -> str:
        kind = "TRY_CAST" if isinstance(field.dataType, (T.TimestampType, T.TimestampNTZType)) else "CAST"
        value = f"`{field.name}`" if field.name in present else "NULL"
        return f"{kind}({value} AS {field.dataType.simpleString()}) AS `{field.name}`"

    return df.selectExpr(*[cast(field) for field in schema.fields])
