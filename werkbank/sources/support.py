"""Readers of support data: ticket pages, messages and precedent tickets."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T

from werkbank.sources.schemas import PRECEDENTS, conform

TICKET = T.StructType([T.StructField("id", T.StringType()),
                       T.StructField("messages_ids", T.ArrayType(T.StringType()))])


def _objects(body: Column) -> Column:
    """The ticket objects of a response: ``data`` is a list, or a dict that holds ``data`` (or
    is itself the one ticket); anything but an object is left out."""
    data = F.get_json_object(body, "$.data")
    single = F.coalesce(F.get_json_object(data, "$.data"), F.concat(F.lit("["), data, F.lit("]")))
    listed = F.when(data.startswith("{"), single).otherwise(data)
    elements = F.when(listed.startswith("["), F.from_json(listed, "array<string>"))
    return F.filter(elements, lambda e: e.startswith("{"))


def parse_ticket_pages(pages: DataFrame, body: str = "value") -> DataFrame:
    """Tickets ``(ticket_id, message_ids)`` of landed response pages, batch or stream."""
    ticket = F.from_json("_object", TICKET)
    return (pages.withColumn("_object", F.explode(_objects(F.col(body)))).withColumn("_ticket", ticket)
            .withColumn("ticket_id", F.col("_ticket.id"))
            .withColumn("message_ids", F.coalesce("_ticket.messages_ids", F.array().cast("array<string>")))
            .drop(body, "_object", "_ticket"))


def ingest_tickets(spark: SparkSession, directory: str) -> DataFrame:
    """Tickets of all landed pages, one file per page."""
    return parse_ticket_pages(spark.read.text(directory, wholetext=True))


def normalise_messages(raw: DataFrame) -> DataFrame:
    """Raw messages with ``direction`` and ``body`` as cached messages: incoming is the
    customer, outgoing is support, anything else is kept but invisible and empty."""
    incoming, outgoing = F.col("direction") == "Incoming", F.col("direction") == "Outgoing"
    shown = F.coalesce(incoming | outgoing, F.lit(False))
    return (raw.withColumn("role", F.when(incoming, "Customer").when(outgoing, "Support").otherwise(""))
            .withColumn("body", F.when(shown, F.coalesce("body", F.lit(""))).otherwise(""))
            .withColumn("visible", shown).drop("direction"))


def load_precedents(spark: SparkSession, directory: str) -> DataFrame:
    return conform(spark.read.parquet(f"{directory}/precedents.parquet"), PRECEDENTS)
