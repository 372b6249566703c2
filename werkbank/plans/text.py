"""Plain text of HTML messages and pages."""

from pyspark.sql import DataFrame, functions as F

from werkbank.functions.text import html_text


def html_to_text(pages: DataFrame, column: str = "html") -> DataFrame:
    return pages.withColumn("text", html_text(F.col(column))).drop(column)


def text_by_host(pages: DataFrame) -> DataFrame:
    """Pages and characters of text per host. Hosts are summed on the map side."""
    host = F.try_parse_url(F.col("url"), F.lit("HOST"))
    return pages.select(host.alias("host"), F.length(html_text(F.col("html"))).alias("_size")).groupBy("host").agg(
        F.count("*").alias("pages"), F.sum("_size").alias("characters"))
