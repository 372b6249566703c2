"""Readers for the six ERP relations."""

from pyspark.sql import DataFrame, SparkSession

from werkbank.sources.schemas import ERP, conform


def load_erp(spark: SparkSession, directory: str) -> dict[str, DataFrame]:
    """The ERP relations from ``<directory>/<table>.parquet``, in their contract types."""
    return {name: conform(spark.read.parquet(f"{directory}/{name}.parquet"), schema)
            for name, schema in ERP.items()}


def load_erp_jdbc(spark: SparkSession, url: str, split: dict[str, tuple[str, int, int, int]],
                  schema: str = "dbo", properties: dict[str, str] | None = None,
                  ) -> dict[str, DataFrame]:
    """The ERP relations over JDBC.

    ``split`` names for each table ``(column, lower, upper, partitions)``, so that the read
    is spread over tasks; a table without an entry is read by one task and should be small.
    """
    tables = {}
    for name, contract in ERP.items():
        reader = spark.read.format("jdbc").option("url", url).option(
            "dbtable", f"{schema}.{name.upper()}").options(**(properties or {}))
        if name in split:
            column, lower, upper, partitions = split[name]
            reader = reader.options(partitionColumn=column, lowerBound=lower, upperBound=upper,
                                    numPartitions=partitions)
        tables[name] = conform(reader.load(), contract)
    return tables
