"""Tables of a database server over JDBC. Credentials travel as options."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

CATALOG_SELECT = (
    "(SELECT TABLE_SCHEMA AS db, TABLE_NAME AS table_name, TABLE_TYPE AS table_type, "
    "DATA_LENGTH AS data_length, INDEX_LENGTH AS index_length, TABLE_ROWS AS table_rows "
    "FROM information_schema.TABLES) t"
)


def read_catalog(spark: SparkSession, url: str, options: dict[str, str]) -> DataFrame:
    """The server's table listing; filters on it are pushed to the server."""
    return spark.read.format("jdbc").options(url=url, dbtable=CATALOG_SELECT, **options).load()


def key_bounds(spark: SparkSession, url: str, table: str, column: str, options: dict[str, str]) -> tuple:
    """Smallest and largest key, computed by the server (pushed-down aggregate)."""
    whole = spark.read.format("jdbc").options(url=url, dbtable=table, pushDownAggregate="true", **options).load()
    row = whole.agg(F.min(column).alias("low"), F.max(column).alias("high")).first()
    return row.low, row.high


def read_table(
    spark: SparkSession,
    url: str,
    table: str,
    options: dict[str, str],
    column: str | None = None,
    parts: int | None = None,
    fetch_rows: int = 10000,
) -> DataFrame:
    """A table as key ranges read side by side; without a key column, one task.

    The ranges split the span of the key evenly, so choose a key without large gaps.
    """
    reader = spark.read.format("jdbc").options(url=url, dbtable=table, fetchsize=str(fetch_rows), **options)
    if column is not None and parts and parts > 1:
        low, high = key_bounds(spark, url, table, column, options)
        if low is not None:
            reader = reader.options(
                partitionColumn=column, lowerBound=str(low), upperBound=str(high), numPartitions=str(parts)
            )
    return reader.load()


def write_table(
    df: DataFrame,
    url: str,
    table: str,
    options: dict[str, str],
    mode: str = "append",
    batch_rows: int = 5000,
    connections: int = 16,
) -> None:
    """Insert rows in batches over a bounded number of connections."""
    df.write.format("jdbc").options(
        url=url, dbtable=table, batchsize=str(batch_rows), numPartitions=str(connections), **options
    ).mode(mode).save()
