"""Which databases and tables there are, with their sizes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

def _number(text: Column) -> Column:
    """A whole number of at least zero; anything else counts as zero."""
    number = F.btrim(text).try_cast("bigint")
    return F.when(number >= 0, number).otherwise(F.lit(0).cast("bigint"))


def normalise(raw: DataFrame) -> DataFrame:
    """Base tables of an ``information_schema``-like listing, missing sizes as zero."""
    zero = F.lit(0).cast("bigint")
    return raw.where(F.col("table_type") == "BASE TABLE").select(
        "db",
        "table_name",
        F.coalesce(F.col("data_length") + F.col("index_length"), zero).alias("bytes"),
        F.coalesce("table_rows", zero).alias("rows"),
    )


def from_lines(lines: DataFrame) -> DataFrame:
    """A tab-separated listing (database, table, bytes, rows); short lines drop out."""
    parts = F.split("value", "\t")
    return lines.where(F.size(parts) >= 4).select(
        F.btrim(F.get(parts, 0)).alias("db"),
        F.btrim(F.get(parts, 1)).alias("table_name"),
        _number(F.get(parts, 2)).alias("bytes"),
        _number(F.get(parts, 3)).alias("rows"),
    )


def parquet_tables(spark: SparkSession, folder: str, database: str) -> DataFrame:
    """Tables kept as Parquet under ``folder``, one file or subfolder each.

    Sizes come from the listing, row counts from Parquet footers: no column is read.
    """
    root = folder.rstrip("/")
    after = F.substring_index(F.col("path"), root + "/", -1)
    name = F.regexp_replace(F.substring_index(after, "/", 1), r"\.parquet$", "")
    files = (
        spark.read.format("binaryFile")
        .option("recursiveFileLookup", "true")
        .load(folder)
        .select(name.alias("table_name"), F.col("length").alias("bytes"))
        .groupBy("table_name")
        .agg(F.sum("bytes").alias("bytes"))
    )
    rows = (
        spark.read.schema(T.StructType())
        .option("recursiveFileLookup", "true")
        .parquet(folder)
        # metadata paths are URLs, the listing's are not
        .select(F.url_decode(F.replace(F.col("_metadata.file_path"), F.lit("+"), F.lit("%2B"))).alias("path"))
        .groupBy(name.alias("table_name"))
        .agg(F.count("*").alias("rows"))
    )
    return files.join(rows, "table_name", "left").select(
        F.lit(database).alias("db"), "table_name", "bytes", F.coalesce("rows", F.lit(0).cast("bigint")).alias("rows")
    )


def session_tables(spark: SparkSession, database: str) -> DataFrame:
    """Names and kinds of the tables of a session catalog's database (no sizes)."""
    listed = spark.catalog.listTables(database)
    rows = [
        (database, t.name, "VIEW" if t.isTemporary or t.tableType == "VIEW" else "BASE TABLE", None, None, None)
        for t in listed
    ]
    return spark.createDataFrame(
        rows,
        "db string, table_name string, table_type string, data_length bigint, index_length bigint, table_rows bigint",
    )


def session_databases(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(d.name,) for d in spark.catalog.listDatabases()], "database string")
