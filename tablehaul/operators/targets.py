"""Which database each dump belongs to, and what a folder adds up to."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tablehaul.functions.headers import ends_header, named_database
from tablehaul.functions.names import guess_database, size_mb
from tablehaul.sources.inventory import HEADER_LINES

# Reasons a candidate is skipped.
NO_METADATA = "Cannot read file metadata"
NO_DATABASE = (
    "Cannot detect target database from header or filename. Use --database or --default-database."
)


def detect_database(lines: DataFrame, key: str, max_lines: int = HEADER_LINES) -> DataFrame:
    """The database named in each file's header: ``key, header_db``.

    The first line that names a database or ends the header decides; when it
    ends the header there is none. One partial aggregate: only each file's
    earliest deciding line leaves a map task.
    """
    ends = ends_header(F.col("line"))
    name = F.when(~ends, named_database(F.col("line")))
    deciding = lines.where(F.col("line_no") <= max_lines).select(
        key, "line_no", name.alias("header_db"), ends.alias("_ends")
    ).where(F.col("_ends") | F.col("header_db").isNotNull())
    first = deciding.groupBy(key).agg(F.min(F.struct("line_no", "header_db")).alias("first"))
    return first.select(key, F.col("first.header_db").alias("header_db")).where(F.col("header_db").isNotNull())


def resolve_database(
    file_name: Column, header_db: Column, forced: str | None = None, default: str | None = None
) -> Column:
    """Forced name, else header, else default, else a guess from the file name."""
    return F.coalesce(
        F.lit(forced).cast("string"), header_db, F.lit(default).cast("string"), guess_database(file_name)
    )


def name_contains(file_name: Column, part: str) -> Column:
    """The file name filter: a substring in any case, not a glob."""
    return F.contains(F.lower(file_name), F.lit(part.lower()))


def classify(
    items: DataFrame,
    name_filter: str | None = None,
    forced: str | None = None,
    default: str | None = None,
) -> DataFrame:
    """Adds ``database, size_mb, status, reason``; status is task, skipped or filtered."""
    wanted = F.lit(True) if name_filter is None else name_contains(F.col("file_name"), name_filter)
    with_db = items.withColumn(
        "database", resolve_database(F.col("file_name"), F.col("header_db"), forced, default)
    )
    reason = F.when(
        wanted, F.when(F.col("size_bytes").isNull(), NO_METADATA).when(F.col("database").isNull(), NO_DATABASE)
    )
    status = F.when(~wanted, "filtered").when(F.col("reason").isNotNull(), "skipped").otherwise("task")
    return (
        with_db.withColumn("reason", reason)
        .withColumn("status", status)
        .withColumn("database", F.when(F.col("status") == "task", F.col("database")))
        .withColumn("size_mb", size_mb(F.col("size_bytes")))
    )


def database_summary(tasks: DataFrame) -> DataFrame:
    return tasks.groupBy("database").agg(
        F.count("*").alias("files"), F.sum("size_bytes").alias("size_bytes")
    )


def totals(tasks: DataFrame) -> DataFrame:
    return tasks.agg(
        F.count("*").alias("files"), F.coalesce(F.sum("size_bytes"), F.lit(0).cast("bigint")).alias("size_bytes")
    )


def largest_first(tasks: DataFrame) -> DataFrame:
    """Longest work first; equal sizes keep path order."""
    return tasks.orderBy(F.col("size_bytes").desc(), F.col("path").asc())
