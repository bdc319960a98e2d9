"""Finished items: recording them, and subtracting them from the work."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tablehaul.functions.names import base_name

SCHEMA = "database string, relative_path string, file_name string, size_bytes bigint, finished_at timestamp"


def append_finished(finished: DataFrame, ledger: str) -> None:
    """Record items after their data is committed. Appends rows, rewrites nothing.

    Each call writes a subfolder of its own: jobs that append to one folder at
    the same time would remove each other's uncommitted files.
    """
    finished.select("database", "relative_path", "file_name", "size_bytes", "finished_at").write.parquet(
        f"{ledger}/append-{uuid.uuid4().hex}"
    )


def read_ledger(spark: SparkSession, ledger: str) -> DataFrame:
    """The latest record of each item, so recording one twice changes nothing."""
    rows = spark.read.schema(SCHEMA).option("recursiveFileLookup", "true").parquet(ledger)
    latest = rows.groupBy("database", "relative_path").agg(
        F.max(F.struct("finished_at", "file_name", "size_bytes")).alias("l")
    )
    return latest.select("database", "relative_path", "l.file_name", "l.size_bytes", "l.finished_at")


def match_keys(entries: DataFrame) -> DataFrame:
    """Lower-cased names to match against: each entry and its last path segment."""
    entry = F.lower("entry")
    return entries.select(F.explode(F.array_distinct(F.array(entry, base_name(entry)))).alias("_key"))


def _with_key(tasks: DataFrame) -> DataFrame:
    return tasks.withColumn("_key", F.lower("file_name"))


def pending(tasks: DataFrame, entries: DataFrame) -> DataFrame:
    """Tasks not yet finished, matched by name in any case.

    The keys hold the last segment of every entry, so an entry that names a
    task's whole path also names the task: one join on the name does. Repeated
    keys do not matter to this join, so they are left as they are: adaptive
    execution can then split the tasks that share a very common name, which it
    cannot when an aggregate stands between the shuffle and the join.
    """
    return _with_key(tasks).join(match_keys(entries), "_key", "left_anti").drop("_key")


def finished(tasks: DataFrame, entries: DataFrame) -> DataFrame:
    return _with_key(tasks).join(match_keys(entries), "_key", "left_semi").drop("_key")


def pending_exact(tasks: DataFrame, ledger: DataFrame) -> DataFrame:
    """Tasks not in the ledger by database and relative path: equal names do not collide."""
    return tasks.join(ledger.select("database", "relative_path"), ["database", "relative_path"], "left_anti")


def _split_totals(tasks: DataFrame, entries: DataFrame, *groups: str) -> DataFrame:
    """Files and bytes per group and whether they are done.

    Tasks are summed by name before they meet the list, so a name that very many
    tasks share is one row per group by then.
    """
    by_name = _with_key(tasks).groupBy(*groups, "_key").agg(
        F.count("*").alias("files"), F.sum("size_bytes").alias("size_bytes")
    )
    keys = match_keys(entries).distinct().withColumn("_hit", F.lit(True))
    return by_name.join(keys, "_key", "left").withColumn("done", F.col("_hit").isNotNull())


def _sum_where(which: Column, name: str) -> Column:
    return F.coalesce(F.sum(F.when(which, F.col(name))), F.lit(0).cast("bigint"))


def skipped_totals(tasks: DataFrame, entries: DataFrame) -> DataFrame:
    done = F.col("done")
    return _split_totals(tasks, entries).agg(
        _sum_where(done, "files").alias("skipped_files"),
        _sum_where(done, "size_bytes").alias("skipped_bytes"),
        _sum_where(~done, "files").alias("remaining_files"),
        _sum_where(~done, "size_bytes").alias("remaining_bytes"),
    )


def database_breakdown(tasks: DataFrame, entries: DataFrame) -> DataFrame:
    """Per database what remains, and how many were skipped, if any."""
    left = ~F.col("done")
    counted = _split_totals(tasks, entries, "database").groupBy("database").agg(
        _sum_where(left, "files").alias("files"),
        _sum_where(left, "size_bytes").alias("size_bytes"),
        _sum_where(F.col("done"), "files").alias("_skipped"),
    )
    skipped = F.when(F.col("_skipped") > 0, F.col("_skipped"))
    return counted.where("files > 0").select("database", "files", "size_bytes", skipped.alias("skipped"))


def missing_databases(tasks: DataFrame, existing: DataFrame) -> DataFrame:
    """Databases the tasks need that the target lacks; names compare in any case."""
    needed = tasks.select("database").distinct().withColumn("_key", F.lower("database"))
    have = existing.select(F.lower("database").alias("_key")).distinct()
    return needed.join(have, "_key", "left_anti").select("database").orderBy("database")


def create_databases(spark: SparkSession, missing: DataFrame) -> list[str]:
    """Create each missing database; one statement per name."""
    names = [r.database for r in missing.toLocalIterator()]
    for name in names:
        spark.sql("CREATE DATABASE IF NOT EXISTS " + "`" + name.replace("`", "``") + "`")
    return names


def mismatch_sample(tasks: DataFrame, entries: DataFrame, size: int = 3) -> DataFrame:
    """A few names of each side, for the warning that a list matched nothing."""
    listed = entries.select(F.lit("entry").alias("side"), F.col("entry").alias("name")).orderBy("name").limit(size)
    files = (
        tasks.orderBy(F.col("size_bytes").desc(), "path")
        .limit(size)
        .select(F.lit("file").alias("side"), F.col("file_name").alias("name"))
    )
    return listed.unionAll(files)
