"""Dump items back to tables, whole or not at all."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from tablehaul.sources.dump_reader import find_problems, read_dump, read_lines, read_schema, read_schemas


def restore(
    spark: SparkSession,
    path: str,
    target: str,
    schema: T.StructType | None = None,
    table: str | None = None,
    spread: int | None = None,
    mode: str = "overwrite",
    schemas: dict[str, T.StructType] | None = None,
) -> None:
    """Restore a dump to Parquet at ``target``, one pass over the text.

    A line, row or value that is not understood fails the job, and the job's
    commit then never happens: no half-filled table is left to be read.
    ``quarantine`` shows what was wrong. As a dump drops its table first, a
    table already at ``target`` is replaced; ``mode="append"`` suits a dump of
    rows only. ``schemas`` as for ``read_dump``.
    """
    read_dump(spark, path, schema, table, spread, schemas).write.mode(mode).parquet(target)


def restore_as_table(spark: SparkSession, path: str, database: str, table: str, spread: int | None = None) -> None:
    """Restore a dump as a table of the session's catalog."""
    read_dump(spark, path, spread=spread).write.mode("overwrite").saveAsTable(f"`{database}`.`{table}`")


def quarantine(spark: SparkSession, path: str, table: str | None = None) -> DataFrame:
    """The lines, rows and values of a dump that a restore would fail on."""
    name, schema = read_schema(spark, path, table)
    others = tuple(sorted(set(read_schemas(spark, path)) - {name}))
    return find_problems(read_lines(spark, path), schema, name, others)
