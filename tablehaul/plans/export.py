"""Whole exports: which tables, under which names, and the run itself."""

from __future__ import annotations

from collections.abc import Callable
from concurrent.futures import ThreadPoolExecutor

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tablehaul.functions.names import comma_list, output_name
from tablehaul.operators.dump_writer import write_dump
from tablehaul.plans.events import EventLog

# Schemas a server keeps for itself.
SYSTEM_SCHEMAS = ["information_schema", "performance_schema", "mysql", "sys"]


def select_tables(
    catalog: DataFrame,
    database: str | None = None,
    databases: str | None = None,
    all_databases: bool = False,
    tables: str | None = None,
    exclude_tables: str | None = None,
) -> DataFrame:
    """Rows of the catalog that a run asks for.

    The first of ``database``, ``databases`` (comma list) and ``all_databases``
    that is given decides; include and exclude lists then both apply.
    """
    db, name = F.col("db"), F.col("table_name")
    if database is not None:
        wanted = db == database
    elif databases is not None:
        wanted = db.isin(comma_list(databases))
    elif all_databases:
        wanted = ~db.isin(SYSTEM_SCHEMAS)
    else:
        raise ValueError("name a database, several databases, or all of them")
    if tables is not None:
        wanted = wanted & name.isin(comma_list(tables))
    if exclude_tables is not None:
        wanted = wanted & ~name.isin(comma_list(exclude_tables))
    return catalog.where(wanted)


def export_plan(catalog: DataFrame, out_dir: str, compress: bool = False, **choice) -> DataFrame:
    """Chosen tables with ``file_name`` and ``output_path``, largest first."""
    single = choice.get("database") is not None
    name = output_name(F.col("db"), F.col("table_name"), single, compress)
    planned = (
        select_tables(catalog, **choice)
        .withColumn("file_name", name)
        .withColumn("output_path", F.concat(F.lit(out_dir.rstrip("/") + "/"), F.col("file_name")))
        .withColumnsRenamed({"db": "database", "bytes": "estimated_bytes", "rows": "estimated_rows"})
    )
    return planned.orderBy(F.col("estimated_bytes").desc(), "database", "table_name")


def run_export(
    spark: SparkSession,
    plan: DataFrame,
    read_table: Callable[[str, str], DataFrame],
    compress: bool = False,
    overlap: int = 8,
    **options,
) -> DataFrame:
    """Write every planned table; returns the run's events.

    Each table is one Spark job over all executors. A few jobs are in flight at
    once so that small tables do not leave executors idle. A table that fails
    leaves no output and does not stop the others. Only names and sizes of
    tables pass through here.
    """
    log = EventLog(overlap)

    def one(task) -> None:
        with log.item(task.database, task.file_name, task.output_path, task.estimated_bytes) as written:
            df = read_table(task.database, task.table_name)
            written |= write_dump(df, task.output_path, task.database, task.table_name, compress, **options)

    with ThreadPoolExecutor(max_workers=max(1, overlap)) as pool:
        list(pool.map(one, plan.toLocalIterator()))
    return log.events(spark)


def export_report(plan: DataFrame, events: DataFrame) -> DataFrame:
    """Every planned table with its estimates, what was written in truth, and its state.

    ``written_rows`` and ``written_bytes`` (of text, before compression) are null unless the table was finished; ``state`` is
    the last event's kind, ``pending`` for a table without any. A table written twice counts as written last.
    """
    told = F.struct("event_id", "kind", "written_rows", "written_bytes", "message")
    last = events.groupBy(F.col("file_path").alias("output_path")).agg(F.max(told).alias("e"))
    return plan.join(last, "output_path", "left").select(
        "database", "table_name", "output_path", "estimated_rows", "estimated_bytes",
        F.col("e.written_rows").alias("written_rows"), F.col("e.written_bytes").alias("written_bytes"),
        F.coalesce("e.kind", F.lit("pending")).alias("state"), F.col("e.message").alias("message"),
    )
