"""Whole imports: list, resolve, subtract what is done, restore, record."""

from __future__ import annotations

from concurrent.futures import ThreadPoolExecutor
from datetime import datetime, timezone
from threading import Lock
from urllib.parse import quote

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tablehaul.operators import ledger as finished_items
from tablehaul.operators.restore import restore
from tablehaul.operators.targets import classify, detect_database, largest_first, name_contains
from tablehaul.plans.events import EventLog
from tablehaul.sources.dump_reader import read_schemas
from tablehaul.sources.inventory import FOLDER_DEPTH, HEADER_LINES, header_lines, list_dumps, require_dumps


def candidates(
    spark: SparkSession,
    folder: str,
    items: DataFrame | None = None,
    name_filter: str | None = None,
    forced: str | None = None,
    default: str | None = None,
    depth: int = FOLDER_DEPTH,
    max_lines: int = HEADER_LINES,
) -> DataFrame:
    """Every dump of a folder (or of a retry list's ``items``) with its status.

    Headers are read only where they can matter: not when a database is forced,
    and not for names the filter drops.
    """
    found = require_dumps(list_dumps(spark, folder, depth) if items is None else items)
    if forced is not None:
        with_header = found.withColumn("header_db", F.lit(None).cast("string"))
    else:
        wanted = found if name_filter is None else found.where(name_contains(F.col("file_name"), name_filter))
        named = detect_database(header_lines(wanted, max_lines), "path", max_lines)
        with_header = found.join(named, "path", "left")
    return classify(with_header, name_filter, forced, default)


def import_plan(classified: DataFrame, entries: DataFrame | None = None, ledger: DataFrame | None = None) -> DataFrame:
    """The tasks of a run, largest first, without what is finished already."""
    tasks = classified.where(F.col("status") == "task")
    if entries is not None:
        tasks = finished_items.pending(tasks, entries)
    if ledger is not None:
        tasks = finished_items.pending_exact(tasks, ledger)
    return largest_first(tasks)


def run_import(
    spark: SparkSession,
    plan: DataFrame,
    target_dir: str,
    ledger: str | None = None,
    overlap: int = 8,
) -> DataFrame:
    """Restore every planned dump to ``target_dir/database/table``; returns the events.

    A dump's tables go to folders named after its ``CREATE TABLE`` statements. A table that two
    items hold is restored from the first to come; the other fails, so nothing is mixed.
    An item is recorded in the ledger after its tables are committed. A dump with
    fewer parts than the cluster has cores has its lines dealt out first.
    """
    log = EventLog(overlap)
    claimed: dict[str, str] = {}
    claiming = Lock()
    cores = spark.sparkContext.defaultParallelism

    def one(task) -> None:
        with log.item(task.database, task.file_name, task.path, task.size_bytes):
            zipped = task.file_name.lower().endswith(".gz")
            spread = cores if zipped and task.parts < cores else None
            schemas = read_schemas(spark, task.path)
            names = sorted(schemas)
            if not names:
                raise ValueError(f"no CREATE TABLE in {task.path}")
            targets = [f"{target_dir.rstrip('/')}/{task.database}/{_folder(name)}" for name in names]
            with claiming:
                for target in targets:
                    if claimed.setdefault(target, task.path) != task.path:
                        raise ValueError(f"{target} is restored from {claimed[target]} in this run")
            for name, target in zip(names, targets):
                restore(spark, task.path, target, table=name, spread=spread, schemas=schemas)
            if ledger is not None:
                now = datetime.now(timezone.utc)
                row = [(task.database, task.relative_path, task.file_name, task.size_bytes, now)]
                finished_items.append_finished(spark.createDataFrame(row, finished_items.SCHEMA), ledger)

    with ThreadPoolExecutor(max_workers=max(1, overlap)) as pool:
        list(pool.map(one, plan.toLocalIterator()))
    return log.events(spark)


def _folder(table: str) -> str:
    """A table's name as one folder name."""
    return quote(table, safe=" !#$&'()+,;=@[]{}~") if "/" in table or table.startswith((".", "_")) else table
