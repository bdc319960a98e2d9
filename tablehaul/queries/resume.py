"""Finished items and what they leave to do."""

from __future__ import annotations

from concurrent.futures import ThreadPoolExecutor
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tablehaul.operators import ledger, versions
from tablehaul.queries import views
from tablehaul.queries.inventory import TASKS, tasks
from tablehaul.queries.views import oracle, table
from tablehaul.session import fresh_dir
from tablehaul.sources import finished

# Entries per finished-item document: documents stay small however many there are.
PER_DOCUMENT = 500

KEYS = """
SELECT DISTINCT lower(unnest([entry, regexp_replace(entry, '^.*/', '')])) AS k FROM done
"""
IS_DONE = f"lower(file_name) IN (SELECT k FROM ({KEYS}) ks)"


def _documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Finished-item documents in all forms, one per id range."""
    done = views.done(spark, sf_dir)
    number = F.floor(F.col("file_id") / PER_DOCUMENT).cast("bigint")
    grouped = done.groupBy(number.alias("document")).agg(F.sort_array(F.collect_list("entry")).alias("e"))
    half = F.floor(F.size("e") / 2).cast("int")
    both = F.to_json(
        F.struct(
            F.lit("2024-01-31T10:00:00Z").alias("last_updated"),
            F.slice("e", F.lit(1), half).alias("completed_files"),
            F.slice("e", half + 1, F.size("e")).alias("completed_tables"),
        )
    )
    plain = F.to_json(F.struct(F.col("e").alias("completed_files")))
    which = F.col("document") % 5
    content = (
        F.when(which == 0, plain)
        .when(which == 1, both)
        .when(which == 2, F.to_json("e"))
        .when(which == 3, F.array_join("e", "\n"))
        .otherwise("{ damaged")
    )
    return grouped.select("document", content.alias("content"), F.when(which == 4, both).alias("backup"))


def manifest_load(spark: SparkSession, sf_dir: str) -> DataFrame:
    parsed = finished.parse_documents(_documents(spark, sf_dir), strict_lines=True)
    return parsed.groupBy("form").agg(
        F.count("*").alias("documents"),
        F.sum(F.size("entries")).cast("bigint").alias("entries"),
        F.count("last_updated").alias("dated"),
    )


# The same entries, with the plain-line form keeping only lower or upper .sql.
LISTED = f"""
SELECT DISTINCT entry, doc, doc % 5 AS form FROM (SELECT entry, file_id // {PER_DOCUMENT} AS doc FROM done) d
WHERE doc % 5 <> 3 OR entry LIKE '%.sql' OR entry LIKE '%.SQL'
"""
LOAD_SQL = oracle(
    "inv done",
    f"""SELECT CASE form WHEN 0 THEN 'object' WHEN 1 THEN 'object' WHEN 2 THEN 'array' WHEN 3 THEN 'lines' ELSE 'backup' END AS form,
  count(DISTINCT doc) AS documents, count(*) AS entries, count(DISTINCT CASE WHEN form IN (1, 4) THEN doc END) AS dated
FROM ({LISTED}) l GROUP BY 1""",
)


def manifest_entries(spark: SparkSession, sf_dir: str) -> DataFrame:
    return finished.entries(finished.parse_documents(_documents(spark, sf_dir)))


def manifest_discover(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per run, the first of four places that lists anything."""
    docs = _documents(spark, sf_dir)
    places = F.array(*[F.struct(F.lit(i).alias("priority"), F.lit(p).alias("path")) for i, p in enumerate(finished.candidates("logs", "dumps"))])
    tried = docs.withColumn("c", F.explode(places)).select("document", "c.*", "content", "backup")
    empty = F.col("priority") < F.col("document") % 3
    content = F.when(empty, F.when(F.col("priority") == 0, '{"completed_files": []}').otherwise("no list")).otherwise(F.col("content"))
    tried = tried.withColumn("content", content).withColumn("backup", F.when(~empty, F.col("backup")))
    chosen = finished.first_with_entries(finished.parse_documents(tried), "document")
    return chosen.select("document", "path", F.size("entries").cast("bigint").alias("entries"))


DISCOVER_SQL = oracle(
    "inv done",
    f"""SELECT doc AS document, CASE doc % 3 WHEN 0 THEN 'logs/manifest.json' WHEN 1 THEN 'dumps/logs/manifest.json'
  ELSE 'dumps/manifest.json' END AS path, count(DISTINCT entry) AS entries
FROM (SELECT entry, file_id // {PER_DOCUMENT} AS doc FROM done) d GROUP BY doc""",
)


def _entries(spark: SparkSession, sf_dir: str) -> DataFrame:
    return views.done(spark, sf_dir).select("entry")


def resume_pending(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ledger.pending(tasks(spark, sf_dir), _entries(spark, sf_dir)).select("path", "database", "size_bytes")


def resume_skipped(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ledger.skipped_totals(tasks(spark, sf_dir), _entries(spark, sf_dir))


def database_breakdown(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ledger.database_breakdown(tasks(spark, sf_dir), _entries(spark, sf_dir))


def resume_mismatch_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    foreign = _entries(spark, sf_dir).select(F.concat(F.lit("other_"), views.base_name(F.col("entry"))).alias("entry"))
    return ledger.mismatch_sample(tasks(spark, sf_dir), foreign)


def missing_databases(spark: SparkSession, sf_dir: str) -> DataFrame:
    segments = table(spark, sf_dir, "customer")
    existing = segments.select(F.concat(F.lit("SHOP_"), (F.col("c_custkey") % 3).cast("string")).alias("database"))
    return ledger.missing_databases(tasks(spark, sf_dir), existing)


def ledger_append(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All tasks recorded by one run, the listed ones again by a later run, then read back."""
    path = fresh_dir(spark, "ledger")
    items = tasks(spark, sf_dir)
    first = F.lit("2024-02-01 00:00:00").cast("timestamp")
    second = F.lit("2024-02-02 00:00:00").cast("timestamp")
    ledger.append_finished(items.withColumn("finished_at", first), path)
    listed = ledger.finished(items, _entries(spark, sf_dir))
    ledger.append_finished(listed.withColumn("finished_at", second), path)
    latest = ledger.read_ledger(spark, path)
    left = ledger.pending_exact(items, latest).agg(F.count("*").alias("n")).select("n").scalar()
    state = latest.groupBy(F.col("finished_at").cast("timestamp_ntz").alias("finished_at")).agg(
        F.count("*").alias("items"), F.sum("size_bytes").alias("size_bytes")
    )
    return state.withColumn("pending", left)


LEDGER_SQL = oracle(
    "inv done",
    f"""SELECT CASE WHEN d THEN TIMESTAMP '2024-02-02 00:00:00' ELSE TIMESTAMP '2024-02-01 00:00:00' END AS finished_at,
  count(*) AS items, CAST(sum(size_bytes) AS BIGINT) AS size_bytes, CAST(0 AS BIGINT) AS pending
FROM (SELECT *, {IS_DONE} AS d FROM ({TASKS}) t) m GROUP BY 1""",
)

def ledger_versions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two writers at a time, a second record of each third item, a compaction: what each version holds."""
    path = fresh_dir(spark, "versions")
    items = tasks(spark, sf_dir)
    part = F.col("file_id") % 3
    day = lambda n: F.lit(f"2024-02-0{n} 00:00:00").cast("timestamp")
    waves = [items.where(part == i).withColumn("finished_at", day(1)) for i in range(2)]
    with ThreadPoolExecutor(2) as writers:
        first = max(writers.map(lambda wave: versions.append(wave, path), waves))
    again = versions.append(items.where(part != 0).withColumn("finished_at", day(2)), path)
    compacted = versions.compact(spark, path)
    seen = {"first": first, "again": again, "compacted": compacted}
    held = [versions.read(spark, path, v).withColumn("seen_at", F.lit(name)) for name, v in seen.items()]
    held.append(versions.changes(spark, path, first).withColumn("seen_at", F.lit("change")))
    rows = reduce(DataFrame.unionByName, held)
    return rows.select("seen_at", "database", "relative_path", "file_name", "size_bytes", F.col("finished_at").cast("timestamp_ntz").alias("finished_at"))


_SEEN = [
    ("first", "file_id % 3 < 2", "1"),
    ("again", "true", "CASE WHEN file_id % 3 = 0 THEN 1 ELSE 2 END"),
    ("compacted", "true", "CASE WHEN file_id % 3 = 0 THEN 1 ELSE 2 END"),
    ("change", "file_id % 3 <> 0", "2"),
]
VERSIONS_SQL = oracle(
    "inv",
    "\nUNION ALL\n".join(
        f"""SELECT '{name}' AS seen_at, database, path AS relative_path, file_name, size_bytes,
  CAST('2024-02-01' AS TIMESTAMP) + INTERVAL 1 DAY * ({day} - 1) AS finished_at FROM ({TASKS}) t WHERE {which}"""
        for name, which, day in _SEEN
    ),
)

QUERIES = {
    "manifest_load": manifest_load,
    "manifest_entries": manifest_entries,
    "manifest_discover": manifest_discover,
    "resume_pending": resume_pending,
    "resume_skipped": resume_skipped,
    "resume_mismatch_sample": resume_mismatch_sample,
    "database_breakdown": database_breakdown,
    "missing_databases": missing_databases,
    "ledger_append": ledger_append,
    "ledger_versions": ledger_versions,
}
ORACLES = {
    "manifest_load": LOAD_SQL,
    "manifest_entries": oracle("inv done", "SELECT DISTINCT entry FROM done"),
    "manifest_discover": DISCOVER_SQL,
    "resume_pending": oracle("inv done", f"SELECT path, database, size_bytes FROM ({TASKS}) t WHERE NOT {IS_DONE}"),
    "resume_skipped": oracle(
        "inv done",
        f"""SELECT count(*) FILTER (d) AS skipped_files, CAST(sum(size_bytes) FILTER (d) AS BIGINT) AS skipped_bytes,
  count(*) FILTER (NOT d) AS remaining_files, CAST(sum(size_bytes) FILTER (NOT d) AS BIGINT) AS remaining_bytes
FROM (SELECT *, {IS_DONE} AS d FROM ({TASKS}) t) m""",
    ),
    "resume_mismatch_sample": oracle(
        "inv done",
        f"""(SELECT 'entry' AS side, concat('other_', regexp_replace(entry, '^.*/', '')) AS name FROM done ORDER BY name LIMIT 3)
UNION ALL (SELECT 'file' AS side, file_name AS name FROM ({TASKS}) t ORDER BY size_bytes DESC, path LIMIT 3)""",
    ),
    "database_breakdown": oracle(
        "inv done",
        f"""SELECT database, count(*) FILTER (NOT d) AS files, CAST(sum(size_bytes) FILTER (NOT d) AS BIGINT) AS size_bytes,
  nullif(count(*) FILTER (d), 0) AS skipped FROM (SELECT *, {IS_DONE} AS d FROM ({TASKS}) t) m
GROUP BY database HAVING count(*) FILTER (NOT d) > 0""",
    ),
    "missing_databases": oracle(
        "inv",
        f"""SELECT DISTINCT database FROM ({TASKS}) t WHERE lower(database) NOT IN
  (SELECT lower(concat('SHOP_', c_custkey % 3)) FROM customer)""",
    ),
    "ledger_append": LEDGER_SQL,
    "ledger_versions": VERSIONS_SQL,
}
