"""Dump inventories, catalogs and export plans."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tablehaul.functions.names import DUMP_FILE, base_name, guess_database, size_mb
from tablehaul.functions.text import format_bytes, format_bytes_compact, format_mb
from tablehaul.operators.targets import (
    NO_DATABASE,
    NO_METADATA,
    classify,
    database_summary,
    detect_database,
    largest_first,
    name_contains,
    resolve_database,
    totals,
)
from tablehaul.plans.export import export_plan
from tablehaul.queries import views
from tablehaul.queries.views import oracle, table
from tablehaul.sources.catalog import normalise, parquet_tables
from tablehaul.sources.inventory import resolve_retry, retry_lines

# The name part of a path, and the database guess, in the oracle's SQL.
NAME = "regexp_replace(path, '^.*/', '')"
STEM = f"regexp_replace({NAME}, '(?i)\\.gz$', '')"
GUESS = f"""CASE WHEN strpos({STEM}, '__') > 1 THEN split_part({STEM}, '__', 1)
  WHEN length({STEM}) - length(replace({STEM}, '.', '')) > 1 AND strpos({STEM}, '.') > 1 THEN split_part({STEM}, '.', 1) END"""
TASKS = f"""
SELECT file_id, path, {NAME} AS file_name, size_bytes, coalesce(header_db, {GUESS}) AS database
FROM inv WHERE coalesce(header_db, {GUESS}) IS NOT NULL
"""


def tasks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return classify(views.inv(spark, sf_dir)).where(F.col("status") == "task")


def scan_inventory(spark: SparkSession, sf_dir: str) -> DataFrame:
    inv = views.inv(spark, sf_dir)
    listed = inv.where(F.col("path").rlike(DUMP_FILE) & (F.size(F.split("path", "/")) <= 3))
    return listed.select("path", "file_name", "size_bytes", size_mb(F.col("size_bytes")).alias("size_mb")).orderBy("path")


def filter_substring(spark: SparkSession, sf_dir: str) -> DataFrame:
    inv = views.inv(spark, sf_dir)
    return inv.where(name_contains(F.col("file_name"), "T12")).select("path", "file_name")


def guess(spark: SparkSession, sf_dir: str) -> DataFrame:
    inv = views.inv(spark, sf_dir)
    return inv.select("path", guess_database(F.col("file_name")).alias("database"))


def resolve_targets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The four ways a target is found: header or guess, with a default, forced."""
    inv, name, header = views.inv(spark, sf_dir), F.col("file_name"), F.col("header_db")
    return inv.select(
        "path",
        resolve_database(name, header).alias("resolved"),
        resolve_database(name, header, default="fallback").alias("with_default"),
        resolve_database(name, header, forced="target").alias("with_forced"),
    )


def classify_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    inv = views.inv(spark, sf_dir).withColumn(
        "size_bytes", F.when(F.col("file_id") % 17 != 0, F.col("size_bytes"))
    )
    return classify(inv, name_filter="1").select("path", "database", "status", "reason")


CLASSIFY_SQL = oracle(
    "inv",
    f"""SELECT path, CASE WHEN status = 'task' THEN db END AS database, status,
  CASE WHEN status = 'skipped' THEN CASE WHEN file_id % 17 = 0 THEN '{NO_METADATA}' ELSE '{NO_DATABASE}' END END AS reason
FROM (SELECT *, coalesce(header_db, {GUESS}) AS db,
  CASE WHEN {NAME} NOT LIKE '%1%' THEN 'filtered'
    WHEN file_id % 17 = 0 OR coalesce(header_db, {GUESS}) IS NULL THEN 'skipped' ELSE 'task' END AS status FROM inv) c""",
)


def detect(spark: SparkSession, sf_dir: str) -> DataFrame:
    return detect_database(views.hdr(spark, sf_dir), "file_id")


DETECT_SQL = oracle(
    "hdr",
    r"""SELECT file_id, db AS header_db FROM (
  SELECT file_id, db, row_number() OVER (PARTITION BY file_id ORDER BY line_no) AS k FROM (
    SELECT file_id, line_no, CASE WHEN stops THEN NULL ELSE coalesce(
        nullif(regexp_extract(t, '(?i)(?:current\s+)?database:\s*[`''"]?([^\s`''";]+)[`''"]?', 1), ''),
        nullif(regexp_extract(t, '(?i)^\s*USE\s+[`''"]?([^\s`''";]+)[`''"]?\s*;?', 1), ''),
        nullif(regexp_extract(t, '(?i)^\s*CREATE\s+DATABASE(?:\s+/\*!.*?\*/)?(?:\s+IF\s+NOT\s+EXISTS)?\s+[`''"]?([^\s`''";]+)[`''"]?', 1), '')) END AS db,
      stops
    FROM (SELECT file_id, line_no, trim(line) AS t,
        starts_with(trim(line), 'CREATE TABLE') OR starts_with(trim(line), 'INSERT INTO') OR starts_with(trim(line), 'LOCK TABLES') AS stops
      FROM hdr) a) b WHERE stops OR db IS NOT NULL) c
WHERE k = 1 AND db IS NOT NULL""",
)


def retry_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines as given, relative to the folder, blank, commented, repeated or unknown."""
    inv = views.inv(spark, sf_dir)
    orders = table(spark, sf_dir, "orders").where(F.col("o_orderstatus") == "O").select("o_orderkey", "o_custkey")
    k = F.col("o_orderkey")
    relative = F.regexp_replace("path", "^dumps/", "")
    line = (
        F.when(k % 7 == 0, "")
        .when(k % 7 == 1, F.concat(F.lit("# "), "path"))
        .when(k % 7 == 2, F.concat(F.lit("  "), "path", F.lit(" ")))
        .when(k % 7 == 3, relative)
        .when(k % 7 == 4, F.concat(F.lit("gone/"), "path"))
        .otherwise(F.col("path"))
    )
    lines = orders.join(inv.select("file_id", "path"), k == F.col("file_id")).select(k.alias("line_no"), line.alias("value"))
    found = resolve_retry(retry_lines(lines), inv, F.lit("dumps"))
    return found.select("line_no", "path", base_name(F.col("path")).alias("file_name"))


RETRY_SQL = oracle(
    "inv",
    f"""SELECT o_orderkey AS line_no, path, {NAME} AS file_name FROM orders JOIN inv ON o_orderkey = file_id
WHERE o_orderstatus = 'O' AND o_orderkey % 7 IN (2, 3, 5, 6)""",
)


def summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return database_summary(tasks(spark, sf_dir))


def inventory_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return totals(tasks(spark, sf_dir))


def ordered(spark: SparkSession, sf_dir: str) -> DataFrame:
    return largest_first(tasks(spark, sf_dir)).select("path", "database", "size_bytes", "size_mb")


def inventory_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    size = F.col("size_bytes")
    return database_summary(tasks(spark, sf_dir)).select(
        "database", "files", format_bytes(size).alias("volume"), format_mb(size).alias("mb")
    )


def scaled_sql(count: str, unit: int, digits: int) -> str:
    """Whole-number rounding, half to even, as in the Spark function."""
    step = 10**digits
    rest = f"(({count}) % {unit}) * {step}"
    return (
        f"((({count}) // {unit}) * {step} + ({rest}) // {unit} + CASE WHEN (({rest}) % {unit}) * 2 > {unit} "
        f"OR ((({rest}) % {unit}) * 2 = {unit} AND (({rest}) // {unit}) % 2 = 1) THEN 1 ELSE 0 END)"
    )


def fixed_sql(steps: str, digits: int, commas: bool = False) -> str:
    whole = f"(({steps}) // {10**digits})"
    head = f"format('{{:,}}', {whole})" if commas else f"CAST({whole} AS VARCHAR)"
    return f"concat({head}, '.', lpad(CAST(({steps}) % {10**digits} AS VARCHAR), {digits}, '0'))"


def bytes_sql(count: str, compact: bool = False) -> str:
    kb, mb, gb = 1024, 1024**2, 1024**3
    k = 1 if compact else 2
    top = f"concat({fixed_sql(scaled_sql(count, gb, 2), 2)}, ' GB'"
    top += ")" if compact else f", ' (', {fixed_sql(scaled_sql(count, mb, 2), 2, True)}, ' MB)')"
    return (
        f"CASE WHEN {count} < {kb} THEN concat({count}, ' B') "
        f"WHEN {count} < {mb} THEN concat({fixed_sql(scaled_sql(count, kb, k), k)}, ' KB') "
        f"WHEN {count} < {gb} THEN concat({fixed_sql(scaled_sql(count, mb, 2), 2)}, ' MB') ELSE {top} END"
    )


REPORT_SQL = oracle(
    "inv",
    f"""SELECT database, files, {bytes_sql("b")} AS volume, {fixed_sql(scaled_sql("b", 1024**2, 2), 2, True)} AS mb
FROM (SELECT database, count(*) AS files, CAST(sum(size_bytes) AS BIGINT) AS b FROM ({TASKS}) t GROUP BY database) s""",
)


def size_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Both byte formats over every size, spread from bytes to gigabytes."""
    inv = views.inv(spark, sf_dir)
    size = F.when(F.col("file_id") % 4 == 0, F.col("size_bytes") % 1500).when(
        F.col("file_id") % 4 == 1, F.col("size_bytes") % 1200000
    ).when(F.col("file_id") % 4 == 2, F.col("size_bytes")).otherwise(F.col("size_bytes") * 128)
    sized = inv.select("file_id", size.alias("n"))
    return sized.select(
        "file_id", "n", format_bytes(F.col("n")).alias("long_text"), format_bytes_compact(F.col("n")).alias("short_text")
    )


SIZE_SQL = oracle(
    "inv",
    f"""SELECT file_id, n, {bytes_sql("n")} AS long_text, {bytes_sql("n", True)} AS short_text FROM (
SELECT file_id, CASE file_id % 4 WHEN 0 THEN size_bytes % 1500 WHEN 1 THEN size_bytes % 1200000 WHEN 2 THEN size_bytes
  ELSE size_bytes * 128 END AS n FROM inv) s""",
)


def catalog_discovery(spark: SparkSession, sf_dir: str) -> DataFrame:
    return normalise(views.cat(spark, sf_dir))


CATALOG = """
SELECT db, table_name, coalesce(data_length + index_length, 0) AS bytes, coalesce(table_rows, 0) AS rows
FROM cat WHERE table_type = 'BASE TABLE'
"""


def catalog_tables(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Row counts of the given tables themselves, from Parquet footers."""
    return parquet_tables(spark, sf_dir, "shop").select("db", "table_name", "rows")


CATALOG_TABLES_SQL = "\nUNION ALL\n".join(
    f"SELECT 'shop' AS db, '{t}' AS table_name, count(*) AS rows FROM {t}" for t in views.TABLES
)


def _plan(**choice):
    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        return export_plan(catalog_discovery(spark, sf_dir), "out", **choice)

    return query


def _plan_sql(where: str, name: str) -> str:
    return oracle(
        "cat",
        f"""SELECT db AS database, table_name, bytes AS estimated_bytes, rows AS estimated_rows, {name} AS file_name,
  concat('out/', {name}) AS output_path FROM ({CATALOG}) c WHERE {where}""",
    )


QUERIES = {
    "scan_inventory": scan_inventory,
    "filter_substring": filter_substring,
    "guess_database": guess,
    "resolve_database": resolve_targets,
    "classify_candidates": classify_candidates,
    "detect_database": detect,
    "retry_list": retry_list,
    "database_summary": summary,
    "inventory_totals": inventory_totals,
    "largest_first": ordered,
    "inventory_report": inventory_report,
    "size_texts": size_texts,
    "catalog_discovery": catalog_discovery,
    "catalog_tables": catalog_tables,
    "export_plan": _plan(all_databases=True, compress=True, exclude_tables="t1, t2,t3"),
    "export_plan_single": _plan(database="shop_5", tables="t5, t14 ,t23,"),
    "export_plan_several": _plan(databases="shop_4, shop_7", tables="t4,t7,t11,t13", exclude_tables="t13"),
}
ORACLES = {
    "scan_inventory": oracle("inv", f"SELECT path, {NAME} AS file_name, size_bytes, size_bytes / CAST(1048576.0 AS DOUBLE) AS size_mb FROM inv"),
    "filter_substring": oracle("inv", f"SELECT path, {NAME} AS file_name FROM inv WHERE lower({NAME}) LIKE '%t12%'"),
    "guess_database": oracle("inv", f"SELECT path, {GUESS} AS database FROM inv"),
    "resolve_database": oracle(
        "inv",
        f"""SELECT path, coalesce(header_db, {GUESS}) AS resolved, coalesce(header_db, 'fallback') AS with_default,
  'target' AS with_forced FROM inv""",
    ),
    "classify_candidates": CLASSIFY_SQL,
    "detect_database": DETECT_SQL,
    "retry_list": RETRY_SQL,
    "database_summary": oracle("inv", f"SELECT database, count(*) AS files, CAST(sum(size_bytes) AS BIGINT) AS size_bytes FROM ({TASKS}) t GROUP BY database"),
    "inventory_totals": oracle("inv", f"SELECT count(*) AS files, CAST(sum(size_bytes) AS BIGINT) AS size_bytes FROM ({TASKS}) t"),
    "largest_first": oracle("inv", f"SELECT path, database, size_bytes, size_bytes / CAST(1048576.0 AS DOUBLE) AS size_mb FROM ({TASKS}) t"),
    "inventory_report": REPORT_SQL,
    "size_texts": SIZE_SQL,
    "catalog_discovery": oracle("cat", CATALOG),
    "catalog_tables": CATALOG_TABLES_SQL,
    "export_plan": _plan_sql(
        "db NOT IN ('information_schema', 'performance_schema', 'mysql', 'sys') AND table_name NOT IN ('t1', 't2', 't3')",
        "concat(db, '__', table_name, '.sql.gz')",
    ),
    "export_plan_single": _plan_sql("db = 'shop_5' AND table_name IN ('t5', 't14', 't23')", "concat(table_name, '.sql')"),
    "export_plan_several": _plan_sql(
        "db IN ('shop_4', 'shop_7') AND table_name IN ('t4', 't7', 't11')", "concat(db, '__', table_name, '.sql')"
    ),
}
