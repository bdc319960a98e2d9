"""Tables out to dump text and back."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tablehaul.operators.dump_writer import (
    NET_BUFFER_LENGTH,
    dump_name,
    dump_text,
    insert_statements,
    row_tuple,
    write_dump,
)
from tablehaul.operators.reconcile import reconcile
from tablehaul.operators.restore import restore
from tablehaul.plans.export import export_plan, export_report, run_export
from tablehaul.plans.imports import candidates, import_plan, run_import
from tablehaul.queries.views import TABLES, table
from tablehaul.session import fresh_dir
from tablehaul.sources.catalog import parquet_tables
from tablehaul.sources.ddl import mysql_type
from tablehaul.sources.dump_reader import read_dump, read_indexed_dump, read_schema
from tablehaul.sources.indexed_gzip import find_blocks

DATABASE = "shop"


def spread_out(df: DataFrame) -> DataFrame:
    """A plain scan with fewer tasks than cores is dealt out before heavy work.

    Only for a DataFrame that reads files and nothing more: asking for its
    partitions plans it but runs nothing.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df


def _written(spark: SparkSession, sf_dir: str, name: str, compress: bool, **options) -> str:
    path = f"{fresh_dir(spark, 'dump')}/{dump_name(name, DATABASE, compress)}"
    write_dump(spread_out(table(spark, sf_dir, name)), path, DATABASE, name, compress, **options)
    return path


def roundtrip(name: str, compress: bool):
    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        return read_dump(spark, _written(spark, sf_dir, name, compress))

    return query


def roundtrip_indexed_gz(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A gzip dump of few files, read by a task for each part of a megabyte."""
    path = f"{fresh_dir(spark, 'dump')}/{dump_name('lineitem', DATABASE, True)}"
    write_dump(table(spark, sf_dir, "lineitem"), path, DATABASE, "lineitem", block_bytes=1 << 20, buffer_bytes=1 << 18)
    return read_indexed_dump(spark, path, split_bytes=1 << 20)


def roundtrip_found_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same for files whose index is lost: their members are found first."""
    path = f"{fresh_dir(spark, 'dump')}/{dump_name('documents', DATABASE, True)}"
    write_dump(table(spark, sf_dir, "documents"), path, DATABASE, "documents", block_bytes=1 << 20)
    blocks = fresh_dir(spark, "blocks")
    find_blocks(spark, f"{path}/*.sql.gz").write.parquet(blocks)
    return read_indexed_dump(spark, path, blocks=spark.read.parquet(blocks), split_bytes=1 << 20)


def export_rows_only(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = _written(spark, sf_dir, "orders", False, structure=False)
    return read_dump(spark, path, table(spark, sf_dir, "orders").schema)


def restore_tables(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = _written(spark, sf_dir, "customer", True)
    target = fresh_dir(spark, "restored")
    restore(spark, path, target)
    return spark.read.parquet(target)


def nulls_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Values made null or empty by rule, and texts full of quotes and escapes."""
    source = _with_nulls(table(spark, sf_dir, "documents"))
    path = f"{fresh_dir(spark, 'dump')}/{dump_name('documents', DATABASE)}"
    write_dump(spread_out(source), path, DATABASE, "documents")
    return read_dump(spark, path)


def _with_nulls(documents: DataFrame) -> DataFrame:
    k = F.col("doc_id")
    return documents.select(
        "doc_id",
        F.when(k % 5 == 0, F.lit(None)).when(k % 5 == 1, "").when(k % 5 == 2, "NULL").otherwise(F.col("lang")).alias("lang"),
        F.concat(F.lit("a'b\\c\"),("), F.col("source"), F.lit("\t\r\n;--`"), F.col("text")).alias("text"),
        F.when(k % 3 != 0, F.col("n_chars")).alias("n_chars"),
    )


NULLS_SQL = """
SELECT doc_id, CASE doc_id % 5 WHEN 0 THEN NULL WHEN 1 THEN '' WHEN 2 THEN 'NULL' ELSE lang END AS lang,
  concat('a''b\\c"),(', source, chr(9), chr(13), chr(10), ';--`', text) AS text,
  CASE WHEN doc_id % 3 <> 0 THEN n_chars END AS n_chars FROM documents
"""


def _described(rows: bool):
    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        """Each table's columns as its dump's DDL tells them, and the rows of dump and table."""
        catalog = parquet_tables(spark, sf_dir, DATABASE)
        per_table = []
        for name in TABLES:
            path = _written(spark, sf_dir, name, False, rows=rows)
            parsed, schema = read_schema(spark, path)
            columns = F.array(
                *[
                    F.struct(
                        F.lit(i + 1).alias("ordinal"),
                        F.lit(f.name).alias("column_name"),
                        F.lit(mysql_type(f.dataType)).alias("column_type"),
                    )
                    for i, f in enumerate(schema.fields)
                ]
            )
            counted = read_dump(spark, path, schema).agg(F.count("*").alias("dump_rows"))
            per_table.append(counted.select(F.lit(parsed).alias("table_name"), "dump_rows", F.explode(columns).alias("c")))
        columns = reduce(DataFrame.unionAll, per_table).select("table_name", "c.*", "dump_rows")
        return columns.join(catalog.select("table_name", F.col("rows").alias("source_rows")), "table_name")

    return query


_COUNTS = "\nUNION ALL\n".join(f"SELECT '{t}' AS table_name, count(*) AS source_rows FROM {t}" for t in TABLES)
DESCRIBED_SQL = f"""
WITH counted AS ({_COUNTS})
SELECT c.table_name, CAST(c.ordinal_position AS INT) AS ordinal, c.column_name,
  CASE c.data_type WHEN 'INTEGER' THEN 'INT' WHEN 'VARCHAR' THEN 'LONGTEXT' WHEN 'TIMESTAMP' THEN 'DATETIME(6)'
    WHEN 'FLOAT[]' THEN 'JSON' ELSE c.data_type END AS column_type,
  @rows AS dump_rows, n.source_rows
FROM information_schema.columns c JOIN counted n ON c.table_name = n.table_name
"""


def dump_statements(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every row's literal text as it stands in the dump, with its key."""
    source = table(spark, sf_dir, "customer")
    text = dump_text(source, DATABASE, "customer")
    body = F.regexp_replace("value", r"^INSERT INTO `customer` VALUES ", "")
    inserts = text.where(F.startswith("value", F.lit("INSERT INTO `customer` VALUES ")))
    rows = inserts.select(F.explode(F.split(body, r"(?<=\)),(?=\()")).alias("row_text"))
    trimmed = F.regexp_replace("row_text", r";$", "")
    return rows.select(F.regexp_extract("row_text", r"^\((\d+),", 1).cast("bigint").alias("c_custkey"), trimmed.alias("row_text"))


def _number_sql(name: str) -> str:
    """A double's text as both engines print it at these magnitudes."""
    return f"CAST({name} AS VARCHAR)"


DUMP_SQL = f"""
SELECT c_custkey, concat('(', c_custkey, ',''', c_name, ''',', c_nationkey, ',', {_number_sql("c_acctbal")}, ',''', c_mktsegment, ''')') AS row_text
FROM customer
"""

INSERT_BUFFER = 64 * 1024


def insert_batches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Totals over the statements of a small buffer; how rows are split over them may vary."""
    source = table(spark, sf_dir, "orders")
    statements = insert_statements(source, "orders", INSERT_BUFFER)
    prefix = "INSERT INTO `orders` VALUES "
    body = F.substring("value", len(prefix) + 1, 2147483647)
    rows = F.size(F.split(body, r"\),\("))
    return statements.agg(
        F.sum(rows).cast("bigint").alias("row_count"),
        (F.sum(F.octet_length(body)) - F.sum(rows)).cast("bigint").alias("row_bytes"),
        F.count_if(F.octet_length("value") > INSERT_BUFFER).alias("oversize"),
        F.count_if(~F.startswith("value", F.lit(prefix)) | ~F.endswith("value", F.lit(");"))).alias("malformed"),
    )


INSERT_SQL = """
SELECT count(*) AS row_count,
  CAST(sum(strlen(concat('(', o_orderkey, ',', o_custkey, ',''', o_orderstatus, ''',', CAST(o_totalprice AS VARCHAR), ',''',
    strftime(o_orderdate, '%Y-%m-%d %H:%M:%S'), ''',''', o_orderpriority, ''')'))) AS BIGINT) AS row_bytes,
  CAST(0 AS BIGINT) AS oversize, CAST(0 AS BIGINT) AS malformed
FROM orders
"""


def roundtrip_reconcile(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every table written, restored and compared."""
    found = []
    for i, name in enumerate(TABLES):
        source = table(spark, sf_dir, name)
        path = _written(spark, sf_dir, name, compress=i % 2 == 1)
        found.append(reconcile(source, read_dump(spark, path)).select(F.lit(name).alias("table_name"), "*"))
    return reduce(DataFrame.unionAll, found)


RECONCILE_SQL = "\nUNION ALL\n".join(
    f"SELECT '{t}' AS table_name, count(*) AS source_rows, count(*) AS restored_rows, "
    f"CAST(0 AS BIGINT) AS missing_rows, CAST(0 AS BIGINT) AS extra_rows FROM {t}"
    for t in TABLES
)


def migration(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A whole move: plan and write an export, list it, import it, count both sides."""
    dumps, target, ledger = (fresh_dir(spark, label) for label in ("export", "import", "ledger"))
    catalog = parquet_tables(spark, sf_dir, DATABASE)
    plan = export_plan(catalog, dumps, compress=True, databases=DATABASE)
    wrote = run_export(spark, plan, lambda _, name: spread_out(table(spark, sf_dir, name)), compress=True)
    restored = run_import(spark, import_plan(candidates(spark, dumps)), target, ledger)
    failed = wrote.unionAll(restored).where(F.col("kind") == "failed")
    counted = parquet_tables(spark, f"{target}/{DATABASE}", DATABASE)
    both = catalog.select("table_name", F.col("rows").alias("source_rows")).join(
        counted.select("table_name", F.col("rows").alias("restored_rows")), "table_name", "left"
    )
    return both.withColumn("failed_items", F.lit(failed.count()))


MIGRATION_SQL = "\nUNION ALL\n".join(
    f"SELECT '{t}' AS table_name, count(*) AS source_rows, count(*) AS restored_rows, CAST(0 AS BIGINT) AS failed_items FROM {t}"
    for t in TABLES
)

def export_written(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An export of all tables: rows and bytes counted while writing, beside the estimates and what the files hold."""
    dumps = fresh_dir(spark, "report")
    plan = export_plan(parquet_tables(spark, sf_dir, DATABASE), dumps, compress=True, databases=DATABASE)
    events = run_export(spark, plan, lambda _, name: table(spark, sf_dir, name), compress=True)
    report = export_report(plan, events)
    folder = F.regexp_extract(F.col("_metadata.file_path"), r"/([^/]+)/[^/]+$", 1)
    lines = spark.read.option("recursiveFileLookup", "true").text(dumps).select(folder.alias("folder"), (F.octet_length("value") + 1).alias("n"))
    held = lines.groupBy("folder").agg(F.sum("n").alias("held_bytes"))
    both = report.withColumn("folder", F.substring_index("output_path", "/", -1)).join(held, "folder", "left")
    same = F.col("written_bytes").eqNullSafe(F.col("held_bytes"))
    return both.select("table_name", "state", "estimated_rows", "written_rows", same.alias("bytes_as_held"))


WRITTEN_SQL = "\nUNION ALL\n".join(
    f"SELECT '{t}' AS table_name, 'finished' AS state, count(*) AS estimated_rows, count(*) AS written_rows, true AS bytes_as_held FROM {t}"
    for t in TABLES
)

QUERIES = {f"roundtrip_{t}": roundtrip(t, False) for t in TABLES}
QUERIES |= {f"roundtrip_{t}_gz": roundtrip(t, True) for t in TABLES}
QUERIES |= {
    "roundtrip_nulls": nulls_roundtrip,
    "roundtrip_indexed_gz": roundtrip_indexed_gz,
    "roundtrip_found_blocks": roundtrip_found_blocks,
    "export_rows_only": export_rows_only,
    "export_structure_only": _described(rows=False),
    "ddl_catalog": _described(rows=True),
    "restore_tables": restore_tables,
    "dump_statements": dump_statements,
    "insert_batches": insert_batches,
    "roundtrip_reconcile": roundtrip_reconcile,
    "migration": migration,
    "export_report": export_written,
}
ORACLES = {f"roundtrip_{t}{end}": f"SELECT * FROM {t}" for t in TABLES for end in ("", "_gz")}
ORACLES |= {
    "roundtrip_nulls": NULLS_SQL,
    "roundtrip_indexed_gz": "SELECT * FROM lineitem",
    "roundtrip_found_blocks": "SELECT * FROM documents",
    "export_rows_only": "SELECT * FROM orders",
    "export_structure_only": DESCRIBED_SQL.replace("@rows", "CAST(0 AS BIGINT)"),
    "ddl_catalog": DESCRIBED_SQL.replace("@rows", "n.source_rows"),
    "restore_tables": "SELECT * FROM customer",
    "dump_statements": DUMP_SQL,
    "insert_batches": INSERT_SQL,
    "roundtrip_reconcile": RECONCILE_SQL,
    "migration": MIGRATION_SQL,
    "export_report": WRITTEN_SQL,
}
