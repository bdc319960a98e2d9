"""Inputs derived from the given tables, as one SQL text for both engines."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

from tablehaul.functions.names import base_name
from tablehaul.operators.sequence import in_chunks, running_total
from tablehaul.sources.inventory import HEADER_LINES

INV = """
SELECT o_orderkey AS file_id,
  concat('dumps/s', CAST(o_orderkey % 11 AS STRING), '/',
    CASE o_orderkey % 5
      WHEN 0 THEN concat('shop_', CAST(o_orderkey % 7 AS STRING), '__t', CAST(o_orderkey AS STRING), '.sql')
      WHEN 1 THEN concat('shop_', CAST(o_orderkey % 7 AS STRING), '.t', CAST(o_orderkey AS STRING), '.sql.gz')
      WHEN 2 THEN concat('t', CAST(o_orderkey AS STRING), '.sql')
      WHEN 3 THEN concat('T', CAST(o_orderkey AS STRING), '.SQL')
      ELSE concat('__t', CAST(o_orderkey AS STRING), '.sql.gz') END) AS path,
  CAST(round(o_totalprice * 100) AS BIGINT) AS size_bytes,
  CASE WHEN o_orderkey % 3 = 0 THEN concat('shop_', CAST(o_orderkey % 7 AS STRING)) END AS header_db
FROM orders
"""

# Needs inv.
DONE = """
SELECT CASE o_orderkey % 4
    WHEN 0 THEN regexp_replace(i.path, '^.*/', '')
    WHEN 1 THEN upper(regexp_replace(i.path, '^.*/', ''))
    WHEN 2 THEN concat('old/', regexp_replace(i.path, '^.*/', ''))
    ELSE upper(i.path) END AS entry, i.file_id
FROM inv i JOIN orders o ON i.file_id = o.o_orderkey WHERE o.o_orderstatus = 'F'
"""

# Only the first lines of a file matter, so the numbering stops there.
HDR = f"""
SELECT * FROM (
SELECT l_orderkey AS file_id,
  row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice, l_shipdate, l_quantity, l_discount, l_tax) AS line_no,
  CASE l_partkey % 8
    WHEN 0 THEN concat('-- Host: localhost    Database: shop_', CAST(l_suppkey % 7 AS STRING))
    WHEN 1 THEN concat('-- Current Database: `shop_', CAST(l_suppkey % 7 AS STRING), '`')
    WHEN 2 THEN concat('  use `shop_', CAST(l_suppkey % 7 AS STRING), '`;')
    WHEN 3 THEN concat('CREATE DATABASE /*!32312 IF NOT EXISTS*/ `shop_', CAST(l_suppkey % 7 AS STRING), '`;')
    WHEN 4 THEN 'CREATE TABLE `t` ('
    WHEN 5 THEN 'INSERT INTO `t` VALUES (1);'
    ELSE '-- comment' END AS line
FROM lineitem) h WHERE line_no <= {HEADER_LINES}
"""

RUNS = """
SELECT event_id, ts, user_id % 8 + 1 AS worker,
  CASE event_type WHEN 'purchase' THEN 'finished' WHEN 'error' THEN 'failed' ELSE 'started' END AS kind,
  concat('shop_', CAST(user_id % 7 AS STRING)) AS database,
  concat('t', CAST(event_id AS STRING), '.sql') AS file_name,
  concat('dumps/s', CAST(event_id % 11 AS STRING), '/t', CAST(event_id AS STRING), '.sql') AS file_path,
  CAST(round(value * 100000) AS BIGINT) AS size_bytes,
  CASE WHEN event_type = 'error' AND event_id % 3 <> 0 THEN CAST(event_id % 3 AS INT) END AS exit_code,
  CASE WHEN event_type = 'error' THEN CASE event_id % 4
    WHEN 0 THEN concat('warning: x', chr(10), 'ERROR 1064 (42000) at line 2')
    WHEN 1 THEN concat('access denied', chr(10), 'second line')
    WHEN 2 THEN '  ' ELSE 'Error: lock wait' END END AS message
FROM events
"""

READS = """
SELECT event_id, user_id AS worker, CAST(round(value * 20000) AS BIGINT) AS size_bytes,
  CAST(extract(DAY FROM ts) * 86400 + extract(HOUR FROM ts) * 3600 + extract(MINUTE FROM ts) * 60
    + CAST(floor(extract(SECOND FROM ts)) AS INT) AS DOUBLE) / CAST(100000 AS DOUBLE) AS t_s FROM events
"""

# For the oracle only; Spark builds the running total without a one-task window.
SAMPLES = f"""
SELECT event_id, worker, t_s,
  CAST(sum(size_bytes) OVER (PARTITION BY worker ORDER BY t_s, event_id) AS BIGINT) AS bytes_current
FROM ({READS}) e
"""

CAT = """
SELECT CASE p_partkey % 9 WHEN 0 THEN 'information_schema' WHEN 1 THEN 'mysql' WHEN 2 THEN 'sys' WHEN 3 THEN 'performance_schema'
    ELSE concat('shop_', CAST(p_partkey % 9 AS STRING)) END AS db,
  concat('t', CAST(p_partkey % 50 AS STRING)) AS table_name,
  CASE WHEN p_partkey % 10 = 0 THEN 'VIEW' ELSE 'BASE TABLE' END AS table_type,
  CASE WHEN p_partkey % 6 = 0 THEN NULL ELSE CAST(p_size * 1000 AS BIGINT) END AS data_length,
  CAST(p_partkey AS BIGINT) AS index_length,
  CASE WHEN p_partkey % 13 = 0 THEN NULL ELSE CAST(p_size AS BIGINT) END AS table_rows
FROM part
"""

TABLES = [
    "region", "nation", "customer", "supplier", "part", "orders", "lineitem",
    "events", "documents", "embeddings", "pages", "benchmark", "labels", "conversations",
]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _run(spark: SparkSession, sf_dir: str, text: str, **given: DataFrame) -> DataFrame:
    """Run a view's text with the tables it names bound to DataFrames."""
    frames = dict(given)

    def bind(match: re.Match) -> str:
        name = match.group(2)
        if name not in frames:
            frames[name] = table(spark, sf_dir, name)
        return f"{match.group(1)} {{{name}}}"

    names = "|".join([*TABLES, *given])
    return spark.sql(re.sub(rf"\b(FROM|JOIN) ({names})\b(?!\()", bind, text), **frames)


def inv(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The dump inventory with the columns a listing has."""
    items = _run(spark, sf_dir, INV)
    return items.withColumn("file_name", base_name(items["path"])).withColumn("relative_path", items["path"])


def done(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _run(spark, sf_dir, DONE, inv=_run(spark, sf_dir, INV))


def hdr(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _run(spark, sf_dir, HDR)


def runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _run(spark, sf_dir, RUNS)


def cat(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _run(spark, sf_dir, CAT)


def samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Byte samples, in chunks by worker and time."""
    reads = _run(spark, sf_dir, READS)
    chunked = in_chunks(reads, ["worker"], ["t_s", "event_id"])
    return running_total(chunked, ["worker"], "size_bytes", "bytes_current")


def oracle(views: str, select: str) -> str:
    """SQL with the named views in front, in the order given."""
    texts = {"inv": INV, "done": DONE, "hdr": HDR, "runs": RUNS, "samples": SAMPLES, "cat": CAT}
    return "WITH " + ",\n".join(f"{v} AS ({texts[v]})" for v in views.split()) + "\n" + select
