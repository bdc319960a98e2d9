"""Dumps that mix tables, databases and forms of statements, restored in one scan."""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tablehaul.operators.dump_writer import OUT_BYTES, dump_name, packing, row_tuple, write_dump
from tablehaul.operators.restore_whole import (
    PROBLEM_DROPPED,
    PROBLEM_STATEMENT,
    PROBLEM_TABLE,
    PROBLEM_TUPLES,
    restore_whole,
    stage_whole,
)
from tablehaul.queries.views import TABLES, table
from tablehaul.session import NO_SHUFFLE_KEPT, fresh_dir, holding
from tablehaul.sources.ddl import create_table
from tablehaul.sources.dump_source import DumpSource

#: Files of a dump made here, at least, and the text in one of them: more rows make more files, not longer ones.
FILES = 6
FILE_BYTES = 64 << 20
BUFFER_BYTES = 1 << 16


def _cents(name: str) -> str:
    return f"CAST(floor({name} * 100 + 0.5) AS BIGINT)"


#: Columns of each table as whole numbers, in SQL that both engines read alike; all are added up with different weights.
NUMBERS = {
    "region": ["r_regionkey", "length(r_name)"],
    "nation": ["n_nationkey", "length(n_name)", "n_regionkey"],
    "customer": ["c_custkey", "length(c_name)", "c_nationkey", _cents("c_acctbal"), "length(c_mktsegment)"],
    "supplier": ["s_suppkey", "length(s_name)", "s_nationkey", _cents("s_acctbal")],
    "part": ["p_partkey", "length(p_name)", "length(p_brand)", "length(p_type)", "p_size", _cents("p_retailprice")],
    "orders": ["o_orderkey", "o_custkey", "ascii(o_orderstatus)", _cents("o_totalprice"), "year(o_orderdate)", "month(o_orderdate)", "length(o_orderpriority)"],
    "lineitem": [
        "l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", _cents("l_quantity"), _cents("l_extendedprice"), _cents("l_discount"),
        _cents("l_tax"), "ascii(l_returnflag)", "ascii(l_linestatus)", "year(l_shipdate)", "day(l_shipdate)",
    ],
    "events": ["event_id", "user_id", "hour(ts)", "minute(ts)", "length(event_type)", _cents("value"), "length(props)"],
    "documents": ["doc_id", "length(text)", "length(lang)", "length(source)", "n_chars", "ascii(text)"],
    "embeddings": ["vec_id", "label", "CAST(floor(CAST(embedding[@0] AS DOUBLE) * 1000000) AS BIGINT)", "CAST(floor(CAST(embedding[@7] AS DOUBLE) * 1000000) AS BIGINT)"],
    "pages": ["page_id", "length(url)", "length(html)"],
    "benchmark": ["item_id", "length(text)"],
    "labels": ["doc_id", "quality", "toxic"],
    "conversations": ["conv_id", "turn", "length(role)", "length(text)", "ascii(text)"],
}
#: A second database has a table of the same name as one of the first, with other columns.
SECOND = ("archive", "customer", "region")


def _checked(database: str, name: str, numbers: list[str], first_index: int) -> str:
    total = " + ".join(f"{2 * i + 1} * coalesce({n}, 0)" for i, n in enumerate(numbers))
    for at in (0, 7):
        total = total.replace(f"[@{at}]", f"[{at + first_index}]")
    return f"SELECT '{database}' AS database_name, '{name}' AS table_name, count(*) AS n_rows, CAST(sum({total}) AS BIGINT) AS checksum"


def _file_count(text_bytes: int | None, least: int) -> int:
    return max(least, -(-(text_bytes or 0) // FILE_BYTES))


def _dealt(rows: DataFrame, files: int) -> DataFrame:
    """Rows, each with the ``file`` it goes to. They are dealt out by their place and not by their text, so copies spread too."""
    file = F.pmod(F.xxhash64("place"), F.lit(files)).cast("int")
    return rows.withColumn("place", F.monotonically_increasing_id()).select(*rows.columns, file.alias("file"))


def _packed(run):
    """Batch function whose statements leave compressed: on their way to their file they take about a third of their text."""

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = pa.Codec("zstd")
        for batch in run(batches):
            texts = [v.as_buffer() for v in batch.column(0).cast(pa.binary())]
            packed = pa.array([codec.compress(t, asbytes=True) for t in texts], pa.binary())
            yield pa.RecordBatch.from_arrays([packed, pa.array([t.size for t in texts], pa.int32())], names=["packed", "size"])

    return pack


def _unpacked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Text that is there as such, or else as ``_packed`` left it; about a megabyte leaves at a time."""
    codec = pa.Codec("zstd")
    for batch in batches:
        out: list[str] = []
        held = 0
        for value, packed, size in zip(*batch.columns):
            out.append(value.as_py() if value.is_valid else codec.decompress(packed.as_buffer(), size.as_py(), asbytes=True).decode())
            held += len(out[-1])
            if held >= OUT_BYTES:
                yield pa.RecordBatch.from_arrays([pa.array(out, pa.string())], ["value"])
                out, held = [], 0
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(out, pa.string())], ["value"])


def _each(spark: SparkSession, files: int, step: int, values: list[str]) -> DataFrame:
    """A line of every section for each of the first ``files``."""
    lines = F.array(*(F.struct(F.lit(i).alias("section"), F.lit(v).alias("value")) for i, v in enumerate(values)))
    return spark.range(0, files, 1, 1).select(F.col("id").cast("int").alias("file"), F.lit(step).alias("step"), F.inline(lines))


def _mixed(spark: SparkSession, sf_dir: str) -> str:
    """A folder of files, each with a section of statements for every table, under ``USE``; every second one is compressed.

    The plain files and the compressed ones are written one after the other, each from its half of every table's rows. Rows
    are rendered twice, once to count their bytes; no copy of the text is kept beside the files.
    """
    sections = [("shop", name, name) for name in TABLES] + [SECOND]
    tables = [table(spark, sf_dir, source) for _, _, source in sections]
    halves = [F.pmod(F.xxhash64(*map(F.col, df.columns)), F.lit(2)) for df in tables]
    lengths = [df.select(half.alias("half"), (F.octet_length(row_tuple(df)) + 1).cast("bigint").alias("bytes")) for df, half in zip(tables, halves)]
    counted = {r.half: r.bytes for r in reduce(DataFrame.unionByName, lengths).groupBy("half").agg(F.sum("bytes").alias("bytes")).collect()}
    path = fresh_dir(spark, "mixed")
    for place, (form, options) in enumerate((("plain", {}), ("packed", {"compression": "gzip"}))):
        files = _file_count(counted.get(place), FILES // 2)
        written = []
        for i, ((_, name, _), df, half) in enumerate(zip(sections, tables, halves)):
            tuples, run = packing(df.where(half == place), name, BUFFER_BYTES)
            written.append(tuples.mapInArrow(_packed(run), "packed binary, size int").withColumn("section", F.lit(i)))
        heads = _each(spark, files, 0, [f"-- section {i}\nUSE `{database}`;" for i, (database, _, _) in enumerate(sections)])
        ddl = _each(spark, 1 - place, 1, [create_table(name, df.schema) for (_, name, _), df in zip(sections, tables)])
        parts = [heads, ddl, _dealt(reduce(DataFrame.unionByName, written), files).withColumn("step", F.lit(2))]
        pieces = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)
        pieces = pieces.repartitionById(files, "file").sortWithinPartitions("section", "step")
        with holding(spark, NO_SHUFFLE_KEPT):
            pieces.select("value", "packed", "size").mapInArrow(_unpacked, "value string").write.options(**options).text(f"{path}/{form}")
    return path


def restore_mixed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All tables, and one of a second database, out of mixed files: rows and a checksum over all columns of each."""
    whole = restore_whole(spark, _mixed(spark, sf_dir))
    out = []
    for database, name in sorted(whole.tables):
        numbers = NUMBERS[SECOND[2] if database == SECOND[0] else name]
        out.append(spark.sql(_checked(database, name, numbers, 0) + " FROM {rows}", rows=whole.read(database, name)))
    return reduce(DataFrame.unionByName, out)


MIXED_SQL = "\nUNION ALL\n".join(
    f"{_checked(database, name, NUMBERS[source], 1)} FROM {source}" for database, name, source in [("shop", n, n) for n in TABLES] + [SECOND]
)


def _in_files(spark: SparkSession, rows: DataFrame, first: str, label: str) -> str:
    """``value`` in files that each begin with ``first``, which the first file follows up with ``ddl``."""
    files = _file_count(rows.agg(F.sum(F.octet_length("value").cast("bigint"))).first()[0], FILES)
    heads = spark.range(0, files, 1, 1).select(F.lit(first).alias("value"), F.col("id").cast("int").alias("file"), F.lit(0).alias("step"))
    path = fresh_dir(spark, label)
    text = heads.unionByName(_dealt(rows, files).withColumn("step", F.lit(1)))
    with holding(spark, NO_SHUFFLE_KEPT):
        text.repartitionById(files, "file").sortWithinPartitions("step").select("value").write.text(path)
    return path


def _raw_lines(row: Column) -> Column:
    """Escaped line feeds as real ones."""
    return F.regexp_replace(row, r"(?<!\\)((?:\\\\)*)\\n", "$1\n")


def restore_foreign_forms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents through statements as other programs write them: over several lines, inside executable comments, under
    another delimiter, with comments between, with columns in another order, in another database."""
    documents = table(spark, sf_dir, "documents")
    turned = documents.select(*reversed(documents.columns))
    names = F.lit(", ".join(f"`{c}`" for c in turned.columns))
    into = F.lit("INSERT INTO `documents` ")
    forms = {
        0: F.concat(F.lit("INSERT INTO /* (0,'none') */\n  `documents`\nVALUES -- ;\n"), _raw_lines(F.col("plain")), F.lit("\n;")),
        1: F.concat(F.lit("/*!50003 "), into, F.lit("VALUES "), F.col("plain"), F.lit(" */;")),
        2: F.concat(F.lit("DELIMITER $$\n"), into, F.lit("VALUES "), F.col("plain"), F.lit("$$ # done\nDELIMITER ;")),
        3: F.concat(into, F.lit("("), names, F.lit(")\nVALUES\n\t"), F.col("turned"), F.lit(";\n/* INSERT INTO `documents` VALUES (0); */")),
        4: F.concat(F.lit("REPLACE INTO `far`.`documents` VALUE "), _raw_lines(F.col("plain")), F.lit(" ; SET @n = 1; COMMIT;")),
    }
    rows = documents.select("doc_id", row_tuple(documents).alias("plain"), row_tuple(turned).alias("turned"))
    value = reduce(lambda c, k: F.when(F.col("doc_id") % 5 == k, forms[k]).otherwise(c), forms, F.lit(None).cast("string"))
    made = "\n".join(f"CREATE DATABASE IF NOT EXISTS `{d}`;\nUSE `{d}`;\nCREATE TABLE IF NOT EXISTS" + create_table("documents", documents.schema).split("CREATE TABLE", 1)[1] for d in ("far", "near"))
    whole = restore_whole(spark, _in_files(spark, rows.select(value.alias("value")), made, "foreign"))
    return reduce(DataFrame.unionByName, [whole.read(d, "documents").withColumn("database_name", F.lit(d)) for d in ("far", "near")])


FOREIGN_SQL = "SELECT *, CASE WHEN doc_id % 5 = 4 THEN 'far' ELSE 'near' END AS database_name FROM documents"


def dump_problems(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What is wrong with a dump in which orders came out sound, changed, cut, without a table, or with a table dropped."""
    key = F.col("o_orderkey").cast("string")
    forms = [
        F.concat(F.lit("INSERT INTO `sound` VALUES ("), key, F.lit(",';');")),
        F.concat(F.lit("BEGIN; UPDATE `sound` SET `id` = "), key, F.lit("; COMMIT;")),
        F.concat(F.lit("INSERT INTO `sound` VALUES ("), key, F.lit(",'a'), x;")),
        F.concat(F.lit("INSERT INTO `unknown` VALUES ("), key, F.lit(");")),
        F.concat(F.lit("ALTER TABLE `sound` ADD COLUMN `c"), key, F.lit("` INT;")),
        F.concat(F.lit("INSERT INTO `gone"), (F.col("o_orderkey") % 7).cast("string"), F.lit("` VALUES ("), key, F.lit(");\nDROP TABLE `gone"), (F.col("o_orderkey") % 7).cast("string"), F.lit("`;")),
    ]
    value = reduce(lambda c, k: F.when(F.col("o_orderkey") % len(forms) == k, forms[k]).otherwise(c), range(1, len(forms)), forms[0])
    first = "USE `shop`;\nCREATE TABLE `sound` (`id` BIGINT, `t` TEXT);\n" + "\n".join(f"CREATE TABLE `gone{i}` (`id` BIGINT);" for i in range(7))
    rows = table(spark, sf_dir, "orders").select(value.alias("value"))
    whole = stage_whole(spark, _in_files(spark, rows, first, "problems"))
    return whole.problems().groupBy("problem").agg(F.count("*").alias("n"), F.count("file").alias("with_file"))


PROBLEMS_SQL = f"""
SELECT problem, n, CASE WHEN kind < 3 THEN n ELSE 0 END AS with_file FROM (
  SELECT 1 AS kind, '{PROBLEM_STATEMENT}' AS problem, count(*) AS n FROM orders WHERE o_orderkey % 6 IN (1, 4)
  UNION ALL SELECT 2, '{PROBLEM_TUPLES}', count(*) FROM orders WHERE o_orderkey % 6 = 2
  UNION ALL SELECT 3, '{PROBLEM_TABLE}', count(DISTINCT 1) FROM orders WHERE o_orderkey % 6 = 3
  UNION ALL SELECT 4, '{PROBLEM_DROPPED}', count(DISTINCT o_orderkey % 7) FROM orders WHERE o_orderkey % 6 = 5
) WHERE n > 0
"""

def dump_source(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Chosen columns of one of two tables in a folder of dumps, plain and indexed gzip, through the data source."""
    folder = fresh_dir(spark, "source")
    for name, options in (("lineitem", {"block_bytes": 1 << 20}), ("orders", {})):
        path = f"{folder}/{dump_name(name, 'shop', bool(options))}"
        write_dump(table(spark, sf_dir, name), path, "shop", name, buffer_bytes=1 << 18, **options)
    spark.dataSource.register(DumpSource)
    schema = table(spark, sf_dir, "lineitem").select(*SOURCE_COLUMNS).schema
    return spark.read.format("sqldump").schema(schema).option("table", "lineitem").option("splitBytes", 1 << 20).load(folder)


SOURCE_COLUMNS = ["l_shipdate", "l_orderkey", "l_linenumber", "l_extendedprice", "l_returnflag"]
SOURCE_SQL = f"SELECT {', '.join(SOURCE_COLUMNS)} FROM lineitem"

QUERIES = {
    "restore_mixed": restore_mixed,
    "restore_foreign_forms": restore_foreign_forms,
    "dump_problems": dump_problems,
    "dump_source": dump_source,
}
ORACLES = {
    "restore_mixed": MIXED_SQL,
    "restore_foreign_forms": FOREIGN_SQL,
    "dump_problems": PROBLEMS_SQL,
    "dump_source": SOURCE_SQL,
}
