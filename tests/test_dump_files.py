"""The files that the queries on whole dumps make and read: more rows make more files, not longer ones."""

import glob
import gzip
import os
import re

import pyarrow as pa
import pyarrow.parquet as pq
import pytest

from tablehaul.operators.restore_whole import FIELDS, restore_whole, stage_whole
from tablehaul.queries import whole
from tablehaul.queries.views import TABLES
from tablehaul.session import holding, shared_dir

SF_DIR = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


def texts(folder):
    found = [f"{d}/{f}" for d, _, names in os.walk(folder) for f in names if f.startswith("part-")]
    return [t for t in ((gzip.open if f.endswith(".gz") else open)(f, "rb").read() for f in found) if t]


def test_mixed_files_stay_short(spark, monkeypatch):
    monkeypatch.setattr(whole, "FILE_BYTES", 100_000)
    folder = whole._mixed(spark, SF_DIR)
    found = texts(folder)
    total = sum(map(len, found))
    assert len(found) > 2 * whole.FILES and max(map(len, found)) < total / 4
    assert all(t.count(b"USE `") == len(TABLES) + 1 for t in found)  # a section for every table, each file its own
    rows = restore_whole(spark, folder).read("shop", "lineitem")
    assert rows.count() == whole.table(spark, SF_DIR, "lineitem").count()


def test_copies_of_a_statement_are_dealt_out(spark, monkeypatch):
    monkeypatch.setattr(whole, "FILE_BYTES", 10_000)
    rows = spark.range(0, 5000, 1, 4).selectExpr("'INSERT INTO `t` VALUES (1);' AS value")
    folder = whole._in_files(spark, rows, "CREATE TABLE `t` (`id` INT);", "copies")
    found = texts(folder)
    assert len(found) == 14 and max(map(len, found)) < 20_000
    assert all(t.startswith(b"CREATE TABLE") and t.count(b"CREATE") == 1 for t in found)
    assert restore_whole(spark, folder).read(None, "t").count() == 5000


def folders(spark):
    top = shared_dir(spark) + "/tablehaul"
    return {f"{top}/{n}" for n in (os.listdir(top) if os.path.isdir(top) else ())}


def test_no_copy_of_the_text_is_kept(spark):
    before = folders(spark)
    folder = whole._mixed(spark, SF_DIR)
    whole._in_files(spark, spark.range(0, 50, 1, 2).selectExpr("concat('INSERT INTO `t` VALUES (', id, ');') AS value"), "USE `a`;", "lines")
    made = {os.path.basename(f).split("-")[0] for f in folders(spark) - before}
    assert made == {"mixed", "lines"} and folder in folders(spark)
    sizes = {form: sum(map(len, texts(f"{folder}/{form}"))) for form in ("plain", "packed")}
    assert 0.5 < sizes["plain"] / sizes["packed"] < 2  # both forms, about half of the text each


def test_statements_travel_compressed():
    rows = pa.array([f"INSERT INTO `t` VALUES {','.join(f'({i * j},{chr(39)}é{chr(39)})' for j in range(2000))};" for i in range(80)])
    batch = pa.RecordBatch.from_arrays([rows], ["value"])
    sent = list(whole._packed(iter)([batch]))
    assert sum(b.column("packed").nbytes for b in sent) < rows.nbytes / 2
    named = [pa.RecordBatch.from_arrays([pa.nulls(len(b), pa.string()), *b.columns], ["value", *b.schema.names]) for b in sent]
    head = pa.RecordBatch.from_arrays([pa.array(["USE `a`;"]), pa.nulls(1, pa.binary()), pa.nulls(1, pa.int32())], ["value", "packed", "size"])
    out = list(whole._unpacked(iter([head, *named])))
    assert [v for b in out for v in b.column(0).to_pylist()] == ["USE `a`;", *rows.to_pylist()]
    assert max(b.nbytes for b in out) < 2 << 20


def test_copies_of_a_row_are_dealt_out(spark, work, monkeypatch):
    monkeypatch.setattr(whole, "FILE_BYTES", 20_000)
    monkeypatch.setattr(whole, "BUFFER_BYTES", 1000)
    monkeypatch.setattr(whole, "TABLES", ["region"])
    spark.range(0, 20_000, 1, 4).selectExpr("CAST(NULL AS INT) AS r_regionkey", "'same' AS r_name").write.parquet(f"{work}/region.parquet")
    folder = whole._mixed(spark, work)
    found = texts(folder)
    assert len(found) > 10 and sorted(map(len, found))[-1] < 80_000
    restored = restore_whole(spark, folder)
    for database, name in (("shop", "region"), whole.SECOND[:2]):
        assert restored.read(database, name).groupBy("r_regionkey", "r_name").count().collect() == [(None, "same", 20_000)]


def test_staged_rows_are_packed_tightly(spark, work):
    os.mkdir(f"{work}/dump")
    lines = "".join(f"INSERT INTO `t{i % 3}` VALUES ({i},'some text');\n" for i in range(3000))
    with open(f"{work}/dump/a.sql", "w") as f:
        f.write("".join(f"CREATE TABLE `t{i}` (`id` INT, `t` TEXT);\n" for i in range(3)) + lines)
    before = spark.conf.get("spark.sql.maxConcurrentOutputFileWriters")
    staged = restore_whole(spark, f"{work}/dump")
    parts = glob.glob(f"{staged.path}/kind=rows/*/table=t1/*.parquet")
    assert {pq.ParquetFile(p).metadata.row_group(0).column(0).compression for p in parts} == {"ZSTD"}
    assert [staged.read(None, f"t{i}").count() for i in range(3)] == [1000] * 3
    assert spark.conf.get("spark.sql.maxConcurrentOutputFileWriters") == before


def test_tokens_beyond_the_staged_columns(spark, work):
    n = len(FIELDS) + 6
    names = [f"`c{i}`" for i in range(n)]
    os.mkdir(f"{work}/dump")
    with open(f"{work}/dump/a.sql", "w") as f:
        f.write(f"CREATE TABLE `w` ({', '.join(f'{c} INT' for c in names)});\nCREATE TABLE `e` ({', '.join(f'{c} INT' for c in names[:len(FIELDS)])});\n")
        f.write(f"INSERT INTO `w` VALUES ({','.join(map(str, range(n)))}),({','.join(['NULL'] * n)});\n")
        f.write(f"INSERT INTO `w` ({', '.join(reversed(names))}) VALUES ({','.join(map(str, range(n)))});\nINSERT INTO `w` (`c{n - 1}`) VALUES (7);\n")
        f.write(f"INSERT INTO `e` VALUES ({','.join(map(str, range(len(FIELDS))))});\n")
        f.write(f"CREATE TABLE `short` (`a` INT, `b` INT);\nINSERT INTO `short` VALUES (1),(2);\n")
    whole_dump = restore_whole(spark, f"{work}/dump")
    rows = [tuple(r) for r in whole_dump.read(None, "w").collect()]
    assert rows == [tuple(range(n)), (None,) * n, tuple(reversed(range(n))), (*[None] * (n - 1), 7)]
    assert [tuple(r) for r in whole_dump.read(None, "e").collect()] == [tuple(range(len(FIELDS)))]
    with pytest.raises(Exception, match="dump not understood.*number of fields.*: 1"):
        whole_dump.read(None, "short").collect()


def test_rows_are_counted_without_sorting_them(spark, work):
    os.mkdir(f"{work}/dump")
    with open(f"{work}/dump/a.sql", "w") as f:
        f.write("CREATE TABLE `t` (`id` INT);\nDROP TABLE `t`;\nINSERT INTO `t` VALUES (1),(2);\nCREATE TABLE `u` (`id` INT);\nINSERT INTO `u` VALUES (1);\nDROP TABLE `u`;\n")
    staged = stage_whole(spark, f"{work}/dump")
    plan = staged._order()._jdf.queryExecution().sparkPlan().toString()
    assert "FileScan" in plan and re.findall(r"(\w+)Aggregate\(keys?=\[file#\d+L?, start", plan) == ["Hash", "Hash"]
    assert {(r.table, r.rows, r.dropped) for r in staged._order().collect()} == {("t", 2, False), ("u", 1, True)}


def test_settings_hold_inside_only(spark):
    key, other = "spark.sql.maxConcurrentOutputFileWriters", "spark.sql.tablehaul.unknown"
    spark.conf.set(key, "3")
    try:
        with pytest.raises(ZeroDivisionError), holding(spark, {key: "7", other: "x"}):
            assert (spark.conf.get(key), spark.conf.get(other)) == ("7", "x")
            1 / 0
        assert (spark.conf.get(key), spark.conf.get(other, None)) == ("3", None)
    finally:
        spark.conf.unset(key)
