"""Dumps of several tables: rows go to their own table or fail, and nothing is dropped unseen."""

import pytest
from pyspark.sql import Row

from tablehaul.operators.reconcile import row_differences
from tablehaul.operators.restore import quarantine
from tablehaul.operators.sequence import RunningTotal
from tablehaul.plans.imports import candidates, import_plan, run_import
from tablehaul.sources.catalog import parquet_tables
from tablehaul.sources.ddl import parse_create_table
from tablehaul.sources.dump_reader import read_dump, read_schemas
from tablehaul.sources.inventory import _head

TWO = """-- Database: `shop`
CREATE TABLE `a` (`id` INT, `name` TEXT);
INSERT INTO `a` VALUES (1,'x'),(2,'CREATE TABLE `z` (`q` INT);');
{more}CREATE TABLE `b` (
  `code` INT,
  `qty` TEXT
);
INSERT INTO `b` VALUES (7,'q'),(8,'r');
"""


def write(work, name, text):
    path = f"{work}/{name}"
    with open(path, "w") as out:
        out.write(text)
    return path


def test_each_row_goes_to_its_own_table(spark, work):
    path = write(work, "two.sql", TWO.format(more="-- filler\n" * 6000))
    assert sorted(read_schemas(spark, path)) == ["a", "b"]
    assert sorted(map(tuple, read_dump(spark, path, table="b").collect())) == [(7, "q"), (8, "r")]
    assert read_dump(spark, path, table="b").columns == ["code", "qty"]
    assert read_dump(spark, path, table="a").count() == 2
    with pytest.raises(ValueError, match="several tables"):
        read_dump(spark, path)


@pytest.mark.parametrize("end", ["\n", "\r\n"])
@pytest.mark.parametrize("split", ["64", "1000", "134217728"])
def test_schemas_are_read_by_lines_wherever_files_split(spark, work, end, split):
    limits = {"mapreduce.input.linerecordreader.line.maxlength": "2000", "spark.sql.files.maxPartitionBytes": split, "spark.sql.files.openCostInBytes": "1"}
    wide = "".join(f"  `c{i}` INT COMMENT 'a; b',\n" for i in range(40)) + f"  `d` TEXT COMMENT '{'x' * 300}',\n"
    text = TWO.replace("  `code` INT,\n", wide).format(more="-- filler\n" * 300).replace("(7,'q'),(8,'r')", "(1)")
    path = f"{work}/two.sql"
    with open(path, "w", newline="") as out:
        out.write(text.replace("\n", end))
    for name, value in limits.items():
        spark.conf.set(name, value)
    try:
        schemas = read_schemas(spark, path)
    finally:
        for name in limits:
            spark.conf.unset(name)
    assert {name: schema.names for name, schema in schemas.items()} == {"a": ["id", "name"], "b": [*(f"c{i}" for i in range(40)), "d", "qty"]}


def test_rows_of_an_unknown_table_are_a_problem(spark, work):
    path = write(work, "one.sql", "CREATE TABLE a (id INT);\nINSERT INTO a VALUES (1);\nINSERT INTO c VALUES (2);\n")
    assert [r.problem for r in quarantine(spark, path).collect()] == ["a row statement of a table that the dump does not create"]
    with pytest.raises(Exception, match="does not create"):
        read_dump(spark, path).collect()


@pytest.mark.parametrize("line", ["/* c */ INSERT INTO a VALUES (2);", "LOCK TABLES a WRITE; INSERT INTO a VALUES (2);", "SET @a=1; REPLACE INTO a VALUES (2);"])
def test_rows_behind_another_statement_are_not_dropped(spark, work, line):
    path = write(work, "one.sql", f"CREATE TABLE a (id INT);\nINSERT INTO a VALUES (1);\n{line}\n")
    assert quarantine(spark, path).count() == 1
    with pytest.raises(Exception, match="unrecognised line"):
        read_dump(spark, path).collect()


def test_import_of_a_dump_with_two_tables(spark, work):
    write(work, "two.sql", TWO.format(more=""))
    events = run_import(spark, import_plan(candidates(spark, work), ledger=None), f"{work}/out")
    assert {r.kind for r in events.collect()} == {"started", "finished"}
    assert spark.read.parquet(f"{work}/out/shop/a").count() == 2
    assert sorted(map(tuple, spark.read.parquet(f"{work}/out/shop/b").collect())) == [(7, "q"), (8, "r")]


def test_two_items_of_one_table_are_not_mixed(spark, work):
    import os

    for folder, value in (("p", 1), ("q", 2)):
        os.makedirs(f"{work}/{folder}")
        write(work, f"{folder}/users.sql", f"-- Database: `shop`\nCREATE TABLE users (id INT);\nINSERT INTO users VALUES ({value});\n")
    events = run_import(spark, import_plan(candidates(spark, work), ledger=None), f"{work}/out").collect()
    assert sorted(r.kind for r in events if r.kind != "started") == ["failed", "finished"]
    assert spark.read.parquet(f"{work}/out/shop/users").count() == 1


def test_partition_clause_makes_no_columns():
    text = "CREATE TABLE t (id INT COMMENT 'a) b', y DECIMAL(5,2)) ENGINE=x PARTITION BY RANGE (y) (PARTITION p0 VALUES LESS THAN (5), PARTITION p1 VALUES LESS THAN (9));"
    assert parse_create_table(text)[1].names == ["id", "y"]


def test_unknown_sizes_add_nothing():
    import numpy as np

    total, out = RunningTotal("v", "t").walk(0, {"v": np.array([5.0, np.nan, 7.0])})
    assert total == 12 and out["t"].to_pylist() == [5, 5, 12]


def test_equal_maps_in_another_order_are_equal(spark):
    one = spark.createDataFrame([Row(m={"a": 1, "b": 2})], "m map<string,int>")
    two = spark.createDataFrame([Row(m={"b": 2, "a": 1})], "m map<string,int>")
    assert row_differences(one, two).count() == 0


def test_counts_of_a_folder_with_a_space(spark, work):
    spark.range(5).write.parquet(f"{work}/my table+1")
    assert [(r.table_name, r["rows"]) for r in parquet_tables(spark, work, "d").collect()] == [("my table+1", 5)]


def test_a_long_line_is_read_once(work):
    import time

    path = write(work, "long.sql", "x" * (64 << 20) + "\n-- Database: `shop`\n")
    begun = time.time()
    lines = _head(path, 10)
    assert lines[1] == "-- Database: `shop`" and time.time() - begun < 5
