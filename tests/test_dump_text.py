"""Escaping, statement packing and parsing of dump text."""

import datetime as dt
import gzip
import os
import random
from decimal import Decimal

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.errors import PySparkException
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tablehaul.functions.sqltext import escape, unescape
from tablehaul.operators.dump_writer import dump_text, header_lines, insert_statements, write_dump
from tablehaul.operators.reconcile import reconcile, row_differences
from tablehaul.operators.restore import quarantine, restore
from tablehaul.sources.ddl import create_table, parse_create_table
from tablehaul.sources.dump_reader import read_dump, read_schema

ALPHABET = "\\'\"\n\r\t\0\x1a(),;`%_ né日aN0"


def _roundtrip(spark, df, path, compress=False, **options):
    write_dump(df, path, "shop", "t", compress, **options)
    return read_dump(spark, path)


def test_escape_unescape_random(spark):
    rng = random.Random(7)
    texts = ["".join(rng.choice(ALPHABET) for _ in range(rng.randrange(0, 24))) for _ in range(4000)]
    df = spark.createDataFrame([(t,) for t in texts], "s string")
    assert df.where(unescape(escape(F.col("s"))) != F.col("s")).count() == 0


@settings(max_examples=15, deadline=None)
@given(st.lists(st.tuples(st.one_of(st.none(), st.text(ALPHABET, max_size=12)), st.one_of(st.none(), st.integers(-9, 9))), max_size=6))
def test_any_rows_come_back(spark, tmp_path_factory, rows):
    df = spark.createDataFrame(rows, "s string, n int")
    back = _roundtrip(spark, df, str(tmp_path_factory.mktemp("d") / "t.sql"))
    assert sorted(map(repr, back.collect())) == sorted(map(repr, df.collect()))


def test_doubled_and_foreign_escapes(spark):
    cases = [
        ("it''s", "it's"), ("\\'\\'", "''"), ("\\'''", "''"), ("a\\\\''b", "a\\'b"), ("\\\\n", "\\n"), ("\\n\\\\", "\n\\"),
        ("\\\"\\t\\b\\0\\Z", "\"\t\b\0\x1a"), ("\\q\\%\\_", "q\\%\\_"), ("", ""),
    ]
    df = spark.createDataFrame(cases, "raw string, want string")
    assert df.where(~unescape(F.col("raw")).eqNullSafe(F.col("want"))).collect() == []


ALL_TYPES = T.StructType(
    [
        T.StructField("b", T.BooleanType()), T.StructField("y", T.ByteType()), T.StructField("h", T.ShortType()),
        T.StructField("i", T.IntegerType()), T.StructField("l", T.LongType()), T.StructField("f", T.FloatType()),
        T.StructField("d", T.DoubleType()), T.StructField("m", T.DecimalType(20, 4)), T.StructField("s", T.StringType()),
        T.StructField("a", T.DateType()), T.StructField("n", T.TimestampNTZType()), T.StructField("z", T.TimestampType()),
        T.StructField("x", T.BinaryType()), T.StructField("r", T.ArrayType(T.DoubleType())),
        T.StructField("p", T.MapType(T.StringType(), T.IntegerType())),
        T.StructField("u", T.StructType([T.StructField("k'`", T.StringType()), T.StructField("t", T.TimestampNTZType())])),
        T.StructField("odd `name", T.LongType()),
    ]
)


def _all_types(spark):
    ntz = dt.datetime(2024, 3, 31, 2, 30, 0, 123456)
    utc = dt.datetime(2024, 10, 27, 0, 30, 0, 1, tzinfo=dt.timezone.utc)
    rows = [
        (True, -128, 32767, -(2**31), 2**63 - 1, 1.5e-10, 1e300, Decimal("-123456789.0001"), "NULL", dt.date(1970, 1, 1),
         ntz, utc, b"\x00\xff'\\", [1.5, None], {"a": 1, "b'": None}, ("x\n'y", ntz), 1),
        (False, 0, 0, 0, 0, 0.0, -0.5, Decimal("0.0000"), "", dt.date(2024, 2, 29), dt.datetime(2024, 1, 1),
         dt.datetime(2024, 10, 27, 1, 30, tzinfo=dt.timezone.utc), b"", [], {}, (None, None), 2),
        (None,) * 17,
    ]
    return spark.createDataFrame(rows, ALL_TYPES)


@pytest.mark.parametrize("zone", ["UTC", "Europe/Berlin"])
def test_all_types(spark, work, zone):
    before = spark.conf.get("spark.sql.session.timeZone")
    spark.conf.set("spark.sql.session.timeZone", zone)
    try:
        df = _all_types(spark)
        back = _roundtrip(spark, df, work + "/t.sql.gz", compress=True)
        assert [(f.name, f.dataType) for f in back.schema] == [(f.name, f.dataType) for f in df.schema]
        assert sorted(map(repr, back.collect())) == sorted(map(repr, df.collect()))
        assert reconcile(df, back).first().asDict() == {"source_rows": 3, "restored_rows": 3, "missing_rows": 0, "extra_rows": 0}
    finally:
        spark.conf.set("spark.sql.session.timeZone", before)


def test_infinity_is_refused(spark, work):
    df = spark.createDataFrame([(float("inf"),)], "d double")
    with pytest.raises(PySparkException, match="no SQL literal"):
        write_dump(df, work + "/t.sql", "shop", "t")
    assert not os.path.exists(work + "/t.sql/_SUCCESS")


def test_statement_size_and_oversize_rows(spark):
    sizes = [1, 500, 40, 2000, 3, 3, 3, 990, 1, 0] * 40
    df = spark.createDataFrame([(i, "x" * n) for i, n in enumerate(sizes)], "i int, s string").coalesce(1)
    lines = [r.value for r in insert_statements(df, "t", 1024).collect()]
    assert all(l.startswith("INSERT INTO `t` VALUES (") and l.endswith(");") for l in lines)
    long = [l for l in lines if len(l) > 1024]
    assert long and all(l.count("),(") == 0 for l in long)
    assert sum(l.count("),(") + 1 for l in lines) == len(sizes)
    # packed as tightly as order allows: no statement could have taken the next row
    bodies = [l[len("INSERT INTO `t` VALUES ") : -1].split("),(") for l in lines]
    for line, after in zip(lines, bodies[1:]):
        assert len(line) + len(after[0]) + 1 > 1024


def test_packing_across_arrow_batches(spark):
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    try:
        lines = [r.value for r in insert_statements(spark.range(0, 1000, 1, 2), "t", 200).collect()]
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", before)
    keys = [int(k) for l in lines for k in l[len("INSERT INTO `t` VALUES (") : -2].split("),(")]
    assert keys == list(range(1000)) and max(map(len, lines)) <= 200 and len(lines) < 40


def test_parts_structure_and_header(spark, work):
    df = spark.range(0, 100, 1, 4).withColumn("s", F.lit("v"))
    write_dump(df, work + "/shop__t.sql", "shop", "t")
    parts = sorted(p for p in os.listdir(work + "/shop__t.sql") if p.startswith("part-"))
    texts = [open(f"{work}/shop__t.sql/{p}").read() for p in parts]
    assert len(parts) == 5
    assert all(t.startswith("\n".join(header_lines("localhost", "shop"))) for t in texts)
    assert ["CREATE TABLE" in t for t in texts] == [True] + [False] * 4
    assert "INSERT" not in texts[0]


def test_structure_or_rows_only(spark, work):
    df = spark.range(3)
    assert not any("INSERT" in r.value for r in dump_text(df, "d", "t", rows=False).collect())
    assert not any("CREATE" in r.value for r in dump_text(df, "d", "t", structure=False).collect())


def test_empty_table(spark, work):
    back = _roundtrip(spark, spark.range(5).where("id > 9"), work + "/t.sql.gz", compress=True)
    assert back.count() == 0 and back.columns == ["id"]


FOREIGN = """-- MySQL dump 10.13
/*!40101 SET NAMES utf8mb4 */;
USE `shop`;
DROP TABLE IF EXISTS `people`;
CREATE TABLE `people` (
  `id` int(10) unsigned NOT NULL AUTO_INCREMENT,
  `name` varchar(40) DEFAULT 'a,b(c)' COMMENT 'it''s, a (name)',
  `price` decimal(8,2) DEFAULT NULL,
  `raw` blob,
  `ok` tinyint(1) DEFAULT '1',
  `big` bigint(20) unsigned DEFAULT NULL,
  `kind` enum('x','y,z') DEFAULT NULL,
  PRIMARY KEY (`id`),
  KEY `k` (`name`,`price`)
) ENGINE=InnoDB DEFAULT CHARSET=utf8mb4;
LOCK TABLES `people` WRITE;
INSERT INTO `people` VALUES (1,'it''s (x), ok',-1.50,0xAB01,1,18446744073709551615,'x'), (2,'NULL',NULL,_binary 'abc',0,NULL,'y,z');
INSERT INTO `people` (`id`,`name`,`price`,`raw`,`ok`,`big`,`kind`) VALUES
(3,'VALUES (1),(2)',1e1,'',NULL,7,NULL),
(4,'a\\\\',0,NULL,1,8,'x');
INSERT IGNORE INTO people VALUES (5,'tab\\there',3.00,0x00,1,9,'x');
UNLOCK TABLES;
"""


def test_foreign_dump(spark, work):
    path = work + "/people.sql"
    with open(path, "w") as f:
        f.write(FOREIGN)
    name, schema = read_schema(spark, path)
    assert name == "people"
    assert [f.dataType.simpleString() for f in schema] == [
        "bigint", "string", "decimal(8,2)", "binary", "boolean", "decimal(20,0)", "string",
    ]
    rows = [tuple(r) for r in read_dump(spark, path).orderBy("id").collect()]
    assert rows == [
        (1, "it's (x), ok", Decimal("-1.50"), b"\xab\x01", True, Decimal(2**64 - 1), "x"),
        (2, "NULL", None, b"abc", False, None, "y,z"),
        (3, "VALUES (1),(2)", Decimal("10.00"), b"", None, Decimal(7), None),
        (4, "a\\", Decimal("0.00"), None, True, Decimal(8), "x"),
        (5, "tab\there", Decimal("3.00"), b"\x00", True, Decimal(9), "x"),
    ]


def test_small_statement_on_one_line(spark, work):
    with open(work + "/t.sql", "w") as f:
        f.write("DROP TABLE IF EXISTS t;\nCREATE TABLE t (id INT PRIMARY KEY);\nINSERT INTO t VALUES (1), (2)\n;\n")
    assert sorted(r.id for r in read_dump(spark, work + "/t.sql").collect()) == [1, 2]


def test_spaces_around_values(spark, work):
    with open(work + "/t.sql", "w") as f:
        f.write("CREATE TABLE t (i INT, s TEXT, n INT);\nINSERT INTO t VALUES ( 1 , 'a, b' , NULL ),(2,'c', 5),(3 ,'',6),(4,7,NULL);\n")
    got = sorted(map(tuple, read_dump(spark, work + "/t.sql").collect()))
    assert got == [(1, "a, b", None), (2, "c", 5), (3, "", 6), (4, "7", None)]


def test_one_table_of_several(spark, work):
    with open(work + "/t.sql", "w") as f:
        f.write("CREATE TABLE `a` (`x` int);\nINSERT INTO `a` VALUES (1),(2);\nINSERT INTO `b` VALUES ('q',3);\n")
    schema = T.StructType([T.StructField("x", T.IntegerType())])
    assert read_dump(spark, work + "/t.sql", schema, table="a").count() == 2
    with pytest.raises(PySparkException, match="dump not understood"):
        read_dump(spark, work + "/t.sql", schema).collect()


@pytest.mark.parametrize(
    "bad, problem",
    [
        ("INVALID SQL SYNTAX FAIL HERE;", "unrecognised line"),
        ("INSERT INTO `t` VALUES (1,'a'),(2,'b;", "text between the rows"),
        ("INSERT INTO `t` VALUES (1,'a') junk (2,'b');", "text between the rows"),
        ("INSERT INTO `t` VALUES (1,'a',3);", "number of fields"),
        ("INSERT INTO `t` VALUES (1);", "number of fields"),
        ("INSERT INTO `t` (`s`,`i`) VALUES ('a',1);", "column list"),
        ("INSERT INTO `t` VALUES (1,);", "number of fields"),
        ("INSERT INTO `t` VALUES ('1,a');", "number of fields"),
        ("INSERT INTO `t` VALUES (',');", "number of fields"),
        ("INSERT INTO `t` VALUES (1,'a'b);", "number of fields"),
        ("INSERT INTO `t` VALUES (1,b'a');", "number of fields"),
        ("INSERT INTO `t` VALUES (1,'a'',b);", "text between the rows"),
        ("INSERT INTO `t` VALUES (,'a');", "number of fields"),
        ("INSERT INTO `t` VALUES (1,a);", "a value does not fit column s"),
        ("INSERT INTO `t` VALUES (abc,'a');", "a value does not fit column i"),
        ("INSERT INTO `t` VALUES (99999999999,'a');", "a value does not fit column i"),
    ],
)
def test_problems_fail_the_table(spark, work, bad, problem):
    path = work + "/t.sql"
    with open(path, "w") as f:
        f.write(f"CREATE TABLE `t` (`i` int, `s` text);\nINSERT INTO `t` VALUES (7,'fine');\n{bad}\n")
    with pytest.raises(PySparkException, match="dump not understood"):
        restore(spark, path, work + "/restored")
    assert not os.path.exists(work + "/restored/_SUCCESS")
    found = quarantine(spark, path).collect()
    assert len(found) == 1 and found[0].problem.startswith(problem)


def test_bytes_that_are_not_utf8(spark, work):
    with open(work + "/t.sql", "wb") as f:
        f.write(b"CREATE TABLE `t` (`s` text);\nINSERT INTO `t` VALUES ('\xff\xfe');\n")
    with pytest.raises(PySparkException, match="not UTF-8"):
        read_dump(spark, work + "/t.sql").collect()


def test_a_problem_is_found_even_when_only_counting(spark, work):
    with open(work + "/t.sql", "w") as f:
        f.write("CREATE TABLE `t` (`i` int, `s` text);\nINSERT INTO `t` VALUES (1,'a',3);\n")
    with pytest.raises(PySparkException):
        read_dump(spark, work + "/t.sql").count()


def test_truncated_gzip_fails(spark, work):
    whole = gzip.compress(b"CREATE TABLE `t` (`i` int);\n" + b"INSERT INTO `t` VALUES (1),(2);\n" * 5000)
    with open(work + "/t.sql.gz", "wb") as f:
        f.write(whole[: len(whole) // 2])
    schema = T.StructType([T.StructField("i", T.IntegerType())])
    with pytest.raises(Exception, match="(?i)unexpected end of|EOFException|FAILED_READ_FILE"):
        restore(spark, work + "/t.sql.gz", work + "/restored", schema)
    assert not os.path.exists(work + "/restored/_SUCCESS")


def test_very_long_row(spark, work):
    df = spark.createDataFrame([("'\\" * 400000,), ("),(" * 300000,)], "s string")
    back = _roundtrip(spark, df, work + "/t.sql")
    assert df.exceptAll(back).count() == 0 and back.count() == 2


def test_hot_value_everywhere(spark, work):
    df = spark.range(0, 3000, 1, 3).select(F.when(F.col("id") % 3 == 0, "same").otherwise(F.col("id").cast("string")).alias("s"))
    back = _roundtrip(spark, df, work + "/t.sql")
    assert row_differences(df, back).count() == 0
    less = back.where("s <> 'same'").unionAll(back.where("s = 'same'").limit(990))
    assert reconcile(df, less).first().missing_rows == 10


def test_ddl_both_ways():
    name, schema = parse_create_table(create_table("odd `t", ALL_TYPES))
    assert name == "odd `t" and schema == ALL_TYPES


def test_spread_of_gzip_lines(spark, work):
    df = spark.range(0, 5000, 1, 1)
    write_dump(df, work + "/t.sql.gz", "shop", "t", True, buffer_bytes=500)
    assert read_dump(spark, work + "/t.sql.gz", spread=4).agg(F.sum("id")).first()[0] == sum(range(5000))


def test_patterns_do_not_run_out_of_stack(spark, work):
    wide = T.StructType([T.StructField(f"c{i}", T.IntegerType()) for i in range(600)])
    with open(work + "/wide.sql", "w") as f:
        f.write("INSERT INTO t VALUES (" + ",".join(["7"] * 600) + "),(" + ",".join(["NULL"] * 600) + ");\n")
    assert read_dump(spark, work + "/wide.sql", wide).select("c0", "c599").count() == 2

    one = T.StructType([T.StructField("s", T.StringType()), T.StructField("t", T.StringType())])
    with open(work + "/quotes.sql", "w") as f:
        f.write("INSERT INTO t VALUES ('" + "''" * 300000 + "','x'),('" + "'',''" * 100000 + "','\\n');\n")
        f.write("INSERT INTO t VALUES " + ",".join(["('a','b')"] * 100000) + ";\n")
    assert read_dump(spark, work + "/quotes.sql", one).agg(F.sum(F.length("s"))).first()[0] == 300000 + 300000 + 100000
