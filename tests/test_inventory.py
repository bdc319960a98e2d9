"""Names, headers, folder listings, retry lists, catalogs and plans."""

import gzip
import os

import pytest
from pyspark.sql import functions as F

from tablehaul.functions.names import guess_database
from tablehaul.operators.dump_writer import write_dump
from tablehaul.operators.targets import NO_DATABASE, classify, detect_database
from tablehaul.plans.export import export_plan, select_tables
from tablehaul.plans.imports import candidates
from tablehaul.sources.catalog import from_lines, normalise, parquet_tables
from tablehaul.sources.inventory import header_lines, list_dumps, require_dumps, resolve_retry, retry_lines


def _file(path, text, zipped=False):
    os.makedirs(os.path.dirname(path), exist_ok=True)
    with (gzip.open(path, "wb") if zipped else open(path, "wb")) as f:
        f.write(text.encode() if isinstance(text, str) else text)


GUESSES = {
    "store__orders.sql": "store", "store.orders.sql": "store", "store__orders.sql.gz": "store", "store.orders.sql.GZ": "store",
    "orders.sql": None, "orders.sql.gz": None, "__orders.sql": None, ".a.b.sql": None, "a.b__c.sql": "a.b", "orders": None,
    "__a.b.sql": "__a",
}


def test_guess_database(spark):
    df = spark.createDataFrame(list(GUESSES.items()), "name string, want string")
    assert df.where(~guess_database(F.col("name")).eqNullSafe(F.col("want"))).collect() == []


HEADERS = [
    (["-- MySQL dump", "-- Host: localhost    Database: shop_production", "CREATE TABLE `x`"], "shop_production"),
    (["-- Database: `9741425`"], "9741425"),
    (["", "  USE `custom_db`;"], "custom_db"),
    (["CREATE DATABASE /*!32312 IF NOT EXISTS*/ `analytics_db` /*!40100 */;"], "analytics_db"),
    (["CREATE DATABASE IF NOT EXISTS 'plain'"], "plain"),
    (["-- Current Database: \"quoted\""], "quoted"),
    (["CREATE TABLE `x` (", "-- Database: late"], None),
    (["INSERT INTO `x` VALUES ('Database: no');"], None),
    (["  LOCK TABLES `x` WRITE;", "USE late;"], None),
    (["create table x (", "-- database: small"], "small"),
    (["-- nothing here"], None),
    (["--"] * 99 + ["USE edge;"], "edge"),
    (["--"] * 100 + ["USE beyond;"], None),
]


def test_detect_database(spark):
    rows = [(i, n + 1, l) for i, (lines, _) in enumerate(HEADERS) for n, l in enumerate(lines)]
    df = spark.createDataFrame(rows, "file int, line_no int, line string")
    found = {r.file: r.header_db for r in detect_database(df, "file").collect()}
    assert [found.get(i) for i in range(len(HEADERS))] == [want for _, want in HEADERS]


def test_headers_of_files(spark, work):
    for i, (lines, _) in enumerate(HEADERS):
        _file(f"{work}/f{i:02}.sql" + (".gz" if i % 2 else ""), "\r\n".join(lines) + "\n", zipped=bool(i % 2))
    _file(f"{work}/f90.sql", b"-- \xff\xfe\nUSE hidden;\n")
    _file(f"{work}/f91 a%20b.sql", "-- Database: spaced")
    _file(f"{work}/f92.sql", b"INSERT INTO `t` VALUES ('" + b"x" * 300000 + b"');\nUSE late;\n")
    _file(f"{work}/f93.sql", "")
    _file(f"{work}/f94.sql.gz", b"this is not gzip")
    cut = gzip.compress(b"USE cut;\n" + os.urandom(100000).hex().encode())
    _file(f"{work}/f95.sql.gz", cut[: len(cut) // 2])
    items = list_dumps(spark, work)
    found = {r.file_name[:3]: r.header_db for r in items.join(detect_database(header_lines(items), "path"), "path", "left").collect()}
    want = {f"f{i:02}": h for i, (_, h) in enumerate(HEADERS)}
    assert found == {**want, "f90": None, "f91": "spaced", "f92": None, "f94": None, "f95": "cut"}


def test_list_dumps(spark, work):
    root = work + "/dumps"
    for name in ["users.sql", "sub/ORDERS.SQL.GZ", "sub/deep/too_deep.sql", "notes.txt", "data.gz", "sub/x.sql.zst"]:
        _file(f"{root}/{name}", "x" * 7)
    write_dump(spark.range(0, 10, 1, 3), root + "/shop__t.sql.gz", "shop", "t", compress=True)
    found = {r.relative_path: r for r in list_dumps(spark, root + "/").collect()}
    assert sorted(found) == ["shop__t.sql.gz", "sub/ORDERS.SQL.GZ", "users.sql"]
    assert found["users.sql"].size_bytes == 7 and found["users.sql"].parts == 1
    assert found["shop__t.sql.gz"].parts == 4 and found["shop__t.sql.gz"].path.endswith("/shop__t.sql.gz")
    with pytest.raises(FileNotFoundError):
        require_dumps(list_dumps(spark, root + "/sub/deep").where("false"))


def test_candidates_of_a_folder(spark, work):
    _file(work + "/users.sql", "-- Current Database: `shop_db`\nCREATE TABLE users (id INT PRIMARY KEY);\n")
    _file(work + "/stats__views.sql", "CREATE TABLE v (id INT);\n")
    _file(work + "/plain.sql", "CREATE TABLE p (id INT);\n")
    got = {r.file_name: (r.status, r.database, r.reason) for r in candidates(spark, work).collect()}
    assert got == {
        "users.sql": ("task", "shop_db", None),
        "stats__views.sql": ("task", "stats", None),
        "plain.sql": ("skipped", None, NO_DATABASE),
    }
    got = {r.file_name: (r.status, r.database) for r in candidates(spark, work, name_filter="USER", default="d").collect()}
    assert got == {"users.sql": ("task", "shop_db"), "stats__views.sql": ("filtered", None), "plain.sql": ("filtered", None)}
    assert {r.database for r in candidates(spark, work, default="d").collect()} == {"shop_db", "d"}
    assert {r.database for r in candidates(spark, work, forced="f").collect()} == {"f"}


def test_retry_list(spark):
    lines = ["/abs/a.sql", "  b.sql  ", "", "# c.sql", "gone.sql", "/abs/a.sql", "sub/c.sql"]
    entries = retry_lines(spark.createDataFrame(list(enumerate(lines)), "line_no int, value string"))
    known = spark.createDataFrame([("/abs/a.sql",), ("/dumps/b.sql",), ("/dumps/sub/c.sql",), ("/dumps/other.sql",)], "path string")
    got = [tuple(r) for r in resolve_retry(entries, known, F.lit("/dumps")).orderBy("line_no").collect()]
    assert got == [(0, "/abs/a.sql"), (1, "/dumps/b.sql"), (5, "/abs/a.sql"), (6, "/dumps/sub/c.sql")]


def test_catalog_lines(spark):
    lines = ["crm_db\tcustomers\t5242880\t10000", "crm_db\t leads \t1048576\t2000\textra", "short\tline\t1", "crm_db\tbad\tx\t-5"]
    df = spark.createDataFrame([(l,) for l in lines], "value string")
    assert sorted(map(tuple, from_lines(df).collect())) == [
        ("crm_db", "bad", 0, 0), ("crm_db", "customers", 5242880, 10000), ("crm_db", "leads", 1048576, 2000),
    ]


def test_catalog_of_parquet(spark, work):
    spark.range(0, 70, 1, 3).write.parquet(work + "/big.parquet")
    spark.range(0, 7).selectExpr("id as other").write.parquet(work + "/small")
    rows = {r.table_name: r for r in parquet_tables(spark, work, "d").collect()}
    assert {n: r.rows for n, r in rows.items()} == {"big": 70, "small": 7} and rows["big"].bytes > 0


CATALOG = [
    ("crm", "customers", "BASE TABLE", 5, 1, 10), ("crm", "v", "VIEW", None, None, None),
    ("web", "hits", "BASE TABLE", None, 4, None), ("mysql", "user", "BASE TABLE", 1, 1, 1), ("o'db", "a", "BASE TABLE", 9, 9, 9),
]


def _catalog(spark):
    return normalise(spark.createDataFrame(CATALOG, "db string, table_name string, table_type string, data_length bigint, index_length bigint, table_rows bigint"))


def test_export_plan(spark):
    plan = export_plan(_catalog(spark), "out/", compress=True, all_databases=True).collect()
    assert [(r.file_name, r.estimated_bytes, r.estimated_rows) for r in plan] == [
        ("o'db__a.sql.gz", 18, 9), ("crm__customers.sql.gz", 6, 10), ("web__hits.sql.gz", 0, 0),
    ]
    single = export_plan(_catalog(spark), "out", database="o'db").collect()
    assert [(r.file_name, r.output_path) for r in single] == [("a.sql", "out/a.sql")]


def test_select_tables(spark):
    cat = _catalog(spark)
    assert select_tables(cat, databases=" crm , web,").count() == 2
    assert select_tables(cat, databases="crm,web", exclude_tables=" hits").count() == 1
    assert select_tables(cat, all_databases=True, tables="hits,a", exclude_tables="a").count() == 1
    with pytest.raises(ValueError):
        select_tables(cat)


def test_status_of_unreadable(spark):
    df = spark.createDataFrame([("a__b.sql", None, None)], "file_name string, header_db string, size_bytes bigint")
    row = classify(df).first()
    assert row.status == "skipped" and row.reason == "Cannot read file metadata"
