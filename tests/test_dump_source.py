import datetime
import decimal

import pytest
from pyspark.sql import functions as F

from tablehaul.operators.dump_writer import write_dump
from tablehaul.sources.dump_source import DumpReader, DumpSource, Part, _lines


@pytest.fixture
def source(spark):
    spark.dataSource.register(DumpSource)

    def load(path, schema=None, **options):
        reader = spark.read.format("sqldump").options(**options)
        return (reader.schema(schema) if schema else reader).load(path)

    return load


@pytest.fixture
def typed(spark):
    schema = (
        "id bigint, ok boolean, small tinyint, d double, f float, money decimal(12,2), day date, at timestamp, local timestamp_ntz, "
        "t string, raw binary, list array<int>, pairs map<string,double>, inner struct<a:bigint,b:string>"
    )
    at = datetime.datetime(2024, 2, 29, 1, 2, 3, 456789)
    full = (1, True, -7, 0.1, 2.5, decimal.Decimal("-3.50"), datetime.date(1999, 1, 2), at, at, "a'b\\n\n\r\0\x1a,);é%_", b"\0\xff'", [1, None, 3], {"k'": 1.5}, (5, "x,y"))
    empty = (2, False, 0, 0.0, 0.0, decimal.Decimal("0.00"), datetime.date(1, 1, 1), at, at, "", b"", [], {}, (None, None))
    return spark.createDataFrame([full, empty, empty, (3,) + (None,) * 13], schema).coalesce(1)


def _same(a, b):
    text = lambda df: sorted(map(repr, df.collect()))
    return a.schema.names == b.schema.names and text(a) == text(b)


@pytest.mark.parametrize("options", [{}, {"compress": True}, {"block_bytes": 64}])
def test_every_type_comes_back(source, typed, work, options):
    write_dump(typed, f"{work}/d", "shop", "t", **options)
    assert _same(source(f"{work}/d"), typed)


def test_table_and_columns_are_chosen(spark, source, typed, work):
    write_dump(typed, f"{work}/a/t.sql", "shop", "t")
    write_dump(spark.range(5).withColumnRenamed("id", "n"), f"{work}/a/u.sql.gz", "shop", "u", compress=True)
    assert sorted(r.n for r in source(f"{work}/a", table="u").collect()) == [0, 1, 2, 3, 4]
    few = source(f"{work}/a", "T string, id string", table="t")
    assert sorted((r.T, r.id) for r in few.where("id <> '3'").collect()) == [("", "2"), ("", "2"), ("a'b\\n\n\r\0\x1a,);é%_", "1")]
    with pytest.raises(Exception, match="several tables"):
        source(f"{work}/a").count()
    with pytest.raises(Exception, match="no CREATE TABLE for v"):
        source(f"{work}/a", table="v").count()
    with pytest.raises(Exception, match="no column nothing"):
        source(f"{work}/a", "nothing int", table="t").count()
    reader = DumpReader("", "t", ["a", "b", "c"], T_struct("c string"), 1, True)
    assert reader._row().match("(1,'x',3);").groups() == ("3",)


def T_struct(ddl):
    from pyspark.sql import types as T

    return T.StructType.fromDDL(ddl)


def test_splits_of_any_size_read_each_line_once(spark, source, work):
    lines = ["CREATE TABLE `t` (", "  `id` BIGINT,", "  `t` TEXT", ");"] + [f"INSERT INTO `t` VALUES ({i},'{'é' * (i % 40)}'),({-i},NULL);" for i in range(60)]
    text = "\n".join(lines)
    path = f"{work}/t.sql"
    open(path, "w").write(text)
    for size in (1, 2, 7, 64, 1000, 1 << 20):
        total = len(text.encode())
        found = [line for at in range(0, total, size) for line in _lines(Part(path, at, min(total, at + size)))]
        assert found == lines
    df = source(path, splitBytes=500)
    assert df.rdd.getNumPartitions() > 5
    assert df.agg(F.count("*"), F.sum("id"), F.count("t")).first() == (120, 0, 60)


def test_blocks_are_dealt_out(spark, source, work):
    rows = spark.range(0, 20000, 1, 2).select("id", F.sha2(F.col("id").cast("string"), 256).alias("t"))
    write_dump(rows, f"{work}/d", "shop", "t", block_bytes=64 << 10, buffer_bytes=8 << 10)
    df = source(f"{work}/d", splitBytes=64 << 10)
    assert df.rdd.getNumPartitions() > 6 and _same(df, rows)


@pytest.mark.parametrize(
    "line, problem",
    [
        ("INSERT INTO `t` VALUES (1,'a'),(2);", "does not fit the table"),
        ("INSERT INTO `t` VALUES (1,'a') oops;", "does not fit the table"),
        ("INSERT INTO `t` VALUES ('x','a');", "does not fit column id"),
        ("INSERT INTO `t` VALUES (99999999999999999999,'a');", "does not fit column id"),
        ("INSERT INTO `t` VALUES (1,word);", "does not fit column t"),
        ("INSERT INTO `t` (`t`,`id`) VALUES ('a',1);", "column list differs"),
        ("INSERT INTO `u` VALUES (1);", "rows of another table"),
        ("(3,'c');", "unrecognised line"),
        ("UPDATE `t` SET id = 1;", "unrecognised line"),
        ("BEGIN; DELETE FROM `t`;", "unrecognised line"),
    ],
)
def test_what_is_not_understood_fails(source, work, line, problem):
    open(f"{work}/t.sql", "w").write(f"CREATE TABLE `t` (`id` BIGINT, `t` TEXT);\nINSERT INTO `t` VALUES (1,'a');\n{line}\n")
    with pytest.raises(Exception, match=problem):
        source(f"{work}/t.sql").collect()


def test_no_rows_no_files_and_given_ddl(source, work):
    open(f"{work}/t.sql", "w").write("CREATE TABLE `t` (`id` BIGINT);\n")
    assert source(f"{work}/t.sql").collect() == []
    open(f"{work}/r.sql", "w").write("INSERT INTO `t` (`id`) VALUES (1), (2) ;\n")
    with pytest.raises(Exception, match="give it by the option ddl"):
        source(f"{work}/r.sql").collect()
    assert [r.id for r in source(f"{work}/r.sql", ddl="CREATE TABLE `t` (`id` INT);").collect()] == [1, 2]
