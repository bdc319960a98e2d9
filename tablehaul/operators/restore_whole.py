"""Whole dumps to tables in one scan, whatever tables, databases and forms of statements their files mix.

Every statement is routed by (database, table) in one pass over the text: row statements are cut into rows of raw
tokens by built-in functions and staged in one partitioned write, with the few other statements beside them. The number of jobs
does not depend on the number of tables. A table's rows are typed when they are read, by the ``CREATE TABLE`` that was met in the
same pass; only its text reaches the driver.

Nothing is dropped unseen: a statement that changes data in another way, or is not understood, is a problem, and
so are rows of a table that is not created and a table dropped after its rows. ``restore_whole`` fails then,
naming them; ``problems`` lists them. Statements that carry no rows are counted by ``passed``.

A column list may name the table's columns in any order; those it leaves out are null. Triggers, routines, events and
views have no counterpart and are passed over.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tablehaul.functions.sqltext import is_null_token, value_of
from tablehaul.session import fresh_dir, holding
from tablehaul.sources.ddl import parse_create_table
from tablehaul.sources.dump_reader import (
    BINARY_FIELD,
    PROBLEM_BYTES,
    PROBLEM_FIELDS,
    PROBLEM_TABLE,
    PROBLEM_TUPLES,
    PROBLEM_VALUE,
    TUPLE,
)
from tablehaul.sources.statements import joined, statements

_NAME = r"(?:`(?:[^`]++|``)++`|[^\s(`.;]++)"
_COLUMNS = r"\((?:[^`()]++|`(?:[^`]++|``)*+`)*+\)"
#: A row statement's beginning; groups: database, table, column list.
ROWS_HEAD = (
    r"(?is)^(?:INSERT|REPLACE)\s+(?:(?:LOW_PRIORITY|DELAYED|HIGH_PRIORITY|IGNORE)\s+)*+(?:INTO\s+)?"
    rf"(?:({_NAME})\s*\.\s*)?({_NAME})\s*({_COLUMNS})?\s*VALUES?\s*(?=\()"
)
#: Statements about one table's structure; groups: database, table.
CREATE_HEAD = rf"(?is)^CREATE\s+TABLE\s+(?:IF\s+NOT\s+EXISTS\s+)?(?:({_NAME})\s*\.\s*)?({_NAME})\s*\("
DROP_HEAD = rf"(?is)^(?:DROP|TRUNCATE)\s+(?:TABLE\s+)?(?:IF\s+EXISTS\s+)?(?:({_NAME})\s*\.\s*)?({_NAME})\s*(?:CASCADE|RESTRICT)?\s*$"
#: What neither makes nor changes rows or tables.
PASSED = (
    r"(?is)^(?:SET\s+(?!PASSWORD)|LOCK\s|UNLOCK\s|START\s+TRANSACTION|BEGIN\s*$|COMMIT|FLUSH\s|ANALYZE\s|SELECT\s|"
    r"(?:CREATE|ALTER|DROP)\s+(?:DATABASE|SCHEMA)\s|ALTER\s+TABLE\s+\S+\s+(?:DISABLE|ENABLE)\s+KEYS|"
    r"(?:CREATE|DROP)\s+(?:OR\s+REPLACE\s+)?(?:ALGORITHM\s*=\s*\w+\s+)?(?:DEFINER\s*=\s*\S+\s+)?(?:SQL\s+SECURITY\s+\w+\s+)?"
    r"(?:TRIGGER|PROCEDURE|FUNCTION|EVENT|VIEW)\s)"
)
PROBLEM_STATEMENT = "a statement that changes data or is not understood"
PROBLEM_UNFINISHED = "the text ends inside a string, a name or a comment"
PROBLEM_DROPPED = "a table dropped after its rows"
PROBLEM_COLUMNS = "the column list names a column twice or one the table lacks"

#: A row's first tokens have staged columns of their own, in which like values meet and pack well; ``more`` has the rest.
FIELDS = [f"field{i}" for i in range(24)]
STAGED = T.StructType()
for _column, _type in (
    ("file", T.StringType()), ("start", T.LongType()), ("no", T.LongType()), ("columns", T.ArrayType(T.StringType())), ("width", T.IntegerType()),
    *((name, T.StringType()) for name in FIELDS), ("more", T.ArrayType(T.StringType())),
    ("text", T.StringType()), ("unfinished", T.BooleanType()), ("fragment", T.LongType()),
    ("kind", T.StringType()), ("database", T.StringType()), ("table", T.StringType()),
):
    STAGED = STAGED.add(_column, _type)
#: Staged rows stand beside the dump itself, so they are packed tightly.
STAGED_FORM = {"compression": "zstd", "parquet.writer.version": "PARQUET_2_0"}
#: Tables that a task writes at a time without sorting its rows by table; beyond so many the rest are sorted.
OPEN_TABLES = {"spark.sql.maxConcurrentOutputFileWriters": "64"}


def _name(found: Column) -> Column:
    plain = F.replace(F.btrim(found, F.lit("`")), F.lit("``"), F.lit("`"))
    return F.when(found != "", plain)


def _staged(rows: DataFrame) -> DataFrame:
    """Statements as staged rows: one for each row of a row statement, one for any other statement."""
    text = F.col("text")
    bad = ~F.is_valid_utf8("text") | F.contains("text", F.lit("\0"))
    kind = (
        F.when(F.col("fragment").isNotNull(), "fragment").when(F.col("unfinished") | bad, "problem").when(text.rlike(ROWS_HEAD), "rows")
        .when(text.rlike(CREATE_HEAD), "create").when(text.rlike(DROP_HEAD), "drop").when(text.rlike(PASSED), "passed").otherwise("problem")
    )
    rows = rows.withColumn("kind", kind)
    heads = {"rows": ROWS_HEAD, "create": CREATE_HEAD, "drop": DROP_HEAD}
    group = lambda i: F.coalesce(*(F.when(F.col("kind") == k, _name(F.regexp_extract("text", head, i))) for k, head in heads.items()))
    body = F.regexp_replace("text", ROWS_HEAD, "")
    listed = F.regexp_extract("text", ROWS_HEAD, 3)
    columns = F.transform(F.regexp_extract_all(listed, F.lit(r"`((?:[^`]|``)+)`|([^\s(),`]+)"), F.lit(0)), lambda c: F.lower(_name(c)))
    rows = rows.select(
        "file", "start", "no", "text", "kind", "unfinished", "fragment",
        F.coalesce(group(1), "database").alias("database"), group(2).alias("table"),
        F.when((F.col("kind") == "rows") & (listed != ""), columns).alias("columns"),
        F.when(F.col("kind") == "rows", F.regexp_extract_all(body, F.lit(TUPLE), F.lit(0))).alias("tuples"),
        F.when(F.col("kind") == "rows", F.regexp_replace(body, TUPLE, "").rlike(r"^[\s,]*$")).alias("sound"),
    )
    good = (F.col("kind") == "rows") & F.col("sound")
    rows = rows.withColumn("kind", F.when((F.col("kind") == "rows") & ~F.col("sound"), "tuples").otherwise(F.col("kind")))
    whole = F.array(F.lit(None).cast("string"))
    cut = rows.select("*", F.explode(F.when(good, F.col("tuples")).otherwise(whole)).alias("tuple"))
    fields = F.when(F.col("tuple").isNotNull(), F.regexp_extract_all("tuple", F.lit(BINARY_FIELD), F.lit(0)))
    cut = cut.select("*", F.explode(F.array(fields)).alias("fields"))
    made = {name: F.get("fields", F.lit(i)) for i, name in enumerate(FIELDS)}
    made["width"] = F.when(F.col("fields").isNotNull(), F.size("fields"))
    made["more"] = F.when(F.size("fields") > len(FIELDS), F.slice("fields", len(FIELDS) + 1, F.size("fields")))
    made["text"] = F.when(F.col("kind") != "rows", F.col("text"))
    return cut.select(*(made.get(f.name, F.col(f"`{f.name}`")).alias(f.name) for f in STAGED.fields))


def _fields() -> Column:
    """A staged row's tokens as ``_staged`` had them."""
    first = F.array(*FIELDS)
    return F.when(F.col("width") > len(FIELDS), F.concat(first, F.col("more"))).otherwise(F.slice(first, 1, F.col("width")))


@dataclass
class Whole:
    """A staged dump."""

    spark: SparkSession
    path: str
    tables: dict[tuple[str | None, str], T.StructType]

    def staged(self, *kinds: str) -> DataFrame:
        rows = self.spark.read.schema(STAGED).parquet(self.path)
        return rows.where(F.col("kind").isin(*kinds)) if kinds else rows

    def _rows(self, database: str | None, table: str, strict: bool) -> DataFrame:
        """Staged rows of a table with ``_fields`` in the table's order, and what is wrong with each."""
        schema = self.tables[database, table]
        names = [f.name.lower() for f in schema.fields]
        rows = self.staged("rows").where(F.col("database").eqNullSafe(database) & (F.col("table") == table)).withColumn("fields", _fields())
        of = lambda name: F.coalesce(F.get("fields", F.array_position("columns", name).cast("int") - 1), F.lit("NULL"))
        ordered = F.when(F.col("columns").isNull(), F.col("fields")).otherwise(F.array(*(of(n) for n in names)))
        width = F.when(F.col("columns").isNull(), len(names)).otherwise(F.size("columns"))
        wrong = F.when(F.size("fields") != width, PROBLEM_FIELDS)
        lists = F.col("columns").isNotNull() & (
            (F.size(F.array_except("columns", F.array(*map(F.lit, names)))) > 0) | (F.size(F.array_distinct("columns")) != F.size("columns"))
        )
        wrong = F.when(lists, PROBLEM_COLUMNS).otherwise(wrong)
        return rows.select("file", "fields", ordered.alias("_fields"), wrong.alias("problem"))

    def read(self, database: str | None, table: str) -> DataFrame:
        """Typed rows of one table; fails at a row or value that does not fit it."""
        rows = self._rows(database, table, True)
        told = F.concat(F.lit("dump not understood: "), F.col("problem"), F.lit(" in "), F.col("file"), F.lit(": "), F.left(F.array_join("fields", ","), F.lit(200)))
        sound = F.when(F.col("problem").isNull(), F.col("_fields")).otherwise(F.raise_error(told).cast("array<string>"))
        rows = rows.select("file", F.explode(F.array(sound)).alias("_fields"))
        columns = []
        for i, field in enumerate(self.tables[database, table].fields):
            token = f"get(_fields, {i})"
            where = F.concat(F.lit(f"dump not understood: {PROBLEM_VALUE} {field.name} in "), F.col("file"), F.lit(": "), F.left(F.expr(token), F.lit(200)))
            lost = F.when(F.expr(f"NOT {is_null_token(token)}"), F.raise_error(where).cast(field.dataType))
            columns.append(F.coalesce(value_of(token, field.dataType, strict=True), lost).alias(field.name))
        return rows.select(*columns)

    def _order(self) -> DataFrame:
        """Rows staged for each table, and whether a file drops it after rows of it."""
        # By split first, with whole numbers only: places as structs would have every staged row sorted.
        per_split = self.staged("rows", "drop").groupBy("file", "start", "database", "table").agg(
            F.count_if(F.col("kind") == "rows").alias("rows"),
            F.max(F.when(F.col("kind") == "drop", F.col("no"))).alias("drop"), F.min(F.when(F.col("kind") == "rows", F.col("no"))).alias("row"),
        )
        place = lambda no: F.when(F.col(no).isNotNull(), F.struct("start", no))
        per_file = per_split.groupBy("file", "database", "table").agg(
            F.sum("rows").alias("rows"), F.coalesce(F.max(place("drop")) > F.min(place("row")), F.lit(False)).alias("dropped")
        )
        return per_file.groupBy("database", "table").agg(F.sum("rows").alias("rows"), F.max("dropped").alias("dropped"))

    def problems(self) -> DataFrame:
        """What makes this dump not understood: ``file``, ``problem`` and ``text``, one row each; values are told when read."""
        told = (
            F.when(F.col("kind") == "tuples", PROBLEM_TUPLES).when(F.col("unfinished"), PROBLEM_UNFINISHED)
            .when(~F.is_valid_utf8("text") | F.contains("text", F.lit("\0")), PROBLEM_BYTES).otherwise(PROBLEM_STATEMENT)
        )
        bad = self.staged("problem", "tuples").select("file", told.alias("problem"), "text")
        name = F.concat_ws(".", "database", "table")
        known = F.array(*(F.struct(F.lit(d).cast("string"), F.lit(t)) for d, t in self.tables)) if self.tables else F.array()
        there = F.lit(False)
        if self.tables:
            there = F.array_contains(F.transform(known, lambda k: F.to_json(k)), F.to_json(F.struct(F.col("database").alias("col1"), F.col("table").alias("col2"))))
        order = self._order()
        lost = order.where((F.col("rows") > 0) & ~there).select(F.lit(None).cast("string").alias("file"), F.lit(PROBLEM_TABLE).alias("problem"), name.alias("text"))
        dropped = order.where("dropped").select(F.lit(None).cast("string").alias("file"), F.lit(PROBLEM_DROPPED).alias("problem"), name.alias("text"))
        return bad.unionByName(lost).unionByName(dropped)

    def passed(self) -> DataFrame:
        """Statements without rows, by their first two words."""
        words = F.upper(F.regexp_extract("text", r"^(\S+(?:\s+\S+)?)", 1))
        return self.staged("passed").groupBy(words.alias("statement")).agg(F.count("*").alias("n"))


def stage_whole(spark: SparkSession, path: str | list[str]) -> Whole:
    """Route a dump's statements by (database, table) into one staged table; nothing fails but text that cannot be read."""
    target = fresh_dir(spark, "whole")

    def write(rows: DataFrame) -> None:
        with holding(spark, OPEN_TABLES):
            _staged(rows).write.mode("append").partitionBy("kind", "database", "table").options(**STAGED_FORM).parquet(target)

    write(statements(spark, path))
    whole = Whole(spark, target, {})
    cut = whole.staged("fragment")
    if not cut.isEmpty():
        write(joined(cut.select("file", "start", "no", "database", "text", "fragment", "unfinished")))
    for row in whole.staged("create").select("database", "table", "text").distinct().collect():
        _, schema = parse_create_table(row.text)
        if whole.tables.setdefault((row["database"], row["table"]), schema) != schema:
            raise ValueError(f"{path} creates table {row['database']}.{row['table']} in two ways")
    return whole


def restore_whole(spark: SparkSession, path: str | list[str]) -> Whole:
    """``stage_whole``, which fails if the dump holds anything that is not understood."""
    whole = stage_whole(spark, path)
    found = whole.problems().take(5)
    if found:
        raise ValueError("dump not understood: " + "; ".join(f"{r.problem} in {r.file}: {(r.text or '')[:200]}" for r in found))
    return whole
