"""Dump text (plain or gzip) to typed rows.

Everything from the text scan to the typed columns is narrow: no shuffle, no
Python (which only gathers the DDL). A plain file splits by lines, since newlines inside values are escaped;
a gzip file is one task, which is why the writer makes many parts per table.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tablehaul.functions.sqltext import is_null_token, value_of
from tablehaul.sources.ddl import parse_create_table
from tablehaul.sources.indexed_gzip import SPLIT_BYTES, indexed_lines, read_blocks

_NAME = r"(?:`(?:[^`]++|``)++`|[^\s(`.]++)"
_COLUMNS = r"\((?:[^`()]++|`(?:[^`]++|``)*+`)*+\)"
# The start of a row statement; groups: table name, column list. One that names a database besides is not understood here.
INSERT_HEAD = (
    rf"(?is)^\s*(?:INSERT|REPLACE)\s+(?:IGNORE\s+)?INTO\s+({_NAME})\s*({_COLUMNS})?\s*VALUES?\s*"
)
# One row in parentheses, and one field of it. Possessive, so a long line is
# walked once and without recursion.
TUPLE = r"(?s)\([^'()]*+(?:'[^'\\]*+(?:\\.[^'\\]*+)*+'[^'()]*+)*+\)"
FIELD = r"(?s)[^',()\s]++|'(?:[^'\\]++|\\.|'')*+'"
BINARY_FIELD = r"(?s)(?:_binary\s+)?'(?:[^'\\]++|\\.|'')*+'|[^',()\s]++"
# A row in which every comma separates: bare tokens without spaces, and strings
# without commas (a doubled quote reads as two strings side by side).
PLAIN_ROW = r"^\((?:(?:[^',()\s]++|(?:'[^',]*+')++)(?:,(?!\)\z)|(?=\)\z)))*+\)\z"
# A row that continues a statement begun on an earlier line.
TUPLE_LINE = r"(?i)^\s*\((?!\s*PARTITION\b)"
# Lines that carry no rows: comments, DDL and session statements.
OTHER_LINE = (
    r"(?i)^\s*(?:$|--|#|/\*|\*/|`|\)|;|"
    r"(?:DROP|CREATE|ALTER|LOCK|UNLOCK|USE|SET|DELIMITER|START|COMMIT|BEGIN|"
    r"PRIMARY|UNIQUE|KEY|INDEX|CONSTRAINT|FULLTEXT|SPATIAL|FOREIGN|CHECK|PARTITION|\(PARTITION)\b|"
    r"\w+\s+(?:tiny|small|medium|big|long|var)?"
    r"(?:int|integer|text|blob|char|binary|float|double|decimal|numeric|date|datetime|timestamp|time|year|json|enum|set|bit|bool|boolean)\b)"
)

# A line of another kind in which rows begin or are changed all the same, or a column is; such dumps need a scan of statements.
HIDDEN_ROWS = (
    r"(?i)^(?!\s*(?:--|#))(?:.*(?:;|\*/|/\*M?!\d*)\s*(?:INSERT|REPLACE|UPDATE|DELETE|TRUNCATE)\b"
    r"|\s*ALTER\s+TABLE\s+\S+\s+(?!(?:DISABLE|ENABLE)\s+KEYS))"
)
# A line that begins (or may begin) a CREATE TABLE statement, one that ends a statement, one with which rows begin.
CREATE_LINE = r"(?i)^[ \t]*CREATE(?:\s*$|\s+TABLE\b)"
END_LINE = re.compile(rb";[ \t\r]*$")
ROWS_LINE = r"(?i)^\s*(?:INSERT|REPLACE)\s+(?:IGNORE\s+)?INTO\b"
ROWS_MARK = b"INSERT INTO"

PROBLEM_LINE = "unrecognised line"
PROBLEM_BYTES = "not UTF-8 text, or a raw NUL"
PROBLEM_TUPLES = "text between the rows was not understood"
PROBLEM_TABLE = "a row statement of a table that the dump does not create"
PROBLEM_COLUMNS = "column list differs from the table"
PROBLEM_FIELDS = "number of fields differs from the table"
PROBLEM_VALUE = "a value does not fit column"


def read_lines(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """Lines of dump files with the file they came from."""
    return spark.read.text(path).select("value", F.col("_metadata.file_path").alias("_file"))


def _gather(wanted: set[tuple[str, int]] | None = None):
    """The lines of each ``CREATE TABLE`` statement as one text. A statement that is open at its split's end comes
    with the file and where the next split starts; with ``wanted`` only what continues such statements is gathered, from
    the start of those splits. Nothing but the open statement is held.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at = parts = None  # the split being read, lines of its open statement

        def row(still_open: bool) -> dict:
            file, start, length, size = at
            text = "\n".join(parts)
            if still_open or wanted:
                return {"text": text, "open": still_open, "file": file, "start": start, "length": length, "size": size}
            return {"text": text, "open": False, "file": None, "start": None, "length": None, "size": None}

        def out(rows: list[dict]) -> pa.RecordBatch:
            return pa.RecordBatch.from_pylist(rows, schema=shape)

        whole = [(n, pa.int64()) for n in ("start", "length", "size")]
        shape = pa.schema([("text", pa.string()), ("open", pa.bool_()), ("file", pa.string()), *whole])
        for batch in batches:
            begins = pc.match_substring_regex(batch.column(0), CREATE_LINE)
            if parts is None and not wanted and not pc.any(begins).as_py():
                continue
            rows = []
            splits = zip(*(batch.column(i).to_pylist() for i in range(1, 5)))
            for value, begin, split in zip(batch.column(0), begins.to_pylist(), splits):
                if split != at:
                    if parts is not None:
                        rows.append(row(True))
                    at, parts = split, [] if wanted and split[:2] in wanted else None
                if parts is None:
                    if wanted or not begin:
                        continue
                    parts = []
                line = value.as_py()
                rows_begin = line == ROWS_MARK
                if not rows_begin:
                    parts.append(line.decode("utf-8", "replace"))
                if rows_begin or END_LINE.search(line):
                    rows.append(row(False))
                    parts = None
            if rows:
                yield out(rows)
        if parts is not None:
            yield out([row(True)])

    return run


_PLACES = ("file_path", "file_block_start", "file_block_length", "file_size")


def _placed_lines(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """Lines with their split; files split as they do when rows are read."""
    lines = spark.read.option("recursiveFileLookup", "true").text(path)
    return lines.select("value", *(F.col(f"_metadata.{c}") for c in _PLACES))


def _create_texts(lines: DataFrame) -> list[str]:
    """Texts of the ``CREATE TABLE`` statements, read by lines."""
    value = F.when(F.col("value").rlike(ROWS_LINE), ROWS_MARK.decode()).otherwise(F.col("value"))
    lines = lines.select(value.cast("binary").alias("value"), *_PLACES)
    shape = "text string, open boolean, file string, start long, length long, size long"
    texts, cut = [], {}

    def place(text: str, row) -> None:
        following = row.start + row.length if row.open else None
        if following is not None and following < row.size:
            cut[row.file, following] = (text, row.length, row.size)
        else:
            texts.append(text)

    for row in lines.mapInArrow(_gather(), shape).distinct().collect():
        place(row.text, row)
    # Statements over the end of a split go on in the next that has a line of its own.
    while cut:
        waiting, cut = cut, {}
        near = lines.where(F.col("file_path").isin(sorted({file for file, _ in waiting})))
        found = {(row.file, row.start): row for row in near.mapInArrow(_gather(set(waiting)), shape).collect()}
        for (file, start), (text, length, size) in waiting.items():
            row = found.get((file, start))
            if row is not None:
                place(f"{text}\n{row.text}", row)
            elif start + length < size:
                cut[file, start + length] = (text, length, size)
            else:
                texts.append(text)
    return texts


def read_schemas(spark: SparkSession, path: str | list[str]) -> dict[str, T.StructType]:
    """Schemas of all tables a dump creates, wherever in its files the statements stand.

    Only the text of ``CREATE TABLE`` statements reaches the driver, and no record is longer than a line.
    """
    return _schemas(_placed_lines(spark, path), path)


def _schemas(lines: DataFrame, path: str | list[str]) -> dict[str, T.StructType]:
    schemas: dict[str, T.StructType] = {}
    for text in _create_texts(lines):
        begin = re.search(r"(?im)^[ \t]*CREATE\s+TABLE\b", text)
        if begin is None:
            continue
        name, schema = parse_create_table(text[begin.start() :])
        if schemas.setdefault(name, schema) != schema:
            raise ValueError(f"{path} creates table {name} in two ways")
    return schemas


def read_schema(spark: SparkSession, path: str | list[str], table: str | None = None) -> tuple[str, T.StructType]:
    """Name and schema of the table a dump creates; ``table`` picks one of several."""
    return _choose(read_schemas(spark, path), path, table)


def _choose(schemas: dict[str, T.StructType], path: str | list[str], table: str | None) -> tuple[str, T.StructType]:
    if table is not None:
        if table not in schemas:
            raise ValueError(f"no CREATE TABLE for {table} in {path}")
        return table, schemas[table]
    if not schemas:
        raise ValueError(f"no CREATE TABLE in {path}")
    if len(schemas) > 1:
        raise ValueError(f"{path} holds several tables, name one of them: {', '.join(sorted(schemas))}")
    return next(iter(schemas.items()))


def _kinds(lines: DataFrame, table: str | None, others: tuple[str, ...] | None) -> DataFrame:
    """Lines that carry rows, or that are not understood, cut into row texts.

    ``others`` are tables whose row statements are passed over; those of any further table are a problem.
    """
    value = F.col("value")
    kind = (
        F.when(value.rlike(INSERT_HEAD), "insert")
        .when(value.rlike(TUPLE_LINE), "tuple")
        .when(value.rlike(OTHER_LINE) & ~value.rlike(HIDDEN_ROWS), "other")
        .otherwise("unknown")
    )
    marked = lines.withColumn("_kind", kind).where(F.col("_kind") != "other")
    insert = F.col("_kind") == "insert"
    if table is not None:
        name = F.replace(F.btrim(F.regexp_extract(value, INSERT_HEAD, 1), F.lit("`")), F.lit("``"), F.lit("`"))
        if others is None:
            marked = marked.where(~insert | (name == table))
        elif others:
            marked = marked.where(~insert | ~name.isin(*others))
        marked = marked.withColumn("_kind", F.when(insert & (name != table), "foreign").otherwise(F.col("_kind")))
    # an absent column list extracts as the empty string
    columns = F.when(insert, F.regexp_extract(value, INSERT_HEAD, 2)).otherwise("")
    body = F.when(insert, F.regexp_replace(value, INSERT_HEAD, "")).otherwise(value)
    return marked.select("_file", "value", "_kind", columns.alias("_columns"), body.alias("_body"))


def _lists_all(columns: Column, schema: T.StructType) -> Column:
    """No column list, or one naming the table's columns in the table's order."""
    plain = F.regexp_replace(columns, r"[`\s]", "")
    listed = "(" + ",".join(f.name.replace("`", "").replace(" ", "") for f in schema.fields) + ")"
    return (columns == "") | (F.lower(plain) == listed.lower())


def _fields(text: Column, schema: T.StructType) -> Column:
    """The raw tokens of a row in parentheses; wrong in number if the row is damaged.

    Most rows hold no escapes and no commas inside strings. One match proves that,
    and cutting such a row at every comma is much cheaper than matching its
    tokens one by one.
    """
    binary = any(isinstance(f.dataType, T.BinaryType) for f in schema.fields)
    exact = F.regexp_extract_all(text, F.lit(BINARY_FIELD if binary else FIELD), F.lit(0))
    plain = ~F.contains(text, F.lit("\\")) & text.rlike(PLAIN_ROW)
    inner = F.substring(text, F.lit(2), F.char_length(text) - 2)
    return F.when(plain, F.split(inner, ",")).otherwise(exact)


def _cut(lines: DataFrame, schema: T.StructType, table: str | None, others: tuple[str, ...] | None) -> DataFrame:
    """Each line's rows, and what is wrong with the line, if anything.

    A line is sound when its rows and the separators between them account for
    every character.
    """
    rows = _kinds(lines, table, others).withColumn("_rows", F.regexp_extract_all("_body", F.lit(TUPLE), F.lit(0)))
    whole = F.concat(F.array_join("_rows", ","), F.lit(";")) == F.col("_body")
    rest = F.regexp_replace("_body", TUPLE, "").rlike(r"^[\s,]*;?\s*$")
    problem = (
        F.when(~F.is_valid_utf8("value") | F.contains("value", F.lit("\0")), PROBLEM_BYTES)
        .when(F.col("_kind") == "unknown", PROBLEM_LINE)
        .when(F.col("_kind") == "foreign", PROBLEM_TABLE)
        .when(~whole & ~rest, PROBLEM_TUPLES)
        .when(~_lists_all(F.col("_columns"), schema), PROBLEM_COLUMNS)
    )
    if others is None or others:
        problem = F.when(F.col("_kind") == "tuple", PROBLEM_LINE).otherwise(problem)
    return rows.withColumn("_problem", problem)


def _fail(problem: Column, text: Column) -> Column:
    parts = [F.lit("dump not understood: "), problem, F.lit(" in "), F.col("_file"), F.lit(": "), F.left(text, F.lit(200))]
    return F.raise_error(F.concat(*parts))


def _token(i: int) -> str:
    return f"get(_fields, {i})"


def _lost(i: int, field: T.StructField) -> Column:
    """Fails where field ``i`` is not NULL; used where its value came out null."""
    name = re.sub(r"['\\]", "", field.name)
    failed = F.expr(
        f"CASE WHEN NOT {is_null_token(_token(i))} THEN raise_error(concat("
        f"'dump not understood: {PROBLEM_VALUE} {name} in ', _file, ': ', left({_token(i)}, 200))) END"
    )
    return failed.cast(field.dataType)


def parse_lines(
    lines: DataFrame, schema: T.StructType, table: str | None = None, others: tuple[str, ...] | None = ()
) -> DataFrame:
    """Typed rows; the job fails at the first line, row or value not understood.

    Rows and their tokens are each cut inside a generator, so no later filter or
    projection can repeat the cutting, and lines and field counts are checked
    even when only some columns are read.

    With ``table``, rows of the tables named in ``others`` (None: of any other) are passed over and rows of any
    further table fail; where there are others, a row whose statement began on an
    earlier line cannot be told apart and fails. Works on a stream as on a batch.
    """
    width = len(schema.fields)

    def full(fields: Column) -> Column:
        wrong = _fail(F.lit(PROBLEM_FIELDS), F.array_join(fields, ","))
        return F.when(F.size(fields) == width, fields).otherwise(wrong.cast("array<string>"))

    sound = F.when(F.col("_problem").isNull(), F.col("_rows")).otherwise(
        _fail(F.col("_problem"), F.col("value")).cast("array<string>")
    )
    texts = _cut(lines, schema, table, others).select("_file", F.explode(sound).alias("_text"))
    tokens = F.transform(F.array(_fields(F.col("_text"), schema)), full)
    rows = texts.select("_file", F.explode(tokens).alias("_fields"))
    columns = []
    for i, field in enumerate(schema.fields):
        value = value_of(_token(i), field.dataType, strict=True)
        columns.append(F.coalesce(value, _lost(i, field)).alias(field.name))
    return rows.select(*columns)


def find_problems(
    lines: DataFrame, schema: T.StructType, table: str | None = None, others: tuple[str, ...] | None = ()
) -> DataFrame:
    """What ``parse_lines`` would fail on: ``file``, ``problem`` and ``text``, one row each."""
    cut = _cut(lines, schema, table, others)
    bad_lines = cut.where(F.col("_problem").isNotNull()).select(
        F.col("_file").alias("file"), F.col("_problem").alias("problem"), F.col("value").alias("text")
    )
    good = F.when(F.col("_problem").isNull(), F.col("_rows"))
    texts = cut.select("_file", F.explode(good).alias("_text"))
    rows = texts.select("_file", "_text", F.explode(F.array(_fields(F.col("_text"), schema))).alias("_fields"))
    problem = F.when(F.size("_fields") != len(schema.fields), PROBLEM_FIELDS)
    for i, field in enumerate(schema.fields):
        lost = value_of(_token(i), field.dataType).isNull() & F.expr(f"NOT {is_null_token(_token(i))}")
        problem = F.coalesce(problem, F.when(lost, f"{PROBLEM_VALUE} {field.name}"))
    bad_values = rows.select(
        F.col("_file").alias("file"), problem.alias("problem"), F.col("_text").alias("text")
    ).where(F.col("problem").isNotNull())
    return bad_lines.unionAll(bad_values)


def read_dump(
    spark: SparkSession,
    path: str | list[str],
    schema: T.StructType | None = None,
    table: str | None = None,
    spread: int | None = None,
    schemas: dict[str, T.StructType] | None = None,
) -> DataFrame:
    """Rows of a dump's only table, or of ``table``; fails rather than lose, misread or mix any.

    ``schemas`` are what ``read_schemas`` gave for this path, if that is known already: finding them reads the whole text.

    A gzip file is read by one task. Where a dump has fewer files than the
    cluster has cores, ``spread`` deals its lines out to that many tasks before
    they are parsed, since parsing costs far more than moving the text.
    """
    others: tuple[str, ...] | None = ()
    if schema is None:
        schemas = read_schemas(spark, path) if schemas is None else schemas
        table, schema = _choose(schemas, path, table)
        others = tuple(sorted(set(schemas) - {table}))
    elif table is not None:
        others = None
    lines = read_lines(spark, path)
    if spread:
        lines = lines.repartition(spread)
    return parse_lines(lines, schema, table, others)


def read_indexed_dump(
    spark: SparkSession,
    path: str,
    schema: T.StructType | None = None,
    table: str | None = None,
    blocks: DataFrame | None = None,
    split_bytes: int = SPLIT_BYTES,
) -> DataFrame:
    """As ``read_dump``, for a gzip dump with an index: a task for about ``split_bytes``, however few the files.

    ``blocks`` is the index of files that have none beside them (``find_blocks``).
    """
    found = indexed_lines(read_blocks(spark, path) if blocks is None else blocks, split_bytes)
    lines = found.withColumn("value", F.col("value").cast("string"))
    others: tuple[str, ...] | None = ()
    if schema is None:
        schemas = _schemas(lines, path)
        table, schema = _choose(schemas, path, table)
        others = tuple(sorted(set(schemas) - {table}))
    elif table is not None:
        others = None
    return parse_lines(lines.select("value", F.col("file_path").alias("_file")), schema, table, others)
