"""Schemas as ``CREATE TABLE`` text and back. Only schemas pass here, never rows."""

from __future__ import annotations

import json
import re

from pyspark.sql import types as T

from tablehaul.functions.sqltext import NESTED, quote_identifier, quote_text

# Column types written, by Spark type name.
MYSQL_TYPES = {
    "boolean": "TINYINT(1)",
    "tinyint": "TINYINT",
    "smallint": "SMALLINT",
    "int": "INT",
    "bigint": "BIGINT",
    "float": "FLOAT",
    "double": "DOUBLE",
    "string": "LONGTEXT",
    "date": "DATE",
    "timestamp_ntz": "DATETIME(6)",
    "timestamp": "TIMESTAMP(6)",
    "binary": "LONGBLOB",
}

# Column types read, by MySQL type word. The second entry is the
# next wider type, used for UNSIGNED.
SPARK_TYPES = {
    "tinyint": (T.ByteType(), T.ShortType()),
    "smallint": (T.ShortType(), T.IntegerType()),
    "mediumint": (T.IntegerType(), T.IntegerType()),
    "int": (T.IntegerType(), T.LongType()),
    "integer": (T.IntegerType(), T.LongType()),
    "bigint": (T.LongType(), T.DecimalType(20, 0)),
    "year": (T.ShortType(), T.ShortType()),
    "float": (T.FloatType(), T.FloatType()),
    "double": (T.DoubleType(), T.DoubleType()),
    "real": (T.DoubleType(), T.DoubleType()),
    "bool": (T.BooleanType(), T.BooleanType()),
    "boolean": (T.BooleanType(), T.BooleanType()),
    "date": (T.DateType(), T.DateType()),
    "datetime": (T.TimestampNTZType(), T.TimestampNTZType()),
    "timestamp": (T.TimestampType(), T.TimestampType()),
    "binary": (T.BinaryType(), T.BinaryType()),
    "varbinary": (T.BinaryType(), T.BinaryType()),
    "tinyblob": (T.BinaryType(), T.BinaryType()),
    "blob": (T.BinaryType(), T.BinaryType()),
    "mediumblob": (T.BinaryType(), T.BinaryType()),
    "longblob": (T.BinaryType(), T.BinaryType()),
}

# Marks a column comment that carries the exact Spark type of a JSON column.
TYPE_NOTE = "spark-type "

_QUOTED = r"'(?:[^'\\]|\\.|'')*'"
_CREATE = re.compile(
    r"CREATE\s+TABLE\s+(?:IF\s+NOT\s+EXISTS\s+)?"
    r"(?:`(?:[^`]|``)+`\.)?(?:`(?P<quoted>(?:[^`]|``)+)`|(?P<bare>[\w$]+))\s*\("
    # up to the parenthesis that closes the list of columns; options and partitions follow it
    rf"(?P<body>(?:[^()'`]|{_QUOTED}|`(?:[^`]|``)*`|\((?:[^()']|{_QUOTED}|\((?:[^()']|{_QUOTED})*\))*\))*+)\)",
    re.I | re.S,
)
_ITEM = re.compile(rf"(?:[^,()'`]|{_QUOTED}|`(?:[^`]|``)*`|\((?:[^()']|{_QUOTED}|\([^()]*\))*\))+", re.S)
_COLUMN = re.compile(
    r"\s*(?:`(?P<quoted>(?:[^`]|``)+)`|(?P<bare>[\w$]+))\s+"
    r"(?P<type>[A-Za-z]+)(?:\s*\((?P<args>[^)]*)\))?(?P<rest>.*)",
    re.S,
)
_KEY_ITEM = re.compile(r"\s*(PRIMARY|UNIQUE|KEY|INDEX|CONSTRAINT|FULLTEXT|SPATIAL|FOREIGN|CHECK)\b", re.I)


def mysql_type(dtype: T.DataType) -> str:
    if isinstance(dtype, T.DecimalType):
        return f"DECIMAL({dtype.precision},{dtype.scale})"
    if isinstance(dtype, NESTED):
        return "JSON"
    if isinstance(dtype, T.TimeType):
        return f"TIME({dtype.precision})"
    if dtype.typeName() in ("char", "varchar"):
        return dtype.simpleString().upper()
    name = dtype.simpleString()
    if name not in MYSQL_TYPES:
        raise TypeError(f"no column type for {name}")
    return MYSQL_TYPES[name]


def create_table(table: str, schema: T.StructType) -> str:
    """``DROP`` and ``CREATE TABLE`` text; JSON columns note their Spark type."""
    lines = []
    for field in schema.fields:
        parts = [f"  {quote_identifier(field.name)}", mysql_type(field.dataType)]
        if not field.nullable:
            parts.append("NOT NULL")
        if isinstance(field.dataType, NESTED):
            parts.append("COMMENT " + quote_text(TYPE_NOTE + field.dataType.json()))
        lines.append(" ".join(parts))
    name = quote_identifier(table)
    return f"DROP TABLE IF EXISTS {name};\nCREATE TABLE {name} (\n" + ",\n".join(lines) + "\n) DEFAULT CHARSET=utf8mb4;"


def _noted_type(rest: str) -> T.DataType | None:
    note = re.search(rf"COMMENT\s+({_QUOTED})", rest, re.I | re.S)
    if not note:
        return None
    text = re.sub(r"\\(.)", r"\1", note.group(1)[1:-1].replace("''", "'"))
    if not text.startswith(TYPE_NOTE):
        return None
    inner = json.loads(text[len(TYPE_NOTE) :])
    wrapped = {"type": "struct", "fields": [{"name": "v", "type": inner, "nullable": True, "metadata": {}}]}
    return T.StructType.fromJson(wrapped).fields[0].dataType


def spark_type(word: str, args: str | None, rest: str) -> T.DataType:
    word = word.lower()
    if word == "tinyint" and (args or "").strip() == "1":
        return T.BooleanType()
    if word in ("decimal", "numeric", "dec"):
        numbers = [int(x) for x in (args or "10,0").split(",")]
        return T.DecimalType(numbers[0], numbers[1] if len(numbers) > 1 else 0)
    if word == "time":
        return T.TimeType(int(args or 0))
    if word == "json":
        return _noted_type(rest) or T.StringType()
    if word in SPARK_TYPES:
        plain, wider = SPARK_TYPES[word]
        return wider if re.search(r"\bUNSIGNED\b", re.sub(_QUOTED, "", rest), re.I) else plain
    return T.StringType()


def parse_create_table(text: str) -> tuple[str, T.StructType]:
    """Table name and schema of the first ``CREATE TABLE`` in ``text``."""
    found = _CREATE.search(text)
    if not found:
        raise ValueError("no CREATE TABLE statement found")
    table = (found["quoted"] or found["bare"]).replace("``", "`")
    fields = []
    for item in _ITEM.findall(found["body"]):
        if _KEY_ITEM.match(item):
            continue
        column = _COLUMN.match(item)
        if not column:
            continue
        name = (column["quoted"] or column["bare"]).replace("``", "`")
        outside = re.sub(_QUOTED, "", column["rest"])
        fields.append(
            T.StructField(
                name,
                spark_type(column["type"], column["args"], column["rest"]),
                not re.search(r"NOT\s+NULL|PRIMARY\s+KEY", outside, re.I),
            )
        )
    if not fields:
        raise ValueError(f"no columns found in CREATE TABLE {table}")
    return table, T.StructType(fields)
