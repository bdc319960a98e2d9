"""Values as SQL literals and back, with built-in functions only."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Backslash escapes of the MySQL string literal, in the order in
# which they are applied (the backslash itself first).
ESCAPES = [
    ("\\", "\\\\"),
    ("'", "\\'"),
    ("\n", "\\n"),
    ("\r", "\\r"),
    ("\0", "\\0"),
    ("\x1a", "\\Z"),
]

# Escapes understood on the way back, besides the doubled
# backslash, the NUL escape and the two that keep their backslash.
COMMON_UNESCAPES = [
    ("''", "'"),
    ("\\'", "'"),
    ('\\"', '"'),
    ("\\n", "\n"),
]
RARE_UNESCAPES = [
    ("\\r", "\r"),
    ("\\t", "\t"),
    ("\\b", "\b"),
    ("\\Z", "\x1a"),
]
# A backslash that starts no common escape (or is the second of two).
RARE = r"""\\[^\\n'"]"""
KEPT = ["\\%", "\\_"]

# Nested values travel as JSON; these options keep nulls, microseconds and
# non-finite numbers.
JSON_OPTIONS = {
    "ignoreNullFields": "false",
    "timestampFormat": "yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX",
    "timestampNTZFormat": "yyyy-MM-dd'T'HH:mm:ss.SSSSSS",
}

NESTED = (T.ArrayType, T.MapType, T.StructType)
UNSUPPORTED = (
    T.DayTimeIntervalType,
    T.YearMonthIntervalType,
    T.CalendarIntervalType,
    T.NullType,
    T.VariantType,
    T.UserDefinedType,
)


def quote_identifier(name: str) -> str:
    return "`" + name.replace("`", "``") + "`"


def quote_text(text: str) -> str:
    """A Python string as a MySQL string literal (for DDL comments)."""
    return "'" + reduce(lambda s, e: s.replace(*e), ESCAPES, text) + "'"


def double_quotes(column: Column) -> Column:
    """``'`` becomes ``''``: the plain-SQL form for a value inside quotes."""
    return F.replace(column, F.lit("'"), F.lit("''"))


def escape(column: Column) -> Column:
    return reduce(lambda c, e: F.replace(c, F.lit(e[0]), F.lit(e[1])), ESCAPES, column)


def quoted(column: Column) -> Column:
    return F.concat(F.lit("'"), escape(column), F.lit("'"))


def unescape(column: Column) -> Column:
    """Undo backslash escapes and doubled quotes of a literal's inside.

    Dump text holds no NUL (it is written as an escape), so NUL marks can stand
    in for what must survive until the end: doubled backslashes first, after
    which every backslash starts an escape of its own. Any escape not listed
    stands for its character. In a run of quotes only the first can belong to a
    backslash, so folding pairs first is safe.

    The chain runs inside a lambda, which is evaluated apart: written out for
    every text column it would make the generated method too long to be
    compiled, and most values have no backslash.
    """
    mark, mark_back = ("\\\\", "\0B"), ("\0B", "\\")
    common = [mark, *COMMON_UNESCAPES, mark_back]
    every = [
        mark,
        *COMMON_UNESCAPES,
        *RARE_UNESCAPES,
        ("\\0", "\0" + "0"),
        *[(kept, f"\0{kept[1]}") for kept in KEPT],
        ("\\", ""),
        *[(f"\0{kept[1]}", kept) for kept in KEPT],
        mark_back,
        ("\0" + "0", "\0"),
    ]

    def undo(text: Column) -> Column:
        with_all, with_common = (
            reduce(lambda c, e: F.replace(c, F.lit(e[0]), F.lit(e[1])), steps, text) for steps in (every, common)
        )
        return F.when(text.rlike(RARE), with_all).otherwise(with_common)

    whole = F.get(F.transform(F.array(column), undo), 0)
    return F.when(F.contains(column, F.lit("\\")), whole).otherwise(F.replace(column, F.lit("''"), F.lit("'")))


def is_null_token(raw: str) -> str:
    """The bare word NULL; the length test spares most tokens the upper-casing."""
    return f"(octet_length({raw}) = 4 AND upper({raw}) = 'NULL')"


def _bare(raw: str) -> str:
    """The text of a token that can hold no escapes, such as a number or a date."""
    return f"CASE WHEN startswith({raw}, chr(39)) THEN substring({raw}, 2, char_length({raw}) - 2) ELSE {raw} END"


def _inside(raw: Column) -> Column:
    return F.substring(raw, F.lit(2), F.char_length(raw) - 2)


def unquoted(raw: Column) -> Column:
    """The text of a token: a quoted one is unescaped, a bare number stays, a bare word is null."""
    number = F.when(raw.rlike(r"^[-+.0-9]"), raw)
    return F.when(F.startswith(raw, F.lit("'")), unescape(_inside(raw))).otherwise(number)


def _utc_text(column: Column) -> Column:
    """An instant as UTC wall-clock text, whatever the session time zone is."""
    seconds = F.unix_micros(column).cast("decimal(20,0)") / F.lit(1000000).cast("decimal(7,0)")
    epoch = F.lit("1970-01-01 00:00:00").cast("timestamp_ntz")
    return (epoch + F.make_dt_interval(secs=seconds.cast("decimal(18,6)"))).cast("string")


def literal(column: Column, dtype: T.DataType, name: str = "value") -> Column:
    """One value as the literal that stands for it in an ``INSERT``."""
    if isinstance(dtype, UNSUPPORTED):
        raise TypeError(f"column {name}: {dtype.simpleString()} cannot be dumped")
    if isinstance(dtype, T.BooleanType):
        text = F.when(column, "1").otherwise("0")
    elif isinstance(dtype, (T.FloatType, T.DoubleType)):
        finite = ~(F.isnan(column) | (F.abs(column) == float("inf")))
        text = F.when(finite, column.cast("string")).otherwise(
            F.raise_error(F.lit(f"column {name}: NaN or infinity has no SQL literal"))
        )
    elif isinstance(dtype, T.NumericType):
        text = column.cast("string")
    elif isinstance(dtype, T.TimestampType):
        text = F.concat(F.lit("'"), _utc_text(column), F.lit("'"))
    elif isinstance(dtype, (T.DateType, T.TimestampNTZType, T.TimeType)):
        text = F.concat(F.lit("'"), column.cast("string"), F.lit("'"))
    elif isinstance(dtype, T.BinaryType):
        text = F.when(F.octet_length(column) > 0, F.concat(F.lit("0x"), F.hex(column))).otherwise("''")
    elif isinstance(dtype, NESTED):
        text = quoted(F.to_json(column, JSON_OPTIONS))
    elif isinstance(dtype, T.StringType) or dtype.typeName() in ("char", "varchar"):
        text = quoted(column)
    else:
        raise TypeError(f"column {name}: {dtype.simpleString()} cannot be dumped")
    return F.when(column.isNull(), "NULL").otherwise(text)


def value_of(raw: str, dtype: T.DataType, strict: bool = False) -> Column:
    """The value of a token; null when it is ``NULL`` or unreadable.

    ``raw`` is the token as SQL text, and plain types stay SQL text: putting a
    wide table's expressions together call by call takes longer than reading it.
    ``strict`` makes unreadable JSON fail, which could otherwise come back as a
    struct of nulls.
    """
    kind = dtype.simpleString()
    plain = None
    if isinstance(dtype, T.BooleanType):
        plain = f"try_cast({_bare(raw)} AS bigint) <> 0"
    elif isinstance(dtype, (T.NumericType, T.DateType, T.TimestampNTZType, T.TimeType)):
        plain = f"try_cast({_bare(raw)} AS {kind})"
    elif isinstance(dtype, T.TimestampType):
        plain = f"try_cast(concat({_bare(raw)}, '+00:00') AS {kind})"
    if plain is not None:
        return F.expr(f"CASE WHEN {is_null_token(raw)} THEN NULL ELSE {plain} END")
    token = F.expr(raw)
    if isinstance(dtype, T.BinaryType):
        hexed = F.unhex(F.substring(token, F.lit(3), F.char_length(token)))
        text = F.regexp_replace(token, r"(?i)^_binary\s+", "")
        value = F.when(F.startswith(F.lower(F.substring(token, 1, 2)), F.lit("0x")), hexed).otherwise(
            F.encode(unquoted(text), "UTF-8")
        )
    elif isinstance(dtype, NESTED):
        options = {**JSON_OPTIONS, "mode": "FAILFAST" if strict else "PERMISSIVE"}
        value = F.from_json(unquoted(token), dtype, options)
    else:
        value = unquoted(token)
    return F.when(F.expr(is_null_token(raw)), F.lit(None)).otherwise(value)
