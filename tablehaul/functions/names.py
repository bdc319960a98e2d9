"""File, database and output names."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed value: what counts as a dump file. Case is ignored; a bare ``.gz`` is
# not one, nor is an ending without a stem.
DUMP_FILE = r"(?i)[^/]\.sql(\.gz)?$"


# The text before the first ``__``, or else before the first of several dots (a
# closing ``.gz`` not counted), where that text is not empty.
DATABASE_IN_NAME = r"(?is)^(?:(?:(?!__).)+(?=__)|[^.]+(?=\..*\.(?!gz\z)))"


def base_name(path: Column) -> Column:
    """The last segment of a path, ignoring trailing slashes."""
    return F.substring_index(F.rtrim(path, F.lit("/")), "/", -1)


def size_mb(size_bytes: Column) -> Column:
    return size_bytes / F.lit(1048576.0)


def guess_database(file_name: Column) -> Column:
    """``db__table.sql`` or ``db.table.sql`` names its database; other names give null.

    One pattern rather than several string functions: the name is often itself a
    long expression, and every mention of it would be computed again in a filter.
    """
    return F.regexp_substr(file_name, F.lit(DATABASE_IN_NAME))


def comma_list(text: str) -> list[str]:
    """A user's comma list, each name trimmed; a trailing comma gives an empty name."""
    return [part.strip() for part in text.split(",")]


def output_name(database: Column, table: Column, single_database: bool, compress: bool) -> Column:
    ending = F.lit(".sql.gz" if compress else ".sql")
    if single_database:
        return F.concat(table, ending)
    return F.concat(database, F.lit("__"), table, ending)


def import_log_name(database: Column, file_name: Column) -> Column:
    return F.concat(database, F.lit("__"), file_name, F.lit(".err.log"))


def export_log_name(database: Column, table: Column) -> Column:
    return F.concat(database, F.lit("__"), table, F.lit(".export.err.log"))
