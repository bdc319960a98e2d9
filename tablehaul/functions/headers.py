"""What a line of a dump's header says about its database."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Patterns that name a database, in the order they are tried.
COMMENT_DATABASE = r"""(?iU)(?:current\s+)?database:\s*[`'"]?([^\s`'";]+)[`'"]?"""
USE_DATABASE = r"""(?iU)^\s*USE\s+[`'"]?([^\s`'";]+)[`'"]?\s*;?"""
CREATE_DATABASE = (
    r"""(?iU)^\s*CREATE\s+DATABASE(?:\s+/\*!.*?\*/)?(?:\s+IF\s+NOT\s+EXISTS)?\s+[`'"]?([^\s`'";]+)[`'"]?"""
)
# Line starts (case matters) that end the header.
HEADER_ENDS = ["CREATE TABLE", "INSERT INTO", "LOCK TABLES"]


# The characters Unicode counts as white space.
WHITE_SPACE = (
    "\t\n\x0b\x0c\r \x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a"
    "\u2028\u2029\u202f\u205f\u3000"
)


def _trimmed(line: Column) -> Column:
    return F.btrim(line, F.lit(WHITE_SPACE))


def ends_header(line: Column) -> Column:
    trimmed = _trimmed(line)
    first, *others = [F.startswith(trimmed, F.lit(start)) for start in HEADER_ENDS]
    for other in others:
        first = first | other
    return first


def named_database(line: Column) -> Column:
    """The database a header line names, or null.

    A pattern is tried only where its keyword stands, as most lines name nothing.
    """
    trimmed = _trimmed(line)
    low = F.lower(trimmed)
    worth_trying = [
        (F.contains(low, F.lit("database:")), COMMENT_DATABASE),
        (F.startswith(low, F.lit("use")), USE_DATABASE),
        (F.startswith(low, F.lit("create")), CREATE_DATABASE),
    ]
    found = [F.when(c, F.nullif(F.regexp_extract(trimmed, p, 1), F.lit(""))) for c, p in worth_trying]
    return F.coalesce(*found)
