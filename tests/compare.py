"""Compare a query with its SQL, values and column names, row order aside."""

from __future__ import annotations

import math

import duckdb

from tablehaul.queries.views import TABLES


def connect(sf_dir: str):
    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{sf_dir}/{name}.parquet')")
    return con


def _plain(value):
    if isinstance(value, float):
        return "nan" if math.isnan(value) else repr(value)
    if isinstance(value, (list, tuple)):
        return [_plain(v) for v in value]
    return value


def _rows(table) -> list[str]:
    names = sorted(table.column_names)
    columns = [table.column(n).to_pylist() for n in names]
    return sorted(repr([_plain(v) for v in row]) for row in zip(*columns))


def difference(df, con, sql: str) -> str | None:
    ours = df.toArrow()
    theirs = con.execute(sql).to_arrow_table()
    if sorted(ours.column_names) != sorted(theirs.column_names):
        return f"columns {sorted(ours.column_names)} / {sorted(theirs.column_names)}"
    a, b = _rows(ours), _rows(theirs)
    if a == b:
        return None
    only_a, only_b = sorted(set(a) - set(b))[:3], sorted(set(b) - set(a))[:3]
    return f"rows {len(a)} / {len(b)}; ours only {str(only_a)[:600]}; sql only {str(only_b)[:600]}"
