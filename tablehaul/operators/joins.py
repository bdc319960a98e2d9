"""Joins that keep a hot key from landing in one task."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SALTS = 32


def salted_join(rows: DataFrame, per_key: DataFrame, keys: list[str], spread_by: Column, salts: int = SALTS) -> DataFrame:
    """Inner join of many rows with a table that has one row per key.

    Each key's rows are dealt over ``salts`` groups by ``spread_by`` and the
    per-key row is repeated for each, so a key that holds a third of all rows is
    met by many tasks. Worth it where ``per_key`` is much smaller than ``rows``;
    when it measures small enough to broadcast, nothing is shuffled at all.
    """
    dealt = rows.withColumn("_salt", F.pmod(F.xxhash64(spread_by), F.lit(salts)).cast("int"))
    repeated = per_key.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    return dealt.join(repeated, [*keys, "_salt"]).drop("_salt")
