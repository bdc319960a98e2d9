"""Does a restored table hold the rows of its source, each as often?"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tablehaul.operators.dump_writer import row_tuple


def _weighted(df: DataFrame, weight: int) -> DataFrame:
    # equal maps may list their entries in different orders
    df = df.select(
        *(
            F.array_sort(F.map_entries(column)).alias(f.name) if isinstance(f.dataType, T.MapType) else column
            for f, column in ((f, F.col("`" + f.name.replace("`", "``") + "`")) for f in df.schema.fields)
        )
    )
    digest = F.unhex(F.sha2(row_tuple(df).cast("binary"), 256))
    return df.select(digest.alias("row_digest"), F.lit(weight).cast("bigint").alias("weight"))


def row_differences(source: DataFrame, restored: DataFrame) -> DataFrame:
    """Rows that occur more often on one side: ``row_digest, surplus``.

    ``surplus`` is positive for rows missing from the restored table. A row is
    known by the SHA-256 of its full text, so 32 bytes per row are shuffled
    rather than the row, and repeats are summed before the shuffle.
    """
    both = _weighted(source, 1).unionAll(_weighted(restored, -1))
    return both.groupBy("row_digest").agg(F.sum("weight").alias("surplus")).where(F.col("surplus") != 0)


def reconcile(source: DataFrame, restored: DataFrame) -> DataFrame:
    """One row: ``source_rows, restored_rows, missing_rows, extra_rows``."""
    weight = F.col("weight")
    both = _weighted(source, 1).unionAll(_weighted(restored, -1))
    per_row = both.groupBy("row_digest").agg(
        F.count_if(weight > 0).alias("s"), F.count_if(weight < 0).alias("r"), F.sum("weight").alias("d")
    )
    zero = F.lit(0).cast("bigint")
    return per_row.agg(
        F.coalesce(F.sum("s"), zero).alias("source_rows"),
        F.coalesce(F.sum("r"), zero).alias("restored_rows"),
        F.coalesce(F.sum(F.greatest(F.col("d"), zero)), zero).alias("missing_rows"),
        F.coalesce(F.sum(F.greatest(-F.col("d"), zero)), zero).alias("extra_rows"),
    )
