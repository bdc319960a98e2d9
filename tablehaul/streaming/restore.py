"""Restore dump files as they arrive; the checkpoint remembers what is done."""

from __future__ import annotations

from pyspark.sql import SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tablehaul.sources.dump_reader import parse_lines


def restore_new_files(
    spark: SparkSession,
    folder: str,
    schema: T.StructType,
    target: str,
    checkpoint: str,
    table: str,
    files_per_batch: int = 1000,
) -> None:
    """Restore files not seen before into Parquet at ``target``, then stop.

    Each file is restored once, across any number of calls with one checkpoint.
    A damaged file fails its batch, which leaves nothing behind; so does a row statement of a table other than ``table``.
    """
    lines = (
        spark.readStream.option("recursiveFileLookup", "true")
        .option("maxFilesPerTrigger", files_per_batch)
        .text(folder)
        .select("value", F.col("_metadata.file_path").alias("_file"))
    )
    query = (
        parse_lines(lines, schema, table)
        .writeStream.format("parquet")
        .option("path", target)
        .option("checkpointLocation", checkpoint)
        .outputMode("append")
        .trigger(availableNow=True)
        .start()
    )
    query.awaitTermination()
