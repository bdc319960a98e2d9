"""Helpers the operators share: intermediate tables, column choice, label joins."""

from __future__ import annotations

import sys
import types
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tablehaul.session import fresh_dir

#: Text handled at once inside a task: batches are cut so that arrays stay small.
SLICE_BYTES = 1 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def stored(df: DataFrame, label: str) -> DataFrame:
    """``df`` written to the shared folder and read back: lineage ends there, so a
    lost executor costs tasks of later steps only."""
    spark = df.sparkSession
    path = fresh_dir(spark, label)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def id_and_text(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """Only the two columns an operator works on, under names of its own."""
    return docs.select(docs[id_col].cast("long").alias("doc_id"), F.coalesce(docs[text_col], F.lit("")).alias("text"))


def id_remainder(id_column: Column, modulus: int) -> Column:
    """crc32 of the id as text, modulo: the split between learning and holding out."""
    return F.crc32(F.coalesce(id_column.cast("string"), F.lit("")).cast("binary")) % modulus


def worker_cache() -> dict:
    """What a Python worker keeps from task to task. (Task code is shipped by value, so its own globals are new each time.)"""
    return sys.modules.setdefault("_tablehaul_worker_cache", types.ModuleType("_tablehaul_worker_cache")).__dict__


def map_slices(
    df: DataFrame,
    work: Callable[[pa.RecordBatch], pa.RecordBatch | None],
    schema: str,
    size_column: str = "text",
    slice_bytes: int = SLICE_BYTES,
) -> DataFrame:
    """``work`` over Arrow batches cut so that their texts stay near ``slice_bytes``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for piece in slices(batch, size_column, slice_bytes):
                out = work(piece)
                if out is not None and out.num_rows:
                    yield out

    return df.mapInArrow(run, schema)


def slices(batch: pa.RecordBatch, size_column: str, slice_bytes: int) -> Iterator[pa.RecordBatch]:
    import pyarrow.compute as pc

    sizes = pc.fill_null(pc.binary_length(batch.column(size_column)), 0).to_pylist()
    start = held = 0
    for i, size in enumerate(sizes):
        if i > start and held + size > slice_bytes:
            yield batch.slice(start, i - start)
            start, held = i, 0
        held += size
    if batch.num_rows > start:
        yield batch.slice(start)
