"""Tables to dump text: header, DDL and multi-row ``INSERT`` statements."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

from tablehaul.functions.sqltext import literal, quote_identifier
from tablehaul.sources.ddl import create_table
from tablehaul.sources.indexed_gzip import write_indexed_pieces

# Fixed value: default statement buffer, 1M.
NET_BUFFER_LENGTH = 1024 * 1024
#: Text that leaves a task's Python at a time.
OUT_BYTES = 1024 * 1024


def header_lines(host: str, database: str) -> list[str]:
    """Comment block that names host and database, so the target can be found again."""
    return [
        "-- Table dump",
        f"-- Host: {host}    Database: {database}",
        f"-- Current Database: {quote_identifier(database)}",
        "--",
        "",
    ]


def row_tuple(df: DataFrame) -> Column:
    """A row as the parenthesised literal list that follows ``VALUES``."""
    literals = [literal(F.col(quote_identifier(f.name)), f.dataType, f.name) for f in df.schema.fields]
    return F.concat(F.lit("("), F.concat_ws(",", *literals), F.lit(")"))


def _statements(prefix: str, header: str, buffer_bytes: int):
    """Batch function that packs row tuples into statements of ``buffer_bytes``.

    Runs per Arrow batch: running byte ends by numpy, one search per statement,
    joins by Arrow. Statements leave in batches of about a megabyte. What carries
    over between batches is a copy of the open statement, which is smaller than the
    buffer, so no batch outlives its turn.
    """

    def close(parts: list[pa.Array]) -> pa.Array:
        tuples = pa.concat_arrays(parts)
        listed = pa.ListArray.from_arrays(pa.array([0, len(tuples)], pa.int32()), tuples)
        return pc.binary_join_element_wise(pa.scalar(prefix), pc.binary_join(listed, ","), pa.scalar(";"), "")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts: list[pa.Array] = []
        used = 0
        out: list[pa.Array] = []
        held = 0
        started = False

        def told() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.concat_arrays(out)], ["value"])

        for batch in batches:
            tuples = batch.column(0)
            del batch
            if not len(tuples):
                continue
            if not started:
                out.append(pa.array([header], pa.string()))
            started = True
            ends = np.cumsum(pc.binary_length(tuples).to_numpy(zero_copy_only=False).astype(np.int64) + 1)
            first = 0
            while first < len(tuples):
                base = int(ends[first - 1]) if first else 0
                room = buffer_bytes - len(prefix) - used
                last = int(np.searchsorted(ends, base + room, side="right"))
                if last == first and not parts:
                    last = first + 1  # a row larger than the buffer stands alone
                if last > first:
                    parts.append(tuples.slice(first, last - first))
                    used += int(ends[last - 1]) - base
                if last < len(tuples):
                    out.append(close(parts))
                    held += used
                    parts, used = [], 0
                    if held >= OUT_BYTES:
                        yield told()
                        out, held = [], 0
                first = last
            if parts:
                parts[-1] = parts[-1].take(pa.array(np.arange(len(parts[-1]))))
            del tuples
            if out:
                yield told()
                out, held = [], 0
        if parts:
            out.append(close(parts))
            yield told()
        parts.clear()
        out.clear()
        pa.default_memory_pool().release_unused()  # the worker waits for other tasks

    return run


def insert_statements(
    df: DataFrame, table: str, buffer_bytes: int = NET_BUFFER_LENGTH, header: str | None = None
) -> DataFrame:
    """``INSERT`` statements of at most ``buffer_bytes`` bytes each, one per line.

    Narrow: each partition packs its own rows in the order it has them, so a
    table of any size is rendered without a shuffle, and a hot key cannot matter.
    """
    tuples, run = packing(df, table, buffer_bytes, header)
    return tuples.mapInArrow(run, "value string")


def packing(df: DataFrame, table: str, buffer_bytes: int, header: str | None = None):
    """Row tuples, and the batch function that makes statements of them."""
    prefix = f"INSERT INTO {quote_identifier(table)} VALUES "
    tuples = df.select(row_tuple(df).alias("value"))
    run = _statements(prefix, header, buffer_bytes)
    return tuples, run if header is not None else _without_first(run)


def _without_first(run):
    def body(batches):
        first = True
        for batch in run(batches):
            if first:
                batch, first = batch.slice(1), False
            if len(batch):
                yield batch

    return body


def dump_text(
    df: DataFrame,
    database: str,
    table: str,
    host: str = "localhost",
    structure: bool = True,
    rows: bool = True,
    buffer_bytes: int = NET_BUFFER_LENGTH,
) -> DataFrame:
    """The text of a dump. The first partition holds the structure, the rest rows.

    Every part begins with the header, but only the first drops and creates the
    table: feeding the parts to a client in name order keeps all rows.
    """
    pieces = [made if run is None else made.mapInArrow(run, "value string") for made, run in _pieces(df, database, table, host, structure, rows, buffer_bytes)]
    return pieces[0] if len(pieces) == 1 else pieces[0].unionAll(pieces[1])


def _pieces(
    df: DataFrame,
    database: str,
    table: str,
    host: str = "localhost",
    structure: bool = True,
    rows: bool = True,
    buffer_bytes: int = NET_BUFFER_LENGTH,
) -> list[tuple]:
    """The pieces of a dump's text, each with the batch function that makes lines of it, if any."""
    spark = df.sparkSession
    header = "\n".join(header_lines(host, database))
    pieces = []
    first = header + ("\n" + create_table(table, df.schema) if structure else "")
    pieces.append((spark.range(0, 1, 1, 1).select(F.lit(first).alias("value")), None))
    if rows:
        pieces.append(packing(df, table, buffer_bytes, header))
    return pieces


def dump_name(table: str, database: str | None = None, compress: bool = False) -> str:
    """``table.sql``, or ``database__table.sql`` when several databases share a folder."""
    stem = table if database is None else f"{database}__{table}"
    return stem + (".sql.gz" if compress else ".sql")


def write_dump(
    df: DataFrame,
    path: str,
    database: str,
    table: str,
    compress: bool = False,
    mode: str = "overwrite",
    block_bytes: int | None = None,
    **options,
) -> dict[str, int]:
    """Write a dump folder, in place of an older one of that name; returns the ``rows`` and ``text_bytes`` written.

    With ``block_bytes``, as indexed gzip: members of about so much text, which tasks can read on their own.

    Uncommitted parts of a failed job are removed or stay hidden, so a run that
    is tried again can use the same path.
    """
    # Both are counted by the tasks as they write: no second pass, whatever the table's own statistics say.
    rows, lines = Observation(), Observation()
    counted = df.observe(rows, F.count(F.lit(1)).alias("rows"))
    if block_bytes is not None:
        # Statements are packed and compressed by one worker: they don't go through the JVM in between.
        text_bytes = write_indexed_pieces(_pieces(counted, database, table, **options), path, block_bytes, mode)
    else:
        text = dump_text(counted, database, table, **options)
        text = text.observe(lines, F.sum(F.octet_length("value") + F.lit(1).cast("bigint")).alias("text_bytes"))
        writer = text.write.mode(mode)
        if compress:
            writer = writer.option("compression", "gzip")
        writer.text(path)
        text_bytes = lines.get["text_bytes"]
    return {"rows": rows.get["rows"] if options.get("rows", True) else 0, "text_bytes": text_bytes}
