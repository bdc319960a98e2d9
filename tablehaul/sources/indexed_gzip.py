"""Gzip text that many tasks can read: members of whole lines, and an index of where they lie.

A gzip stream cannot be entered in its middle, so a large ``.sql.gz`` is one task. Here each task
writes its lines as members of about ``block_bytes`` of text in one file (any gzip program reads
such a file as one text), and ``_blocks`` beside the files tells each member's place. A reader
deals the blocks out by compressed bytes, however few the files are. ``find_blocks`` makes the
same index for files of many members that others wrote, one pass a file.
"""

from __future__ import annotations

import uuid
import zlib
from collections.abc import Iterator
from functools import reduce

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tablehaul.session import fresh_dir
from tablehaul.sources.files import create, move, open_bytes

#: Text in one member, and compressed bytes that one task reads.
BLOCK_BYTES = 4 << 20
SPLIT_BYTES = 16 << 20
_PIECE = 1 << 20

#: A block: whole lines at ``start`` of a file, ``length`` compressed bytes. The file has ``size`` bytes.
BLOCKS = "file string, start long, length long, size long, text_bytes long, lines long"
_SHAPE = pa.schema([("file", pa.string()), *[(n, pa.int64()) for n in ("start", "length", "size", "text_bytes", "lines")]])
INDEX = "_blocks"


def _rows(file: str, blocks: list[tuple[int, int, int, int]], size: int) -> pa.RecordBatch:
    named = [dict(file=file, start=b[0], length=b[1], size=size, text_bytes=b[2], lines=b[3]) for b in blocks]
    return pa.RecordBatch.from_pylist(named, schema=_SHAPE)


def _write(path: str, block_bytes: int, level: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # A task that is tried again writes another file; only files in the index of tasks that ended are shown.
        name = f"part-{uuid.uuid4().hex}.sql.gz"
        out, blocks, at = None, [], 0
        held: list[bytes] = []
        used = 0

        def close() -> None:
            nonlocal out, at, held, used
            out = out or create(f"{path}/_writing/{name}")
            packer = zlib.compressobj(level, zlib.DEFLATED, 31)
            packed = packer.compress(b"\n".join(held) + b"\n") + packer.flush()
            out.write(packed)
            blocks.append((at, len(packed), used, sum(line.count(b"\n") + 1 for line in held)))
            at += len(packed)
            held, used = [], 0

        for batch in batches:
            for value in batch.column(0).cast(pa.binary()):
                held.append(value.as_py() or b"")
                used += len(held[-1]) + 1
                if used >= block_bytes:
                    close()
        if held:
            close()
        if out is not None:
            out.close()
            yield _rows(name, blocks, at)

    return run


def _show(path: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name in batch.column(0).to_pylist():
                move(f"{path}/_writing/{name}", f"{path}/{name}")
            yield batch

    return run


def write_indexed(text: DataFrame, path: str, block_bytes: int = BLOCK_BYTES, mode: str = "overwrite", level: int = 6) -> None:
    """Lines of ``text`` (one string column) as indexed gzip files in the folder ``path``, one file a partition.

    Files are written hidden and shown by a second job once all tasks have ended; the index comes
    last, so a folder without one is a write that did not end. Lines that a partition doesn't have make no file.
    """
    write_indexed_pieces([(text, None)], path, block_bytes, mode, level)


def write_indexed_pieces(pieces: list[tuple], path: str, block_bytes: int = BLOCK_BYTES, mode: str = "overwrite", level: int = 6) -> int:
    """As ``write_indexed``, for DataFrames that each come with the batch function which makes lines of them (or None).

    Both steps are one task function. Returns the bytes of text written.
    """
    spark = pieces[0][0].sparkSession
    path = path.rstrip("/")
    write = _write(path, block_bytes, level)

    def after(run):
        return write if run is None else lambda batches: write(run(batches))

    # An empty write clears an older folder, or fails if the mode forbids that.
    spark.createDataFrame([], "value string").write.mode(mode).text(path)
    waiting = fresh_dir(spark, "blocks")
    reduce(DataFrame.unionAll, [text.mapInArrow(after(run), BLOCKS) for text, run in pieces]).write.parquet(waiting)
    blocks = spark.read.schema(BLOCKS).parquet(waiting)
    blocks.select("file").distinct().mapInArrow(_show(path), "file string").write.format("noop").mode("overwrite").save()
    blocks.write.mode("overwrite").parquet(f"{path}/{INDEX}")
    return blocks.agg(F.coalesce(F.sum("text_bytes"), F.lit(0))).first()[0]


def read_blocks(spark: SparkSession, path: str) -> DataFrame:
    """The index that ``write_indexed`` left in a folder, with whole file paths."""
    found = spark.read.schema(BLOCKS).parquet(f"{path.rstrip('/')}/{INDEX}")
    return found.withColumn("file", F.concat(F.lit(path.rstrip("/") + "/"), "file"))


def inflated(source, length: int | None = None) -> Iterator[tuple[bytes, int | None]]:
    """Text of the members in ``length`` bytes (None: all), in pieces; behind each member an empty piece and the bytes used by then."""
    taken, rest, member = 0, b"", None
    while True:
        ended = False
        if not rest:
            rest = source.read(_PIECE if length is None else min(_PIECE, length - taken))
            taken += len(rest)
            ended = not rest
            if ended and member is None:
                break
        member = member or zlib.decompressobj(31)
        piece = member.decompress(rest, _PIECE)
        if piece:
            yield piece, None
        if member.eof:
            rest, member = member.unused_data, None
            yield b"", taken - len(rest)
        else:
            rest = member.unconsumed_tail
            if ended and not piece:
                raise ValueError("gzip data end within a member")
    if length is not None and taken != length:
        raise ValueError(f"{length} bytes of gzip data expected, {taken} found")


def _find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for file in batch.column(0).to_pylist():
            blocks, start, text, lines, last = [], 0, 0, 0, b"\n"
            with open_bytes(file) as source:
                size = source.size()
                for piece, end in inflated(source):
                    if piece:
                        text, lines, last = text + len(piece), lines + piece.count(b"\n"), piece[-1:]
                    elif last == b"\n" or end == size:  # a line that goes on in the next member keeps both in one block
                        blocks.append((start, end - start, text, lines + (last != b"\n")))
                        start, text, lines = end, 0, 0
                        last = b"\n"
            if blocks:
                yield _rows(file, blocks, size)


def find_blocks(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """The index of gzip files that come without one. Every file is inflated once, by one task, in constant memory.

    A file of one member is one block. A truncated file, or bytes that aren't gzip, fail the job.
    """
    files = spark.read.format("binaryFile").load(path).select("path", "length").where("length > 0")
    return files.select("path").mapInArrow(_find, BLOCKS)


def _inflate(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names = ["value", "file_path", "file_block_start", "file_block_length", "file_size"]
    opened = source = None

    def lines(whole: bytes, block: dict) -> pa.RecordBatch:
        values = pa.array(whole.split(b"\n"), pa.binary())
        same = [pa.scalar(block["file"])] + [pa.scalar(block[c], pa.int64()) for c in ("start", "length", "size")]
        return pa.RecordBatch.from_arrays([values, *(pa.repeat(s, len(values)) for s in same)], names)

    for batch in batches:
        for block in batch.to_pylist():
            if block["file"] != opened:
                opened, source = block["file"], open_bytes(block["file"])
                if source.size() != block["size"]:
                    raise ValueError(f"{opened} has {source.size()} bytes, its index says {block['size']}")
            source.seek(block["start"])
            parts: list[bytes] = []  # of a line that no piece has ended yet
            text = 0
            for piece, _ in inflated(source, block["length"]):
                text += len(piece)
                cut = piece.rfind(b"\n")
                if cut < 0:
                    parts.append(piece)
                else:
                    yield lines(b"".join([*parts, piece[:cut]]), block)
                    parts = [piece[cut + 1 :]]
            if any(parts):
                yield lines(b"".join(parts), block)
            if text != block["text_bytes"]:
                raise ValueError(f"{opened} differs from its index at byte {block['start']}")


def indexed_lines(blocks: DataFrame, split_bytes: int = SPLIT_BYTES) -> DataFrame:
    """Lines of the blocks as ``value`` (bytes) with their file and block; neighbours in order, one task for about ``split_bytes``."""
    total = blocks.agg(F.coalesce(F.sum("length"), F.lit(0))).first()[0]
    dealt = blocks.repartitionByRange(max(1, -(-total // split_bytes)), "file", "start").sortWithinPartitions("file", "start")
    shape = "value binary, file_path string, file_block_start long, file_block_length long, file_size long"
    return dealt.mapInArrow(_inflate, shape)
