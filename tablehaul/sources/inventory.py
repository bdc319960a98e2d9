"""What lies in a dump folder."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tablehaul.functions.headers import HEADER_ENDS
from tablehaul.functions.names import DUMP_FILE, base_name
from tablehaul.sources.files import open_stream

# Folder levels searched, header lines read.
FOLDER_DEPTH = 2
HEADER_LINES = 100


def _root(folder: str) -> str:
    folder = folder.rstrip("/")
    return "file:/" + folder[len("file:///") :] if folder.startswith("file:///") else folder


def list_dumps(spark: SparkSession, folder: str, depth: int = FOLDER_DEPTH) -> DataFrame:
    """Dump items of a folder: ``path, file_name, relative_path, size_bytes, parts, first_part``.

    An item is a file ``*.sql`` / ``*.sql.gz``, or a folder so named that holds
    the parts of one table. Only the listing is read, never file content. Names
    starting with ``_`` or ``.`` are hidden and empty files are passed over, as
    everywhere in Spark.
    """
    root = _root(folder)
    files = (
        spark.read.format("binaryFile")
        .option("recursiveFileLookup", "true")
        .load(folder)
        .select("path", F.col("length").alias("size_bytes"), "modificationTime")
    )
    start = F.instr("path", root) + len(root) + 1
    relative = F.substring(F.col("path"), start, F.length("path"))
    parent = F.regexp_replace(relative, r"/[^/]*$", "")
    own = relative.rlike(DUMP_FILE)
    in_table_folder = (parent != relative) & parent.rlike(DUMP_FILE)
    item = F.when(own, relative).when(in_table_folder, parent)
    listed = files.select(
        "path",
        "size_bytes",
        "modificationTime",
        item.alias("relative_path"),
        F.when(own, F.col("path")).otherwise(F.regexp_replace("path", r"/[^/]*$", "")).alias("item_path"),
    ).where(F.col("relative_path").isNotNull() & (F.size(F.split("relative_path", "/")) <= depth))
    return (
        listed.groupBy(F.col("item_path").alias("path"), "relative_path")
        .agg(
            F.sum("size_bytes").alias("size_bytes"),
            F.count("*").alias("parts"),
            F.min("path").alias("first_part"),
            F.max("modificationTime").alias("modified"),
        )
        .withColumn("file_name", base_name(F.col("relative_path")))
    )


def require_dumps(items: DataFrame) -> DataFrame:
    """An empty folder is an error, as it most likely is the wrong folder."""
    if items.isEmpty():
        raise FileNotFoundError("no .sql or .sql.gz dump files found")
    return items


def retry_lines(lines: DataFrame) -> DataFrame:
    """A retry list's entries, trimmed, without blanks and ``#`` comments."""
    entry = F.regexp_replace("value", r"^\s+|\s+$", "")
    return lines.withColumn("value", entry).where((F.col("value") != "") & ~F.startswith("value", F.lit("#")))


def resolve_retry(entries: DataFrame, known: DataFrame, folder: Column) -> DataFrame:
    """Entries that exist, as given or else inside ``folder``; the rest drop out.

    ``entries`` has ``line_no`` and ``value``; order and repeats are kept through
    ``line_no``. Both readings of an entry share one join on ``path``.
    """
    reading = F.array(
        F.struct(F.lit(1).alias("rank"), F.col("value").alias("path")),
        F.struct(F.lit(2).alias("rank"), F.concat(folder, F.lit("/"), F.col("value")).alias("path")),
    )
    tried = entries.select("line_no", F.explode(reading).alias("r")).select("line_no", "r.rank", "r.path")
    return (
        tried.join(known.select("path"), "path")
        .groupBy("line_no")
        .agg(F.min(F.struct("rank", "path")).alias("best"))
        .select("line_no", F.col("best.path").alias("path"))
    )


def header_lines(items: DataFrame, max_lines: int = HEADER_LINES) -> DataFrame:
    """The first lines of each item: ``path, line_no, line``.

    Reading a whole dump for its first hundred lines would double the cost of an
    import, so each task opens its own share of the files as streams (gzip
    included) and stops early. Files are dealt out by Spark; a task holds one
    header at a time. A line that is not UTF-8 ends the header.
    """

    def heads(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            paths, firsts = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            for path, first in zip(paths, firsts):
                lines = _head(first, max_lines)
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array([path] * len(lines), pa.string()),
                        pa.array(range(1, len(lines) + 1), pa.int32()),
                        pa.array(lines, pa.string()),
                    ],
                    ["path", "line_no", "line"],
                )

    spark = items.sparkSession
    # a listing is small in bytes, so it must be dealt out by number of files
    dealt = items.select("path", "first_part").repartition(4 * spark.sparkContext.defaultParallelism)
    return dealt.mapInArrow(heads, "path string, line_no int, line string")


#: Of a line, what the header rules can be about.
KEPT_BYTES = 1 << 16


def _head(uri: str, max_lines: int) -> list[str]:
    """First lines of a file; a file that cannot be read on ends its header there."""
    lines: list[str] = []
    held, more = b"", True  # the line being read, of which no rule needs more than its start
    try:
        with open_stream(uri) as stream:
            while more and len(lines) < max_lines:
                block = stream.read(16384)
                more = bool(block)
                *whole, rest = block.split(b"\n")
                if whole:
                    whole[0] = held + whole[0]
                    held = b""
                held = (held + rest)[:KEPT_BYTES] if len(held) < KEPT_BYTES else held
                if not more and held:
                    whole, held = [held], b""
                for raw in whole:
                    lines.append(raw[:KEPT_BYTES].rstrip(b"\r").decode("utf-8", "strict" if len(raw) < KEPT_BYTES else "ignore"))
                    # rows follow: nothing past this line can name the database
                    if lines[-1].lstrip().startswith(tuple(HEADER_ENDS)):
                        return lines[:max_lines]
                if held.lstrip().startswith(b"INSERT INTO"):
                    return [*lines, "INSERT INTO"][:max_lines]
    except (OSError, UnicodeDecodeError):
        pass  # the restore itself will fail on such a file and say why
    return lines[:max_lines]
