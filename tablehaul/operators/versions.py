"""A ledger of finished items as numbered commits.

    log/00000000000000000007    first line: crc32 of the second; second: {"kind", "add", "remove"}, folders of ``data``
    data/<uuid>/*.parquet       records, written and committed by Spark before a commit names them

A commit takes the next free number by creating its file, which only one writer can; another tries the number after. What is
live in a version are the folders its commits add less those they remove. Folder names are never used twice, so the order in which
commits are seen changes nothing: a commit file cut short by a crash is void, its number is passed over, and writers behind it needn't
wait. Records of a writer that dies before its commit are in a folder that no commit names.

A wave of items is one commit and one folder, however many items it has. ``compact`` folds the live folders into one; earlier
versions can still be read. Names of live folders pass through the driver, which compaction keeps few; records and commits do not.
"""

from __future__ import annotations

import json
import uuid
import zlib

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tablehaul.operators.ledger import SCHEMA

DIGITS = 20
_BODY = "kind string, add array<string>, remove array<string>"
_COMMIT = f"version bigint, {_BODY}"


class Conflict(Exception):
    """Another writer committed what this one's commit rests upon."""


def _create_new(spark: SparkSession, uri: str, content: bytes) -> bool:
    """A file that must not exist yet; False if it does. The file system decides between two writers."""
    jvm = spark.sparkContext._jvm
    path = jvm.org.apache.hadoop.fs.Path(uri)
    files = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if files.getScheme() == "file":  # Hadoop's local file system looks first and creates then
        local = path.toUri().getPath()
        files.mkdirs(path.getParent())
        try:
            with open(local, "xb") as out:
                out.write(content)
        except FileExistsError:
            return False
        return True
    if files.exists(path):
        return False
    try:
        out = files.create(path, False)
    except Exception:
        if files.exists(path):
            return False
        raise
    out.write(bytearray(content))
    out.close()
    return True


def _file(ledger: str, version: int) -> str:
    return f"{ledger.rstrip('/')}/log/{version:0{DIGITS}d}"


def commits(spark: SparkSession, ledger: str, version: int | None = None) -> DataFrame:
    """Valid commits up to ``version``: ``version, kind, add, remove``; none where there is no ledger yet."""
    try:
        text = spark.read.text(f"{ledger.rstrip('/')}/log", wholetext=True)
    except AnalysisException as error:
        if error.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], _COMMIT)
    number = F.col("_metadata.file_name").try_cast("bigint")
    lines = F.split("value", "\n")
    found = text.select(number.alias("version"), F.get(lines, 0).alias("check"), F.get(lines, 1).alias("body"))
    sound = F.col("version").isNotNull() & (F.col("check").try_cast("bigint") == F.crc32(F.col("body").cast("binary")))
    if version is not None:
        sound = sound & (F.col("version") <= version)
    return found.where(sound).select("version", F.from_json("body", _BODY).alias("c")).select("version", "c.*")


def latest_version(spark: SparkSession, ledger: str) -> int:
    """The highest number of a valid commit; 0 before the first."""
    return commits(spark, ledger).agg(F.coalesce(F.max("version"), F.lit(0))).first()[0]


def _commit(spark: SparkSession, ledger: str, kind: str, add: list[str], remove: list[str], read_at: int) -> int:
    """Takes the next number after ``read_at``. A commit that removes folders needs that no other removed them since."""
    body = json.dumps({"kind": kind, "add": add, "remove": remove})
    content = f"{zlib.crc32(body.encode())}\n{body}\n".encode()
    version = read_at + 1
    while not _create_new(spark, _file(ledger, version), content):
        version += 1
        if remove:
            since = commits(spark, ledger).where(F.col("version") > read_at).where(F.arrays_overlap("remove", F.array(*map(F.lit, remove))))
            if not since.isEmpty():
                raise Conflict(f"{ledger}: the folders were compacted by another writer")
    return version


def _write(records: DataFrame, ledger: str) -> str:
    name = uuid.uuid4().hex
    records.select("database", "relative_path", "file_name", "size_bytes", "finished_at").write.parquet(f"{ledger.rstrip('/')}/data/{name}")
    return name


def append(finished: DataFrame, ledger: str) -> int:
    """Records a wave of finished items, all or none; returns the version that holds them."""
    spark = finished.sparkSession
    name = _write(finished, ledger)
    return _commit(spark, ledger, "append", [name], [], latest_version(spark, ledger))


def _live(spark: SparkSession, ledger: str, version: int | None) -> list[str]:
    known = commits(spark, ledger, version)
    added, removed = (known.select(F.explode(c).alias("folder")) for c in ("add", "remove"))
    return sorted(r.folder for r in added.join(removed, "folder", "left_anti").collect())


def _records(spark: SparkSession, ledger: str, folders: list[str]) -> DataFrame:
    if not folders:
        return spark.createDataFrame([], SCHEMA)
    return spark.read.schema(SCHEMA).parquet(*(f"{ledger.rstrip('/')}/data/{f}" for f in folders))


def _latest(records: DataFrame) -> DataFrame:
    newest = F.max(F.struct("finished_at", "file_name", "size_bytes")).alias("l")
    found = records.groupBy("database", "relative_path").agg(newest)
    return found.select("database", "relative_path", "l.file_name", "l.size_bytes", "l.finished_at")


def read(spark: SparkSession, ledger: str, version: int | None = None) -> DataFrame:
    """The latest record of each item in a version (None: now)."""
    return _latest(_records(spark, ledger, _live(spark, ledger, version)))


def changes(spark: SparkSession, ledger: str, after: int, version: int | None = None) -> DataFrame:
    """Records that appends later than ``after`` brought, as written."""
    new = commits(spark, ledger, version).where((F.col("version") > after) & (F.col("kind") == "append"))
    return _records(spark, ledger, sorted(r.folder for r in new.select(F.explode("add").alias("folder")).collect()))


def compact(spark: SparkSession, ledger: str) -> int:
    """Folds the live folders into one with the latest record of each item; returns the version.

    Appends that come in between stay beside it. Of two compactions of the same folders one fails with ``Conflict``, unless both
    commit before either looks; then records are held twice, which ``read`` makes nothing of.
    """
    at = latest_version(spark, ledger)
    folders = _live(spark, ledger, at)
    if len(folders) < 2:
        return at
    name = _write(_latest(_records(spark, ledger, folders)), ledger)
    return _commit(spark, ledger, "compact", [name], folders, at)
