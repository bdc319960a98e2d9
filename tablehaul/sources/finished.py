"""Lists of finished items: JSON object, JSON array, plain lines, or a backup."""

from __future__ import annotations

import pyarrow as pa
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tablehaul.sources.files import open_stream

_OBJECT = "last_updated string, completed_files array<string>, completed_tables array<string>, _bad string"


def _object(content: Column) -> Column:
    """The parsed JSON object, or null when the text is not a sound one."""
    parsed = F.from_json(content, _OBJECT, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_bad"})
    return F.when(F.startswith(F.ltrim(content), F.lit("{")) & parsed["_bad"].isNull(), parsed)


def _listed(parsed: Column) -> Column:
    empty = F.array().cast("array<string>")
    both = F.concat(F.coalesce(parsed["completed_files"], empty), F.coalesce(parsed["completed_tables"], empty))
    return F.array_distinct(F.filter(both, lambda e: e.isNotNull()))


def _lines(content: Column, strict: bool) -> Column:
    ending = r"\.(sql|SQL)$" if strict else r"(?i)\.sql(\.gz)?$"
    lines = F.transform(F.split(content, r"\r?\n"), lambda l: F.btrim(F.trim(l), F.lit('",[]')))
    return F.array_distinct(F.filter(lines, lambda l: l.rlike(ending)))


def parse_documents(documents: DataFrame, strict_lines: bool = False) -> DataFrame:
    """Adds ``form``, ``entries`` and ``last_updated`` to rows with ``content`` and ``backup``.

    Forms are tried in order: object, array, lines, backup object; a document
    that is none of these is ``unreadable`` and has null entries.
    ``strict_lines`` drops ``.sql.gz`` entries of the plain-line form.
    """
    content = F.col("content")
    parsed = documents.withColumn("_object", _object(content)).withColumn("_backup", _object(F.col("backup")))
    array = F.when(F.startswith(F.ltrim(content), F.lit("[")), F.from_json(content, "array<string>"))
    parsed = parsed.withColumn("_array", array).withColumn("_lines", _lines(content, strict_lines))
    form = (
        F.when(F.col("_object").isNotNull(), "object")
        .when(F.col("_array").isNotNull(), "array")
        .when(F.size("_lines") > 0, "lines")
        .when(F.col("_backup").isNotNull(), "backup")
        .otherwise("unreadable")
    )
    entries = (
        F.when(F.col("form") == "object", _listed(F.col("_object")))
        .when(F.col("form") == "array", F.array_distinct(F.filter("_array", lambda e: e.isNotNull())))
        .when(F.col("form") == "lines", F.col("_lines"))
        .when(F.col("form") == "backup", _listed(F.col("_backup")))
    )
    updated = F.when(F.col("form") == "object", F.col("_object.last_updated")).when(
        F.col("form") == "backup", F.col("_backup.last_updated")
    )
    return (
        parsed.withColumn("form", form)
        .withColumn("entries", entries)
        .withColumn("last_updated", updated.try_cast("timestamp"))
        .drop("_object", "_backup", "_array", "_lines", "content", "backup")
    )


def entries(parsed: DataFrame) -> DataFrame:
    """One row per finished item, without repeats."""
    return parsed.select(F.explode("entries").alias("entry")).distinct()


def first_with_entries(parsed: DataFrame, *keys: str) -> DataFrame:
    """Per key, the candidate of lowest ``priority`` that lists anything."""
    filled = parsed.where(F.size("entries") > 0)
    chosen = filled.groupBy(*keys).agg(F.min(F.struct("priority", "path", "form", "entries")).alias("c"))
    # without keys the aggregate has a row even when there is no candidate
    return chosen.where(F.col("c").isNotNull()).select(*keys, "c.path", "c.form", "c.entries")


def candidates(log_dir: str, source_dir: str, explicit: str | None = None) -> list[str]:
    """Where a list of finished items may lie, best first."""
    if explicit is not None:
        return [explicit]
    # The four places searched.
    return [
        f"{log_dir}/manifest.json",
        f"{source_dir}/logs/manifest.json",
        f"{source_dir}/manifest.json",
        f"{source_dir}/.import_manifest.json",
    ]


def _content(spark: SparkSession, path: str) -> DataFrame | None:
    """A document's text, or None where there is no such file."""
    if not path.rsplit("/", 1)[-1].startswith("."):
        try:
            return spark.read.text(path, wholetext=True).select(F.col("value").alias("content"))
        except AnalysisException:
            return None

    # Spark's readers pass over hidden names, so a task opens the file itself
    def read(batches):
        for _ in batches:
            try:
                with open_stream(path) as stream:
                    content = [stream.read().decode("utf-8")]
            except FileNotFoundError:
                content = []
            yield pa.RecordBatch.from_arrays([pa.array(content, pa.string())], ["content"])

    return spark.range(0, 1, 1, 1).mapInArrow(read, "content string")


def discover(
    spark: SparkSession, log_dir: str, source_dir: str, explicit: str | None = None, strict_lines: bool = False
) -> DataFrame:
    """The list in force: ``path, form, entries``; no row when none lists anything."""
    empty = spark.range(0).select(F.lit("").alias("content"))
    found = empty.select(F.lit(0).alias("priority"), F.lit("").alias("path"), "content", F.lit("").alias("backup"))
    for priority, path in enumerate(candidates(log_dir, source_dir, explicit)):
        content = _content(spark, path)
        if content is None:
            continue
        backup = _content(spark, path.removesuffix(".json") + ".json.bak")
        spare = F.lit(None).cast("string") if backup is None else backup.select("content").scalar()
        found = found.unionAll(
            content.select(F.lit(priority).alias("priority"), F.lit(path).alias("path"), "content", spare.alias("backup"))
        )
    return first_with_entries(parse_documents(found, strict_lines))
