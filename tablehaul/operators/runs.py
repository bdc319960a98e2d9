"""Run events folded into totals, worker states and failure lists."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tablehaul.functions.names import import_log_name, size_mb
from tablehaul.functions.text import (
    IMPORT_SILENT,
    MB,
    fixed,
    error_snippet,
    eta_seconds,
    percent_done,
    scaled,
)


def summary(events: DataFrame, *keys: str) -> DataFrame:
    """Counts, bytes, elapsed seconds and average MB/s of a run; one partial aggregate."""
    kind = F.col("kind")
    zero = F.lit(0).cast("bigint")
    counted = events.groupBy(*keys).agg(
        F.count_if(kind == "started").alias("started"),
        F.count_if(kind == "finished").alias("completed"),
        F.count_if(kind == "failed").alias("failed"),
        F.coalesce(F.sum(F.when(kind == "finished", F.col("size_bytes"))), zero).alias("completed_bytes"),
        F.max(F.unix_micros(F.col("ts").cast("timestamp"))).alias("_last"),
        F.min(F.unix_micros(F.col("ts").cast("timestamp"))).alias("_first"),
    )
    elapsed = (F.col("_last") - F.col("_first")).cast("double") / F.lit(1000000.0)
    rate = size_mb(F.col("completed_bytes")) / F.greatest(F.col("elapsed_s"), F.lit(0.001))
    return (
        counted.withColumn("processed", F.col("completed") + F.col("failed"))
        .withColumn("elapsed_s", elapsed)
        .withColumn("mb_per_s", rate)
        .drop("_last", "_first")
    )


def worker_status(events: DataFrame) -> DataFrame:
    """What each worker is on: its last event, if that is a start."""
    last = events.groupBy("worker").agg(
        F.max(F.struct("ts", "event_id", "kind", "file_name", "size_bytes")).alias("e")
    )
    size = F.concat(F.lit(" ("), fixed(scaled(F.col("e.size_bytes"), MB, 1), 1), F.lit(" MB)"))
    return last.where(F.col("e.kind") == "started").select(
        "worker", F.concat("e.file_name", size).alias("status")
    )


def failures(events: DataFrame, log_dir: str, silent: str = IMPORT_SILENT) -> DataFrame:
    """One row per failed item with its exit code, error line and log path."""
    log = F.concat(F.lit(log_dir + "/"), import_log_name(F.col("database"), F.col("file_name")))
    return events.where(F.col("kind") == "failed").select(
        "event_id",
        "file_path",
        "file_name",
        "database",
        size_mb(F.col("size_bytes")).alias("size_mb"),
        "exit_code",
        error_snippet(F.col("message"), silent).alias("error_snippet"),
        log.alias("log_path"),
        "message",
    )


def failure_log(title: str = "IMPORT FAILURE") -> Column:
    """The text kept for one row of ``failures``."""
    code = F.coalesce(F.col("exit_code").cast("string"), F.lit("none"))
    trimmed = F.regexp_replace(F.coalesce("message", F.lit("")), r"^\s+|\s+$", "")
    return F.concat_ws(
        "\n",
        F.lit(title),
        F.concat(F.lit("Database: "), "database"),
        F.concat(F.lit("File: "), "file_path"),
        F.concat(F.lit("Size: "), F.format_number("size_mb", 2), F.lit(" MB")),
        F.concat(F.lit("Exit code: "), code),
        F.lit("Error output:"),
        trimmed,
    )


def write_failure_logs(failed: DataFrame, path: str) -> bool:
    """The failures with their log texts as JSON lines, one per failure, if there are any."""
    if failed.isEmpty():
        return False
    failed.withColumn("log_text", failure_log()).write.mode("append").json(path)
    return True


def write_failed_files(failed: DataFrame, path: str) -> bool:
    """The retry list, one path per line; none is written when nothing failed."""
    if failed.isEmpty():
        return False
    failed.select(F.col("file_path").alias("value")).write.mode("overwrite").text(path)
    return True


def task_phase(samples: DataFrame) -> DataFrame:
    """Adds percent, ETA and phase to samples with rate, elapsed and total bytes.

    A task whose bytes are all read is finalizing; its percent and ETA are null.
    """
    current, total = F.col("bytes_current"), F.col("total_bytes")
    final = (total > 0) & (current >= total)
    rate, elapsed = F.col("rate"), F.col("elapsed_s")
    phase = (
        F.when(final, "finalizing")
        .when(elapsed < 3.0, "warm-up")
        .when((rate < 0.05) & (elapsed > 5.0), "stalled")
        .otherwise("streaming")
    )
    return (
        samples.withColumn("phase", phase)
        .withColumn("percent", F.when(~final, percent_done(current, total)))
        .withColumn("eta_s", F.when(~final, eta_seconds(current, total, rate * F.lit(1048576.0))))
    )


def overall_progress(latest: DataFrame, finished_bytes: DataFrame, *keys: str) -> DataFrame:
    """Active tasks, bytes done so far, and the longest ETA among active tasks.

    ``latest`` has one row per active task (``task_phase`` columns), and per
    ``keys`` if there are any, such as a tick of the clock; ``finished_bytes`` is
    one row with ``completed_bytes``.
    """
    active = latest.groupBy(*keys).agg(
        F.count("*").alias("active"),
        F.coalesce(F.sum("bytes_current"), F.lit(0).cast("bigint")).alias("live_bytes"),
        F.max("eta_s").alias("eta_s"),
    )
    done = finished_bytes.select("completed_bytes").scalar()
    return active.withColumn("done_bytes", F.col("live_bytes") + done)
