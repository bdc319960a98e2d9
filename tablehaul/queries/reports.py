"""Run reports, rates and phases."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tablehaul.functions.text import IMPORT_SILENT, error_snippet, format_bytes_compact, format_duration
from tablehaul.operators import runs, sequence
from tablehaul.operators.joins import salted_join
from tablehaul.queries import views
from tablehaul.queries.inventory import bytes_sql, fixed_sql, scaled_sql
from tablehaul.queries.views import oracle
from tablehaul.session import fresh_dir

SUMMARY = """
SELECT count(*) FILTER (kind = 'started') AS started, count(*) FILTER (kind = 'finished') AS completed,
  count(*) FILTER (kind = 'failed') AS failed, count(*) FILTER (kind IN ('finished', 'failed')) AS processed,
  CAST(coalesce(sum(size_bytes) FILTER (kind = 'finished'), 0) AS BIGINT) AS completed_bytes,
  CAST(epoch_us(max(ts)) - epoch_us(min(ts)) AS DOUBLE) / CAST(1000000.0 AS DOUBLE) AS elapsed_s
"""
RATE = "round((completed_bytes / CAST(1048576.0 AS DOUBLE)) / greatest(elapsed_s, CAST(0.001 AS DOUBLE)), 9)"
SNIPPET = f"""CASE WHEN len(list_filter(string_split(message, chr(10)), lambda l: contains(l, 'ERROR') OR contains(l, 'Error'))) > 0
    THEN list_filter(string_split(message, chr(10)), lambda l: contains(l, 'ERROR') OR contains(l, 'Error'))[1]
  WHEN trim(message) = '' THEN '{IMPORT_SILENT}' ELSE string_split(trim(message), chr(10))[1] END"""


def run_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return runs.summary(views.runs(spark, sf_dir)).withColumn("mb_per_s", F.round("mb_per_s", 9))


def run_summary_by_database(spark: SparkSession, sf_dir: str) -> DataFrame:
    return runs.summary(views.runs(spark, sf_dir), "database").withColumn("mb_per_s", F.round("mb_per_s", 9))


def run_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    total = runs.summary(views.runs(spark, sf_dir), "worker")
    return total.select(
        "worker",
        F.concat(F.col("completed").cast("string"), F.lit(" / "), F.col("started").cast("string")).alias("items"),
        format_bytes_compact(F.col("completed_bytes")).alias("volume"),
        format_duration(F.col("elapsed_s")).alias("duration"),
        format_duration(F.col("elapsed_s") / 997).alias("short_duration"),
    )


DURATION = """CASE WHEN {s} >= 3600 THEN concat(CASE WHEN {s} // 3600 < 10 THEN '0' ELSE '' END, {s} // 3600, ':') ELSE '' END ||
  concat(lpad(CAST(({s} % 3600) // 60 AS VARCHAR), 2, '0'), ':', lpad(CAST({s} % 60 AS VARCHAR), 2, '0'))"""
REPORT_SQL = oracle(
    "runs",
    f"""SELECT worker, concat(completed, ' / ', started) AS items, {bytes_sql("completed_bytes", True)} AS volume,
  {DURATION.format(s="CAST(floor(elapsed_s) AS BIGINT)")} AS duration,
  {DURATION.format(s="CAST(floor(elapsed_s / 997) AS BIGINT)")} AS short_duration
FROM (SELECT worker, * FROM (SELECT worker, {SUMMARY.strip()[len("SELECT "):]} FROM runs GROUP BY worker)) s""",
)


def worker_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    """By database and worker, so that some last events are starts and some are not."""
    events = views.runs(spark, sf_dir)
    slot = F.concat("database", F.lit("/"), F.col("worker").cast("string"))
    return runs.worker_status(events.withColumn("worker", slot))


def failed_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    failed = runs.failures(views.runs(spark, sf_dir), "logs")
    path = fresh_dir(spark, "failed")
    runs.write_failed_files(failed, path)
    return spark.read.text(path).select(F.col("value").alias("file_path"))


def failure_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    return runs.failures(views.runs(spark, sf_dir), "logs").drop("event_id")


def snippet(spark: SparkSession, sf_dir: str) -> DataFrame:
    failed = views.runs(spark, sf_dir).where("kind = 'failed'")
    return failed.groupBy(error_snippet(F.col("message")).alias("error_snippet")).agg(F.count("*").alias("failures"))


def _rates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sequence.rates(views.samples(spark, sf_dir), ["worker"])


def running_bytes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return views.samples(spark, sf_dir).select("event_id", "worker", "bytes_current")


def instant_rate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rates(spark, sf_dir).select("event_id", "worker", F.round("inst_rate", 9).alias("inst_rate"))


def ewma_rate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rates(spark, sf_dir).select("event_id", "worker", F.round("rate", 6).alias("rate"))


def ewma_rate_nulls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every seventh sample has lost its size: it gives no rate, and the next step goes over it."""
    samples = views.samples(spark, sf_dir)
    lost = F.when(F.col("event_id") % 7 != 0, F.col("bytes_current"))
    rated = sequence.rates(samples.withColumn("bytes_current", lost), ["worker"])
    return rated.select("event_id", "worker", F.round("inst_rate", 9).alias("inst_rate"), F.round("rate", 6).alias("rate"))


def _phased(spark: SparkSession, sf_dir: str) -> DataFrame:
    samples = views.samples(spark, sf_dir)
    rated = sequence.rates(samples, ["worker"])
    totals = samples.groupBy("worker").agg(F.max("bytes_current").alias("_most"))
    part = F.call_function("div", F.col("_most") * 3, F.lit(4).cast("bigint"))
    sizes = totals.select("worker", part.alias("total_bytes"))
    return runs.task_phase(salted_join(rated, sizes, ["worker"], F.col("event_id")))


def task_phase(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _phased(spark, sf_dir).select(
        "event_id", "worker", "phase", F.round("percent", 6).alias("percent"), F.round("eta_s", 3).alias("eta_s")
    )


def overall_progress(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The progress line at every second of the clock, from the workers seen in it."""
    phased = _phased(spark, sf_dir).withColumn("tick", F.floor("t_s").cast("bigint"))
    last = phased.groupBy("tick", "worker").agg(
        F.max(F.struct("t_s", "event_id", "bytes_current", "eta_s")).alias("l")
    ).select("tick", "worker", "l.bytes_current", "l.eta_s")
    out = runs.overall_progress(last, runs.summary(views.runs(spark, sf_dir)), "tick")
    return out.select(
        "tick",
        "active",
        "live_bytes",
        "done_bytes",
        format_bytes_compact(F.col("done_bytes")).alias("done_text"),
        F.round("eta_s", 3).alias("eta_s"),
    )


STEPS = """numbered AS (
  SELECT *, row_number() OVER w AS n, t_s - lag(t_s) OVER w AS dt,
    greatest(bytes_current - lag(bytes_current) OVER w, 0) AS gained, t_s - min(t_s) OVER (PARTITION BY worker) AS elapsed_s,
    (max(bytes_current) OVER (PARTITION BY worker) * 3) // 4 AS total_bytes
  FROM samples WINDOW w AS (PARTITION BY worker ORDER BY t_s, event_id)),
steps AS (
  SELECT *, CASE WHEN dt >= CAST(0.1 AS DOUBLE) THEN CAST(gained AS DOUBLE) / CAST(1048576.0 AS DOUBLE) / dt END AS inst_rate FROM numbered)"""
# The fold itself, one recursion step per sample of a worker.
FOLDED = """rated AS (
  SELECT worker, n, CAST(0.0 AS DOUBLE) AS rate FROM steps WHERE n = 1
  UNION ALL
  SELECT s.worker, s.n, CASE WHEN s.inst_rate IS NULL THEN r.rate WHEN r.rate <= CAST(0.001 AS DOUBLE) THEN s.inst_rate
    ELSE CAST(0.25 AS DOUBLE) * s.inst_rate + CAST(0.75 AS DOUBLE) * r.rate END
  FROM rated r JOIN steps s ON s.worker = r.worker AND s.n = r.n + 1)"""
PHASED = """phased AS (
  SELECT s.*, r.rate, CASE WHEN final THEN 'finalizing' WHEN elapsed_s < 3 THEN 'warm-up'
      WHEN rate < CAST(0.05 AS DOUBLE) AND elapsed_s > 5 THEN 'stalled' ELSE 'streaming' END AS phase,
    CASE WHEN NOT final THEN CASE WHEN total_bytes > 0
      THEN least(CAST(bytes_current AS DOUBLE) / total_bytes * 100, CAST(99.9 AS DOUBLE)) ELSE 0 END END AS percent,
    CASE WHEN NOT final AND bytes_current < total_bytes AND rate * 1048576 > 10
      AND (total_bytes - bytes_current) / (rate * 1048576) <= 2592000
      THEN (total_bytes - bytes_current) / (rate * 1048576) END AS eta_s
  FROM (SELECT *, total_bytes > 0 AND bytes_current >= total_bytes AS final FROM steps) s
  JOIN rated r ON s.worker = r.worker AND s.n = r.n)"""


def _rate_sql(views_needed: str, parts: str, select: str) -> str:
    return oracle(views_needed, "").rstrip().replace("WITH ", "WITH RECURSIVE ", 1) + ",\n" + parts + "\n" + select


QUERIES = {
    "run_summary": run_summary,
    "run_summary_by_database": run_summary_by_database,
    "run_report": run_report,
    "worker_status": worker_status,
    "failed_files": failed_files,
    "failure_report": failure_report,
    "error_snippet": snippet,
    "running_bytes": running_bytes,
    "instant_rate": instant_rate,
    "ewma_rate": ewma_rate,
    "ewma_rate_nulls": ewma_rate_nulls,
    "task_phase": task_phase,
    "overall_progress": overall_progress,
}
ORACLES = {
    "run_summary": oracle("runs", f"SELECT *, {RATE} AS mb_per_s FROM ({SUMMARY} FROM runs) s"),
    "run_summary_by_database": oracle(
        "runs", f"SELECT *, {RATE} AS mb_per_s FROM ({SUMMARY}, database FROM runs GROUP BY database) s"
    ),
    "run_report": REPORT_SQL,
    "worker_status": oracle(
        "runs",
        f"""SELECT slot AS worker, concat(file_name, ' (', {fixed_sql(scaled_sql("size_bytes", 1024**2, 1), 1)}, ' MB)') AS status
FROM (SELECT *, concat(database, '/', worker) AS slot,
  row_number() OVER (PARTITION BY database, worker ORDER BY ts DESC, event_id DESC) AS k FROM runs) r
WHERE k = 1 AND kind = 'started'""",
    ),
    "failed_files": oracle("runs", "SELECT file_path FROM runs WHERE kind = 'failed'"),
    "failure_report": oracle(
        "runs",
        f"""SELECT file_path, file_name, database, size_bytes / CAST(1048576.0 AS DOUBLE) AS size_mb, exit_code,
  {SNIPPET} AS error_snippet, concat('logs/', database, '__', file_name, '.err.log') AS log_path, message
FROM runs WHERE kind = 'failed'""",
    ),
    "error_snippet": oracle(
        "runs", f"SELECT {SNIPPET} AS error_snippet, count(*) AS failures FROM runs WHERE kind = 'failed' GROUP BY 1"
    ),
    "running_bytes": oracle("samples", "SELECT event_id, worker, bytes_current FROM samples"),
    "instant_rate": _rate_sql("samples", STEPS, "SELECT event_id, worker, round(inst_rate, 9) AS inst_rate FROM steps"),
    "ewma_rate": _rate_sql(
        "samples",
        STEPS + ",\n" + FOLDED,
        "SELECT event_id, s.worker, round(rate, 6) AS rate FROM steps s JOIN rated r ON s.worker = r.worker AND s.n = r.n",
    ),
    "ewma_rate_nulls": _rate_sql(
        "samples",
        "known AS (SELECT * FROM samples WHERE event_id % 7 <> 0),\n" + STEPS.replace("FROM samples", "FROM known") + ",\n" + FOLDED,
        """SELECT a.event_id, a.worker, round(s.inst_rate, 9) AS inst_rate, round(r.rate, 6) AS rate
FROM (SELECT *, count(*) FILTER (event_id % 7 <> 0) OVER (PARTITION BY worker ORDER BY t_s, event_id) AS k FROM samples) a
LEFT JOIN rated r ON r.worker = a.worker AND r.n = a.k LEFT JOIN steps s ON s.event_id = a.event_id AND s.worker = a.worker""",
    ),
    "task_phase": _rate_sql(
        "samples",
        ",\n".join((STEPS, FOLDED, PHASED)),
        "SELECT event_id, worker, phase, round(percent, 6) AS percent, round(eta_s, 3) AS eta_s FROM phased",
    ),
    "overall_progress": _rate_sql(
        "runs samples",
        ",\n".join((STEPS, FOLDED, PHASED)),
        f"""SELECT tick, active, live_bytes, done_bytes, {bytes_sql("done_bytes", True)} AS done_text, eta_s FROM (
  SELECT tick, count(*) AS active, CAST(sum(bytes_current) AS BIGINT) AS live_bytes, round(max(eta_s), 3) AS eta_s,
    CAST(sum(bytes_current) + (SELECT sum(size_bytes) FROM runs WHERE kind = 'finished') AS BIGINT) AS done_bytes
  FROM (SELECT *, CAST(floor(t_s) AS BIGINT) AS tick,
    row_number() OVER (PARTITION BY worker, CAST(floor(t_s) AS BIGINT) ORDER BY t_s DESC, event_id DESC) AS k FROM phased) p
  WHERE k = 1 GROUP BY tick) q""",
    ),
}
