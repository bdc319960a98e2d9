"""The streaming jobs, each fed in two parts so that it stops and continues."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tablehaul.operators.dump_writer import write_dump
from tablehaul.queries import views
from tablehaul.queries.dumps import DATABASE
from tablehaul.queries.reports import FOLDED, RATE, STEPS, SUMMARY, _rate_sql
from tablehaul.queries.views import oracle, table
from tablehaul.session import fresh_dir
from tablehaul.streaming import rates, reports, restore


def _paths(spark: SparkSession, label: str) -> tuple[str, str, str]:
    root = fresh_dir(spark, label)
    return f"{root}/in", f"{root}/out", f"{root}/checkpoint"


def stream_restore(spark: SparkSession, sf_dir: str) -> DataFrame:
    source = table(spark, sf_dir, "customer")
    folder, out, checkpoint = _paths(spark, "stream-restore")
    halves = [F.col("c_nationkey") < 12, F.col("c_nationkey") >= 12]
    for i, half in enumerate(halves):
        write_dump(source.where(half), f"{folder}/part{i}.sql.gz", DATABASE, "customer", compress=True)
        restore.restore_new_files(spark, folder, source.schema, out, checkpoint, "customer")
    return spark.read.schema(source.schema).parquet(out)


def _middle(events: DataFrame, column: str):
    """A value that halves the rows, found by a partial aggregate."""
    return events.select(F.percentile_approx(column, 0.5, 1000).alias("m")).first().m


def _feed(events: DataFrame, first, folder: str, step) -> None:
    """Write one half, let the stream catch up, write the other, catch up again."""
    for half in (first, ~first):
        events.where(half).write.mode("append").parquet(folder)
        step(events.sparkSession.readStream.schema(events.schema).parquet(folder))


def stream_run_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = views.runs(spark, sf_dir)
    folder, out, checkpoint = _paths(spark, "stream-totals")
    middle = _middle(events.select(F.unix_micros(F.col("ts").cast("timestamp")).alias("t")), "t")
    first = F.unix_micros(F.col("ts").cast("timestamp")) <= middle
    _feed(events, first, folder, lambda s: reports.run_totals(s, out, checkpoint))
    return reports.latest_totals(spark, out).withColumn("mb_per_s", F.round("mb_per_s", 9))


def stream_throughput(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = views.runs(spark, sf_dir)
    folder, out, checkpoint = _paths(spark, "stream-throughput")
    middle = _middle(events.select(F.unix_micros(F.col("ts").cast("timestamp")).alias("t")), "t")
    first = F.unix_micros(F.col("ts").cast("timestamp")) <= middle
    _feed(events, first, folder, lambda s: reports.throughput(s, out, checkpoint))
    return reports.latest_throughput(spark, out)


def stream_ewma(spark: SparkSession, sf_dir: str) -> DataFrame:
    samples = views.samples(spark, sf_dir).select("event_id", "worker", "t_s", "bytes_current")
    folder, out, checkpoint = _paths(spark, "stream-rates")
    middle = _middle(samples, "t_s")
    _feed(samples, F.col("t_s") <= middle, folder, lambda s: rates.smoothed_rates(s, out, checkpoint))
    done = spark.read.schema(rates.OUTPUT).parquet(out)
    return done.select("event_id", "worker", F.round("rate", 6).alias("rate"))


QUERIES = {
    "stream_restore": stream_restore,
    "stream_run_summary": stream_run_summary,
    "stream_throughput": stream_throughput,
    "stream_ewma": stream_ewma,
}
ORACLES = {
    "stream_restore": "SELECT * FROM customer",
    "stream_run_summary": oracle("runs", f"SELECT *, {RATE} AS mb_per_s FROM ({SUMMARY} FROM runs) s"),
    "stream_throughput": oracle(
        "runs",
        """SELECT date_trunc('hour', ts) AS window_start, count(*) AS finished, CAST(sum(size_bytes) AS BIGINT) AS size_bytes
FROM runs WHERE kind = 'finished' GROUP BY 1""",
    ),
    "stream_ewma": _rate_sql(
        "samples",
        STEPS + ",\n" + FOLDED,
        "SELECT event_id, s.worker, round(rate, 6) AS rate FROM steps s JOIN rated r ON s.worker = r.worker AND s.n = r.n",
    ),
}
