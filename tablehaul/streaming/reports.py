"""Run reports that follow a growing set of events."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tablehaul.operators.runs import summary


def _finish(frame: DataFrame, mode: str, out: str, checkpoint: str) -> None:
    def write(batch: DataFrame, batch_id: int) -> None:
        # a batch that is run again after a failure replaces its own output
        batch.write.mode("overwrite").parquet(f"{out}/batch={batch_id}")

    query = (
        frame.writeStream.outputMode(mode)
        .foreachBatch(write)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )
    query.awaitTermination()


def run_totals(events: DataFrame, out: str, checkpoint: str) -> None:
    """Running totals of a run, one row per batch."""
    _finish(summary(events), "complete", out, checkpoint)


def latest_totals(spark: SparkSession, out: str) -> DataFrame:
    rows = spark.read.parquet(out)
    last = rows.select(F.max("batch").alias("batch"))
    return rows.join(last, "batch", "left_semi").drop("batch")


def throughput(events: DataFrame, out: str, checkpoint: str, width: str = "1 hour", late: str = "10 minutes") -> None:
    """Finished bytes per fixed interval.

    Events more than ``late`` behind the newest one are dropped, and intervals
    that old are forgotten, so the state stays as large as the open intervals.
    """
    done = events.where(F.col("kind") == "finished").withColumn("_at", F.col("ts").cast("timestamp"))
    per = (
        done.withWatermark("_at", late)
        .groupBy(F.window("_at", width).alias("_w"))
        .agg(F.count("*").alias("finished"), F.sum("size_bytes").alias("size_bytes"))
    )
    start = F.col("_w.start").cast("timestamp_ntz")
    _finish(per.select(start.alias("window_start"), "finished", "size_bytes"), "update", out, checkpoint)


def latest_throughput(spark: SparkSession, out: str) -> DataFrame:
    """The last word on each interval."""
    last = spark.read.parquet(out).groupBy("window_start").agg(
        F.max(F.struct("batch", "finished", "size_bytes")).alias("l")
    )
    return last.select("window_start", "l.finished", "l.size_bytes")
