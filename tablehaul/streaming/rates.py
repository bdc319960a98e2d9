"""Smoothed transfer rates as byte samples arrive.

Each batch is cut into chunks by worker and time, as in ``operators.sequence``, so a worker's
share of a batch may be any size; between batches one small state per worker is kept.
A sample older than its worker's state comes too late to be rated; such samples go to a side output and are counted.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tablehaul.operators.joins import SALTS
from tablehaul.operators.sequence import SmoothedRate, in_chunks, scan

INPUT = ["event_id", "worker", "t_s", "bytes_current"]
OUTPUT = "event_id bigint, worker bigint, t_s double, bytes_current bigint, inst_rate double, rate double, elapsed_s double"
STATE = "worker bigint, start double, bytes bigint, time double, rate double"
LATE = "event_id bigint, worker bigint, t_s double, bytes_current bigint, reason string"

REASON_OLD = "older than the state"
REASON_UNPLACED = "no time or no size"


class ContinuedRate(SmoothedRate):
    """A smoothed rate whose rows name the state their worker is entered with; ``_start`` is null where it has none."""

    def __init__(self):
        super().__init__()
        self.inputs = [*self.inputs, "_start", "_bytes", "_time", "_rate"]

    def _entry(self, columns):
        start, time, rate = (float("nan") if v is None else float(v) for v in (columns[c][0] for c in ("_start", "_time", "_rate")))
        return None if start != start else [start, int(columns["_bytes"][0]), time, rate]

    def walk(self, state, columns):
        return super().walk(state or self._entry(columns), columns)

    def walk_unknown(self, effect, columns):
        entry = effect["entry"] if effect else self._entry(columns)
        return {**super().walk_unknown(effect, columns), "entry": entry}

    def apply(self, effect, state):
        return super().apply(effect, state or effect["entry"])


def _with_states(rows: DataFrame, states: DataFrame) -> DataFrame:
    """Each row with its worker's state; a worker's rows are dealt over salts, so a hot one meets many tasks."""
    named = states.select(
        F.col("worker").alias("_worker"), F.col("start").alias("_start"), F.col("bytes").alias("_bytes"), F.col("time").alias("_time"),
        F.col("rate").alias("_rate"), F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("_of"),
    )
    dealt = rows.withColumn("_salt", F.pmod(F.xxhash64("event_id", "t_s"), F.lit(SALTS)).cast("int"))
    met = dealt.join(named, F.col("worker").eqNullSafe(F.col("_worker")) & (F.col("_salt") == F.col("_of")), "left")
    # The size stays a whole number in Arrow only without nulls.
    return met.withColumn("_bytes", F.coalesce("_bytes", F.lit(0).cast("bigint"))).drop("_salt", "_of", "_worker")


def _next_states(states: DataFrame, rated: DataFrame) -> DataFrame:
    last = F.max(F.struct("t_s", "event_id", "bytes_current", "rate"))
    new = rated.groupBy(F.col("worker").alias("_worker")).agg(last.alias("_last"), F.min("t_s").alias("_first"))
    both = states.join(new, F.col("worker").eqNullSafe(F.col("_worker")), "full")
    return both.select(
        F.coalesce("worker", "_worker").alias("worker"),
        F.coalesce("start", "_first").alias("start"),
        F.coalesce("_last.bytes_current", "bytes").alias("bytes"),
        F.coalesce("_last.t_s", "time").alias("time"),
        F.coalesce("_last.rate", "rate").alias("rate"),
    )


def smoothed_rates(samples: DataFrame, target: str, checkpoint: str, late: str | None = None) -> int:
    """Rates of every sample that arrived since the last call, added to ``target``; returns how many could not be rated.

    Those are written to ``late`` (``target`` with ``-late`` behind it, if not given) with the reason. A batch that is
    run again after a failure replaces its own output, so ``target`` and ``late`` belong to one checkpoint.
    """
    late = late or f"{target.rstrip('/')}-late"
    kept = f"{checkpoint.rstrip('/')}/rate-states"
    counts = []

    def rate_batch(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        if batch_id:
            states = spark.read.schema(STATE).parquet(f"{kept}/batch={batch_id - 1}")
        else:
            states = spark.createDataFrame([], STATE)
        states = states.select("worker", "start", "bytes", "time", "rate")
        unplaced = F.col("t_s").isNull() | F.isnan("t_s") | F.col("bytes_current").isNull()
        old = F.col("_time").isNotNull() & (F.col("t_s") < F.col("_time"))
        reason = F.when(unplaced, REASON_UNPLACED).when(old, REASON_OLD)
        met = _with_states(batch.select(*INPUT), states).withColumn("reason", reason)

        out, side = f"{target.rstrip('/')}/batch={batch_id}", f"{late}/batch={batch_id}"
        met.where("reason IS NOT NULL").select(*INPUT, "reason").write.mode("overwrite").parquet(side)
        counts.append(spark.read.schema(LATE).parquet(side).count())
        chunked = in_chunks(met.where("reason IS NULL").drop("reason"), ["worker"], ["t_s", "event_id", "bytes_current"])
        rated = scan(chunked, ["worker"], ContinuedRate())
        rated.select(*INPUT, "inst_rate", "rate", "elapsed_s").write.mode("overwrite").parquet(out)
        following = _next_states(states, spark.read.schema(OUTPUT).parquet(out))
        following.write.mode("overwrite").parquet(f"{kept}/batch={batch_id}")

    query = (
        samples.writeStream.foreachBatch(rate_batch)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )
    query.awaitTermination()
    return sum(counts)
