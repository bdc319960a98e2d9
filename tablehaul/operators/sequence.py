"""Running totals and smoothed rates over ordered series, with no series in one task.

A series (one worker's samples, say) may hold a large share of all rows, so it
is not grouped into one task. The rows are range-partitioned by series and
order, which cuts a long series into chunks of similar size. Each chunk is then
walked twice, in parallel with all others:

1. summarise what the chunk does to the state it is entered with,
2. after the entry states are known, walk again and produce the rows.

Between the two only one small summary per chunk meets on the driver, however
many rows or series there are. The chunks are checkpointed so that both walks
see the same cuts, also when an executor is lost.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tablehaul.session import shared_dir

# Smoothing of the transfer rate.
SMALLEST_STEP_S = 0.1
NEWEST_SHARE = 0.25
OLDER_SHARE = 0.75
NO_RATE = 0.001
BYTES_PER_MB = 1048576.0


def in_chunks(df: DataFrame, series: list[str], order: list[str], chunks: int | None = None) -> DataFrame:
    """``df`` sorted by series and order, cut into chunks of similar size (``_chunk``).

    ``order`` must be total within a series.
    """
    spark = df.sparkSession
    shared_dir(spark)
    count = chunks or int(spark.conf.get("spark.sql.shuffle.partitions"))
    keys = [*series, *order]
    cut = df.repartitionByRange(count, *keys).sortWithinPartitions(*keys)
    return cut.withColumn("_chunk", F.spark_partition_id()).checkpoint()


def _whole(values) -> np.ndarray:
    """Whole numbers; an unknown one adds nothing, as in SQL's sum over a window."""
    values = np.asarray(values)
    if values.dtype.kind in "iu":
        return values.astype(np.int64)
    return np.array([0 if v is None or v != v else int(v) for v in values.tolist()], np.int64)


class RunningTotal:
    """State: the total so far. An unknown entry state is an amount to add."""

    def __init__(self, value: str, out: str):
        self.value, self.out = value, out
        self.inputs = [value]
        self.fields = [(out, T.LongType())]

    def fresh(self):
        return 0

    def walk(self, state, columns):
        totals = np.cumsum(_whole(columns[self.value])) + state
        return int(totals[-1]), {self.out: pa.array(totals, pa.int64())}

    def unknown(self):
        return 0

    def walk_unknown(self, effect, columns):
        return effect + int(_whole(columns[self.value]).sum())

    def apply(self, effect, state):
        return state + effect


def rate_step(rate: float, instant: float) -> float:
    """A near-zero rate is replaced; otherwise the newest value has a quarter share."""
    return instant if rate <= NO_RATE else NEWEST_SHARE * instant + OLDER_SHARE * rate


class SmoothedRate:
    """State: ``[start, bytes, time, rate]`` of a task, or None before its first sample.

    The effect of a chunk on an unknown rate ``x`` is kept as ``pieces`` (for
    ``x`` up to a bound the rate is a constant, because it fell to near zero at
    some step and was replaced) and, above the last bound, ``a * x + b``.
    """

    def __init__(self, time: str = "t_s", size: str = "bytes_current"):
        self.time, self.size = time, size
        self.inputs = [time, size]
        self.fields = [(n, T.DoubleType()) for n in ("inst_rate", "rate", "elapsed_s")]

    def fresh(self):
        return None

    def _known(self, columns):
        """Which rows are samples, and only those. One without a time or a size is none: it has no rate and changes none."""
        known = np.ones(len(columns[self.time]), dtype=bool)
        for name in (self.time, self.size):
            known &= ~np.isnan(columns[name].astype(np.float64))
        return known, {n: columns[n][known] for n in self.inputs}

    def _instants(self, last_bytes, last_time, columns):
        """Rates between neighbours; NaN where the step is too short to count."""
        times = np.concatenate(([last_time], columns[self.time].astype(np.float64)))
        sizes = np.concatenate(([last_bytes], columns[self.size].astype(np.int64)))
        steps = np.diff(times)
        gained = np.maximum(np.diff(sizes), 0).astype(np.float64)
        counted = steps >= SMALLEST_STEP_S
        return np.where(counted, gained / BYTES_PER_MB / np.where(counted, steps, 1.0), np.nan)

    def _first(self, columns):
        return float(columns[self.time][0]), int(columns[self.size][0])

    def walk(self, state, columns):
        known, columns = self._known(columns)
        if not known.any():
            none = pa.nulls(len(known), pa.float64())
            held = none if state is None else pa.array(np.full(len(known), state[3]), pa.float64())
            return state, {"inst_rate": none, "rate": held, "elapsed_s": none}
        time0, size0 = self._first(columns)
        start, size, time, rate = state or [time0, size0, time0, 0.0]
        before = None if state is None else rate
        instants = self._instants(size, time, columns)
        rates = np.empty(len(instants))
        for i, instant in enumerate(instants.tolist()):
            if instant == instant:
                rate = rate_step(rate, instant)
            rates[i] = rate
        times = columns[self.time].astype(np.float64)
        end = [start, int(columns[self.size][-1]), float(times[-1]), float(rate)]
        out = {
            "inst_rate": pa.array(instants, pa.float64(), mask=np.isnan(instants)),
            "rate": pa.array(rates, pa.float64()),
            "elapsed_s": pa.array(times - start, pa.float64()),
        }
        return end, out if known.all() else self._between(out, known, before)

    def _between(self, out, known, before):
        """Rows that are no samples among those that are: the last rate stays, the other columns are null."""
        at = np.cumsum(known) - 1  # the last sample at or before each row
        taken = {n: v.take(pa.array(np.maximum(at, 0))) for n, v in out.items()}
        unknown = {n: pc.if_else(pa.array(known), v, pa.scalar(None, pa.float64())) for n, v in taken.items() if n != "rate"}
        first = pa.scalar(before, pa.float64())
        return unknown | {"rate": pc.if_else(pa.array(at >= 0), taken["rate"], first)}

    def unknown(self):
        return None

    def walk_unknown(self, effect, columns):
        known, columns = self._known(columns)
        if not known.any():
            return effect
        time0, size0 = self._first(columns)
        if effect is None:
            # the step into the first row needs the row before it, so it waits
            effect = {"first": [time0, size0], "last": [time0, size0], "pieces": [], "a": 1.0, "b": 0.0}
        time, size = effect["last"]
        pieces, a, b = [tuple(p) for p in effect["pieces"]], effect["a"], effect["b"]
        instants = self._instants(size, time, columns)
        for instant in instants.tolist():
            if instant != instant:
                continue
            moved = [(bound, rate_step(value, instant)) for bound, value in pieces]
            if b <= NO_RATE:
                bound = (NO_RATE - b) / a if a > 0.0 else float("inf")
                if not pieces or bound > pieces[-1][0]:
                    moved.append((bound, instant))
            pieces = [p for p, after in zip(moved, [*moved[1:], None]) if after is None or after[1] != p[1]]
            a, b = OLDER_SHARE * a, NEWEST_SHARE * instant + OLDER_SHARE * b
        last = [float(columns[self.time][-1]), int(columns[self.size][-1])]
        return {"first": effect["first"], "last": last, "pieces": pieces, "a": a, "b": b}

    def apply(self, effect, state):
        if effect is None:
            return state
        time0, size0 = effect["first"]
        start, size, time, rate = state or [time0, size0, time0, 0.0]
        instant = self._instants(size, time, {self.time: np.array([time0]), self.size: np.array([size0])})[0]
        if instant == instant:
            rate = rate_step(rate, float(instant))
        for bound, value in effect["pieces"]:
            if rate <= bound:
                rate = value
                break
        else:
            rate = effect["a"] * rate + effect["b"]
        time_last, size_last = effect["last"]
        return [start, size_last, time_last, rate]


def _runs(batch: pa.RecordBatch, series: list[str]) -> Iterator[tuple[str, int, int]]:
    """Neighbouring rows of one series: its key, first row, row after the last."""
    changed = np.zeros(len(batch), dtype=bool)
    changed[0] = True
    columns = [batch.column(batch.schema.get_field_index(s)) for s in series]
    for column in columns:
        values = column.to_numpy(zero_copy_only=False)
        changed[1:] |= values[1:] != values[:-1]
    starts = np.flatnonzero(changed).tolist()
    for first, after in zip(starts, [*starts[1:], len(batch)]):
        yield json.dumps([c[first].as_py() for c in columns], default=str), first, after


def _inputs(batch: pa.RecordBatch, names: list[str], first: int, after: int) -> dict:
    part = batch.slice(first, after - first)
    return {n: part.column(part.schema.get_field_index(n)).to_numpy(zero_copy_only=False) for n in names}


def _summaries(chunked: DataFrame, series: list[str], kernel) -> list:
    """One row per chunk: its first and last series and its effect on the state."""

    def summarise(batches):
        chunk = first_key = key = state = effect = None
        for batch in batches:
            if not len(batch):
                continue
            chunk = batch.column(batch.schema.get_field_index("_chunk"))[0].as_py()
            for run_key, first, after in _runs(batch, series):
                columns = _inputs(batch, kernel.inputs, first, after)
                if first_key is None:
                    first_key, effect = run_key, kernel.unknown()
                elif run_key != key:
                    state = kernel.fresh()
                key = run_key
                if key == first_key:
                    effect = kernel.walk_unknown(effect, columns)
                else:
                    state, _ = kernel.walk(state, columns)
        if chunk is not None:
            row = [[chunk], [first_key], [key], [json.dumps(effect if key == first_key else state)]]
            yield pa.RecordBatch.from_arrays(
                [pa.array(row[0], pa.int32()), *[pa.array(r, pa.string()) for r in row[1:]]],
                ["chunk", "first_key", "last_key", "result"],
            )

    needed = chunked.select("_chunk", *series, *[i for i in kernel.inputs if i not in series])
    return needed.mapInArrow(summarise, "chunk int, first_key string, last_key string, result string").collect()


def _entry_states(summaries: list, kernel) -> dict[int, tuple]:
    """What each chunk is entered with: the series that is open and its state."""
    entries: dict[int, tuple] = {}
    key, state = None, None
    for row in sorted(summaries, key=lambda r: r.chunk):
        entries[row.chunk] = (key, state)
        result = json.loads(row.result)
        if row.first_key == row.last_key:
            entered = state if key == row.first_key else kernel.fresh()
            state = kernel.apply(result, entered)
        else:
            state = result
        key = row.last_key
    return entries


def scan(chunked: DataFrame, series: list[str], kernel) -> DataFrame:
    """``chunked`` plus the kernel's columns. Narrow: rows stay in their chunks."""
    entries = _entry_states(_summaries(chunked, series, kernel), kernel)
    schema = T.StructType([*chunked.schema.fields, *[T.StructField(n, t) for n, t in kernel.fields]])

    def produce(batches):
        key, state = None, None
        started = False
        for batch in batches:
            if not len(batch):
                continue
            if not started:
                chunk = batch.column(batch.schema.get_field_index("_chunk"))[0].as_py()
                key, state = entries[chunk]
                started = True
            outs = {name: [] for name, _ in kernel.fields}
            for run_key, first, after in _runs(batch, series):
                if run_key != key:
                    key, state = run_key, kernel.fresh()
                state, out = kernel.walk(state, _inputs(batch, kernel.inputs, first, after))
                for name, values in out.items():
                    outs[name].append(values)
            arrays = [*batch.columns, *[pa.concat_arrays(outs[name]) for name, _ in kernel.fields]]
            yield pa.RecordBatch.from_arrays(arrays, [*batch.schema.names, *outs])

    return chunked.mapInArrow(produce, schema)


def running_total(chunked: DataFrame, series: list[str], value: str, out: str) -> DataFrame:
    """Bytes moved so far within each series."""
    return scan(chunked, series, RunningTotal(value, out))


def rates(chunked: DataFrame, series: list[str], time: str = "t_s", size: str = "bytes_current") -> DataFrame:
    """Adds ``inst_rate`` and ``rate`` in MB/s and ``elapsed_s`` to byte samples.

    A row without a time or a size is no sample: the last rate stays, the other columns are null there.
    The first sample of a task sets the mark; a step shorter than 0.1 s moves
    the mark but gives no rate, and a falling byte count counts as none.
    """
    return scan(chunked, series, SmoothedRate(time, size))
