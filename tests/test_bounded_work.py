"""What a task's Python holds while a dump is written."""

import pyarrow as pa
from pyspark.sql import functions as F

from tablehaul.operators import dump_writer
from tablehaul.operators.dump_writer import write_dump
from tablehaul.sources import indexed_gzip
from tablehaul.sources.indexed_gzip import read_blocks


def test_statements_leave_a_few_at_a_time():
    rows = [f"({i},'{'é' * 500}')" for i in range(9000)]
    batches = [pa.RecordBatch.from_arrays([pa.array(rows[i : i + 4500])], ["value"]) for i in (0, 4500)]
    run = dump_writer._statements("INSERT INTO `t` VALUES ", "-- head", 1 << 18)
    out = list(run(iter(batches)))
    assert len(out) > 4 and max(b.nbytes for b in out) < 3 << 20
    lines = [v for b in out for v in b.column(0).to_pylist()]
    assert lines[0] == "-- head" and max(len(v.encode()) for v in lines) <= 1 << 18
    assert ",".join(v.removeprefix("INSERT INTO `t` VALUES ").removesuffix(";") for v in lines[1:]) == ",".join(rows)


def test_no_batch_is_kept_for_the_open_statement():
    allocated = []

    def batches():
        for _ in range(6):
            yield pa.RecordBatch.from_arrays([pa.array(["(1)", "('" + "x" * (4 << 20) + "')", "(2)"])], ["value"])
            allocated.append(pa.total_allocated_bytes())

    before = pa.total_allocated_bytes()
    for _ in dump_writer._statements("INSERT INTO `t` VALUES ", "-- head", 64 << 10)(batches()):
        pass
    assert max(allocated) - before < 10 << 20


def test_statements_are_compressed_where_they_are_packed(spark, work, monkeypatch):
    calls = []
    inner = indexed_gzip._write
    monkeypatch.setattr(indexed_gzip, "_write", lambda *a: calls.append(a) or inner(*a))
    monkeypatch.setattr(dump_writer, "dump_text", None)  # no text on its way through the JVM
    rows = spark.range(0, 3000, 1, 2).select("id", F.lit("é'\n").alias("t"))
    told = write_dump(rows, f"{work}/d", "shop", "t", block_bytes=5000, buffer_bytes=500)
    assert len(calls) == 1 and told["rows"] == 3000
    assert told["text_bytes"] == read_blocks(spark, f"{work}/d").agg(F.sum("text_bytes")).first()[0]
