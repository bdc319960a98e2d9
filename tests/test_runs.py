"""Formats, finished lists, ledger, rates, whole runs and streams."""

import json
import math
import os
import random

import numpy as np
import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from tablehaul.functions import text
from tablehaul.operators import ledger, runs, sequence
from tablehaul.operators.dump_writer import write_dump
from tablehaul.operators.joins import salted_join
from tablehaul.operators.restore import restore_as_table
from tablehaul.plans.export import export_plan, run_export
from tablehaul.plans.imports import candidates, import_plan, run_import
from tablehaul.sources import finished
from tablehaul.sources.catalog import parquet_tables, session_databases, session_tables
from tablehaul.sources.dump_reader import read_dump
from tablehaul.sources.inventory import list_dumps
from tablehaul.streaming import rates, reports
from tablehaul.streaming.restore import restore_new_files


def _texts(spark, function, cases):
    df = spark.createDataFrame([(i, *c) for i, c in enumerate(cases)], None)
    names = df.columns
    got = df.select(names[0], function(*[F.col(n) for n in names[1:-1]]).alias("got"), F.col(names[-1]).alias("want"))
    return [r for r in got.orderBy(names[0]).collect() if r.got != r.want]


def test_format_bytes(spark):
    cases = [
        (0, "0 B"), (500, "500 B"), (1023, "1023 B"), (1024, "1.00 KB"), (1152, "1.12 KB"), (1157, "1.13 KB"), (1536, "1.50 KB"),
        (1048576, "1.00 MB"), (1073741824, "1.00 GB (1,024.00 MB)"), (1048575, "1024.00 KB"), (1941530542, "1.81 GB (1,851.59 MB)"),
        (2**62, "4294967296.00 GB (4,398,046,511,104.00 MB)"),
    ]
    assert _texts(spark, text.format_bytes, cases) == []
    compact = [(500, "500 B"), (1152, "1.1 KB"), (1280, "1.2 KB"), (1331, "1.3 KB"), (47395635, "45.20 MB"), (2**30, "1.00 GB")]
    assert _texts(spark, text.format_bytes_compact, compact) == []


def test_format_bytes_as_floats_print(spark):
    rng = random.Random(3)
    sizes = [rng.randrange(1024, 2**40) for _ in range(2000)] + [1024 * k + 64 * j for k in range(1, 40) for j in range(16)]

    def want(n):
        if n < 2**20:
            return f"{n / 1024:.2f} KB"
        return f"{n / 2**20:.2f} MB" if n < 2**30 else f"{n / 2**30:.2f} GB ({n / 2**20:,.2f} MB)"

    assert _texts(spark, text.format_bytes, [(n, want(n)) for n in sizes]) == []


def test_numbers_and_durations(spark):
    commas = [(1851.58, "1,851.58"), (100.5, "100.50"), (1234567.89, "1,234,567.89"), (-1234.5, "-1,234.50"), (0.0, "0.00")]
    assert _texts(spark, text.format_with_commas, commas) == []
    spans = [(5.0, "00:05"), (65.9, "01:05"), (3665.0, "01:01:05"), (0.0, "00:00"), (360000.0, "100:00:00"), (3599.99, "59:59")]
    assert _texts(spark, text.format_duration, spans) == []


def test_eta_and_percent(spark):
    mb = 1048576
    cases = [
        (50 * mb, 100 * mb, 10.0 * mb, 5.0), (100 * mb, 100 * mb, 10.0 * mb, None), (0, 100, 0.0, None), (0, 100, 10.0, None),
        (0, 10**12, 11.0, None), (0, 100, 11.0, 100 / 11),
    ]
    assert _texts(spark, text.eta_seconds, cases) == []
    assert _texts(spark, text.percent_done, [(50, 100, 50.0), (100, 100, 99.9), (1, 0, 0.0)]) == []


def test_error_snippet(spark):
    cases = [
        ("warning\nERROR 1064 (42000)\nmore", "ERROR 1064 (42000)"), ("  first error\nsecond", "first error"),
        ("x\r\nError: y\r\n", "Error: y"), ("  \n ", text.IMPORT_SILENT),
    ]
    assert _texts(spark, text.error_snippet, cases) == []
    silent = spark.range(1).select(text.error_snippet(F.lit(None).cast("string"), text.EXPORT_SILENT).alias("s"))
    assert silent.first().s == text.EXPORT_SILENT


def _write(path, content):
    os.makedirs(os.path.dirname(path), exist_ok=True)
    with open(path, "w") as f:
        f.write(content)


def _found(spark, work, **kw):
    row = finished.discover(spark, work + "/logs", work + "/dumps", **kw).first()
    return None if row is None else (row.path[len(work) :], row.form, sorted(row.entries))


def test_finished_lists(spark, work):
    assert _found(spark, work) is None
    _write(work + "/dumps/.import_manifest.json", '{"completed_files": ["last.sql"]}')
    assert _found(spark, work) == ("/dumps/.import_manifest.json", "object", ["last.sql"])
    _write(work + "/dumps/manifest.json", '["a.sql", "b.sql"]')
    assert _found(spark, work) == ("/dumps/manifest.json", "array", ["a.sql", "b.sql"])
    _write(work + "/dumps/logs/manifest.json", '{"completed_files": ["t1.sql"], "completed_tables": ["t2", "t1.sql"]}')
    assert _found(spark, work) == ("/dumps/logs/manifest.json", "object", ["t1.sql", "t2"])
    _write(work + "/logs/manifest.json", "{}")
    assert _found(spark, work)[0] == "/dumps/logs/manifest.json"
    _write(work + "/logs/manifest.json", '{"completed_files": [\n  "x.sql",\n  "y.SQL",\n "z.sql.gz",\n nonsense')
    assert _found(spark, work) == ("/logs/manifest.json", "lines", ["x.sql", "y.SQL", "z.sql.gz"])
    assert _found(spark, work, strict_lines=True)[2] == ["x.sql", "y.SQL"]
    _write(work + "/logs/manifest.json", "damaged")
    _write(work + "/logs/manifest.json.bak", json.dumps({"completed_files": ["saved.sql"], "last_updated": "2024-01-01T00:00:00Z"}))
    assert _found(spark, work) == ("/logs/manifest.json", "backup", ["saved.sql"])
    assert _found(spark, work, explicit=work + "/nowhere.json") is None


def _tasks(spark, names):
    rows = [(n, n.rsplit("/", 1)[-1], n, n.split("/")[0], 10 * (i + 1)) for i, n in enumerate(names)]
    return spark.createDataFrame(rows, "path string, file_name string, relative_path string, database string, size_bytes bigint")


def test_resume(spark):
    tasks = _tasks(spark, ["a/users.sql", "a/orders.sql", "b/Items.SQL.gz", "b/left.sql"])
    entries = spark.createDataFrame([("USERS.SQL",), ("old/dir/orders.sql",), ("B/ITEMS.sql.GZ",), ("other.sql",)], "entry string")
    assert [r.path for r in ledger.pending(tasks, entries).collect()] == ["b/left.sql"]
    assert ledger.finished(tasks, entries).count() == 3
    assert ledger.skipped_totals(tasks, entries).first().asDict() == {
        "skipped_files": 3, "skipped_bytes": 60, "remaining_files": 1, "remaining_bytes": 40,
    }
    assert [tuple(r) for r in ledger.database_breakdown(tasks, entries).collect()] == [("b", 1, 40, 1)]
    existing = spark.createDataFrame([("A",)], "database string")
    assert [r.database for r in ledger.missing_databases(tasks, existing).collect()] == ["b"]


def test_a_very_common_name(spark):
    tasks = spark.range(3000).select(
        F.concat(F.lit("d"), "id", F.lit("/data.sql")).alias("path"), F.when(F.col("id") % 3 == 0, "data.sql").otherwise(F.concat("id", F.lit(".sql"))).alias("file_name"),
        F.lit("d").alias("database"), F.lit(1).cast("bigint").alias("size_bytes"),
    )
    entries = spark.createDataFrame([("data.sql",), ("1.sql",)], "entry string")
    assert ledger.pending(tasks, entries).count() == 1999
    assert ledger.skipped_totals(tasks, entries).first().skipped_files == 1001


def test_ledger_keeps_equal_names_apart(spark, work):
    tasks = _tasks(spark, ["a/users.sql", "b/users.sql"])
    for _ in range(2):
        ledger.append_finished(tasks.limit(1).withColumn("finished_at", F.current_timestamp()), work + "/ledger")
    latest = ledger.read_ledger(spark, work + "/ledger")
    assert latest.count() == 1
    assert [r.path for r in ledger.pending_exact(tasks, latest).collect()] == ["b/users.sql"]


def test_many_record_at_once(spark, work):
    from concurrent.futures import ThreadPoolExecutor

    tasks = _tasks(spark, [f"a/t{i}.sql" for i in range(12)]).withColumn("finished_at", F.current_timestamp())
    with ThreadPoolExecutor(6) as pool:
        list(pool.map(lambda i: ledger.append_finished(tasks.where(F.col("path") == f"a/t{i}.sql"), work + "/ledger"), range(12)))
    assert ledger.read_ledger(spark, work + "/ledger").count() == 12


def test_create_databases(spark):
    missing = spark.createDataFrame([("made_here",)], "database string")
    ledger.create_databases(spark, missing)
    assert "made_here" in {r.database for r in session_databases(spark).collect()}
    spark.sql("DROP DATABASE made_here")


def _fold(samples):
    """The rate rule, one series at a time, in plain Python."""
    out, series = {}, {}
    for worker, event, t, size in sorted(samples, key=lambda r: (r[0], r[2], r[1])):
        if worker not in series:
            series[worker] = [t, size, 0.0]
            out[event] = (None, 0.0)
            continue
        last_t, last_size, rate = series[worker]
        instant = None
        if t - last_t >= 0.1:
            instant = max(size - last_size, 0) / 1048576.0 / (t - last_t)
            rate = instant if rate <= 0.001 else 0.25 * instant + 0.75 * rate
        series[worker] = [t, size, rate]
        out[event] = (instant, rate)
    return out


@pytest.mark.parametrize("shape", ["mixed", "one", "stalls", "near_zero"])
@pytest.mark.parametrize("chunks", [1, 7, 40])
def test_rates_against_fold(spark, shape, chunks):
    rng = random.Random(f"{shape}{chunks}")
    samples, size, t = [], 0, 0.0
    for event in range(1200):
        worker = 1 if shape != "mixed" or event % 3 == 0 else rng.randrange(2, 30)
        t += rng.choice([0.02, 0.1, 0.2, 0.2, 0.5])
        if shape == "near_zero":
            size += rng.choice([0, 0, 50, 200, 900])
        elif shape == "stalls":
            size += 0 if (event // 60) % 2 else rng.randrange(0, 2_000_000)
        else:
            size += rng.choice([0, 1000, 3_000_000, -500])
        samples.append((worker, event, t, max(size, 0)))
    df = spark.createDataFrame(samples, "worker int, event_id int, t_s double, bytes_current bigint")
    chunked = sequence.in_chunks(df, ["worker"], ["t_s", "event_id"], chunks)
    got = {r.event_id: r for r in sequence.rates(chunked, ["worker"]).collect()}
    want = _fold(samples)
    assert len(got) == len(want)
    for event, (instant, rate) in want.items():
        assert got[event].inst_rate == instant or math.isclose(got[event].inst_rate, instant, rel_tol=1e-12)
        assert math.isclose(got[event].rate, rate, rel_tol=1e-9, abs_tol=1e-12), event


def test_running_total_over_chunks(spark):
    df = spark.range(0, 5000).selectExpr("id as k", "case when id % 3 = 0 then 'hot' else concat('w', id % 97) end as w", "id % 11 as v")
    got = sequence.running_total(sequence.in_chunks(df, ["w"], ["k"], 13), ["w"], "v", "total")
    want = df.selectExpr("k", "cast(sum(v) over (partition by w order by k) as bigint) as total")
    assert got.select("k", "total").exceptAll(want).count() == 0 and got.count() == 5000


def test_salted_join(spark):
    rows = spark.range(2000).selectExpr("id", "case when id % 3 = 0 then 1 else id end as k")
    per_key = spark.range(0, 2000, 2).selectExpr("id + 1 as k", "id as v")
    want = rows.join(per_key, "k")
    got = salted_join(rows, per_key, ["k"], F.col("id"))
    assert got.select(want.columns).exceptAll(want).count() == 0 and got.count() == want.count()


def test_phases(spark):
    rows = [
        (100, 100, 1.0, 9.0, "finalizing"), (10, 100, 0.0, 1.0, "warm-up"), (10, 100, 0.01, 6.0, "stalled"),
        (10, 100, 0.01, 4.0, "streaming"), (10, 100, 2.0, 6.0, "streaming"), (5, 0, 2.0, 6.0, "streaming"),
    ]
    df = spark.createDataFrame(rows, "bytes_current bigint, total_bytes bigint, rate double, elapsed_s double, want string")
    assert runs.task_phase(df).where("phase <> want").count() == 0


def _shop(spark, work):
    root = work + "/tables"
    spark.range(0, 500, 1, 4).selectExpr("id", "concat('it''s ', id) as s").write.parquet(root + "/people")
    spark.range(0, 90, 1, 2).selectExpr("id", "cast(null as string) as s", "id / 7 as d").write.parquet(root + "/prices")
    return root


def test_export_then_import_then_resume(spark, work):
    root = _shop(spark, work)
    plan = export_plan(parquet_tables(spark, root, "shop"), work + "/dumps", compress=True, databases="shop")

    def read(_, name):
        return spark.read.parquet(f"{root}/{name}")

    wrote = run_export(spark, plan, read, compress=True)
    assert runs.summary(wrote).first().completed == 2
    _write(work + "/dumps/shop__broken.sql", "-- Database: `shop`\nCREATE TABLE `broken` (`i` int);\nINVALID SQL SYNTAX FAIL HERE;\n")
    first = import_plan(candidates(spark, work + "/dumps"))
    events = run_import(spark, first, work + "/restored", work + "/ledger")
    total = runs.summary(events).first()
    assert (total.started, total.completed, total.failed) == (3, 2, 1)
    for name in ("people", "prices"):
        back = spark.read.parquet(f"{work}/restored/shop/{name}")
        assert back.exceptAll(read(None, name)).count() == 0 and back.count() == read(None, name).count()
    assert not os.path.exists(work + "/restored/shop/broken/_SUCCESS")

    failed = runs.failures(events, work + "/logs")
    row = failed.first()
    assert row.file_name == "shop__broken.sql" and "dump not understood" in row.error_snippet + (row.message or "")
    assert row.log_path.endswith("/logs/shop__shop__broken.sql.err.log")
    assert runs.write_failure_logs(failed, work + "/logs/failures")
    assert "Database: shop\nFile: " in spark.read.json(work + "/logs/failures").first().log_text
    assert not runs.write_failure_logs(failed.where("false"), work + "/logs/none")
    assert runs.write_failed_files(failed, work + "/logs/failed_files.txt")

    resumed = import_plan(candidates(spark, work + "/dumps"), ledger=ledger.read_ledger(spark, work + "/ledger"))
    assert [r.file_name for r in resumed.collect()] == ["shop__broken.sql"]

    from tablehaul.sources.inventory import resolve_retry, retry_lines

    listed = spark.read.text(work + "/logs/failed_files.txt").withColumn("line_no", F.monotonically_increasing_id())
    known = list_dumps(spark, work + "/dumps")
    retried = known.join(resolve_retry(retry_lines(listed), known, F.lit(work + "/dumps")), "path")
    assert [r.file_name for r in candidates(spark, work + "/dumps", items=retried).collect()] == ["shop__broken.sql"]

    _write(work + "/dumps/shop__broken.sql", "-- Database: `shop`\nCREATE TABLE `broken` (`i` int);\nINSERT INTO `broken` VALUES (1);\n")
    again = import_plan(candidates(spark, work + "/dumps"), ledger=ledger.read_ledger(spark, work + "/ledger"))
    assert runs.summary(run_import(spark, again, work + "/restored", work + "/ledger")).first().completed == 1
    assert spark.read.parquet(work + "/restored/shop/broken").collect()[0].i == 1
    assert import_plan(candidates(spark, work + "/dumps"), ledger=ledger.read_ledger(spark, work + "/ledger")).count() == 0
    assert runs.summary(run_export(spark, plan, read, compress=True)).first().completed == 2


def test_restore_as_table(spark, work):
    spark.sql(f"CREATE DATABASE restored_db LOCATION '{work}/db'")
    df = spark.range(9).selectExpr("id", "concat('v', id) as s")
    write_dump(df, work + "/t.sql", "restored_db", "t")
    for _ in range(2):
        restore_as_table(spark, work + "/t.sql", "restored_db", "t")
    assert spark.table("restored_db.t").exceptAll(df).count() == 0 and spark.table("restored_db.t").count() == 9
    assert [(r.table_name, r.table_type) for r in session_tables(spark, "restored_db").collect()] == [("t", "BASE TABLE")]
    spark.sql("DROP DATABASE restored_db CASCADE")


def test_a_failing_table_does_not_stop_the_others(spark, work):
    root = _shop(spark, work)
    spark.sql("select double('NaN') as d").write.parquet(root + "/odd")
    plan = export_plan(parquet_tables(spark, root, "shop"), work + "/dumps", database="shop")
    events = run_export(spark, plan, lambda _, name: spark.read.parquet(f"{root}/{name}"))
    assert {r.file_name: r.kind for r in events.where("kind <> 'started'").collect()} == {
        "odd.sql": "failed", "people.sql": "finished", "prices.sql": "finished",
    }
    assert list_dumps(spark, work + "/dumps").where("file_name = 'odd.sql'").count() == 0
    assert runs.worker_status(events).count() == 0


def test_stream_restores_each_file_once(spark, work):
    folder, out, checkpoint = work + "/in", work + "/out", work + "/checkpoint"
    df = spark.range(100).selectExpr("id", "concat('n''', id) as s")
    for i in range(3):
        write_dump(df.where(f"id % 3 = {i}"), f"{folder}/t{i}.sql", "d", "t")
        restore_new_files(spark, folder, df.schema, out, checkpoint, "t", files_per_batch=2)
        restore_new_files(spark, folder, df.schema, out, checkpoint, "t")
    back = spark.read.parquet(out)
    assert back.count() == 100 and back.exceptAll(df).count() == 0
    _write(folder + "/bad.sql", "INSERT INTO `t` VALUES (1);\n")
    with pytest.raises(PySparkException):
        restore_new_files(spark, folder, df.schema, out, checkpoint, "t")
    assert spark.read.parquet(out).count() == 100


def test_a_stream_does_not_mix_tables(spark, work):
    _write(work + "/in/x.sql", "INSERT INTO `t` VALUES (1);\nINSERT INTO `u` VALUES (2);\n")
    with pytest.raises(PySparkException):
        restore_new_files(spark, work + "/in", spark.range(1).schema, work + "/out", work + "/c", "t")


@pytest.mark.parametrize("chunks", [1, 2, 5])
def test_rates_pass_over_samples_without_a_size(spark, chunks):
    mb = 1 << 20
    rows = [(i, 1, float(i), size) for i, size in enumerate([None, 0, mb, None, None, 3 * mb, 3 * mb, None])] + [(20 + i, 2, float(i), None) for i in range(4)]
    rows += [(30, 3, None, mb), (31, 3, 1.0, mb), (32, 3, 2.0, 5 * mb)]
    df = spark.createDataFrame(rows, "event_id long, worker long, t_s double, bytes_current long")
    got = {r.event_id: (r.inst_rate, r.rate) for r in sequence.rates(sequence.in_chunks(df, ["worker"], ["t_s", "event_id"], chunks), ["worker"]).collect()}
    assert [got[i] for i in range(8)] == [
        (None, None), (None, 0.0), (1.0, 1.0), (None, 1.0), (None, 1.0), (2 / 3, 0.25 * (2 / 3) + 0.75), (0.0, 0.75 * (0.25 * (2 / 3) + 0.75)), (None, 0.75 * (0.25 * (2 / 3) + 0.75)),
    ]
    assert all(got[20 + i] == (None, None) for i in range(4)) and got[30] == (None, None) and got[32] == (4.0, 4.0)


def test_stream_rates_drop_samples_older_than_state(spark, work):
    def feed(rows):
        df = spark.createDataFrame(rows, "event_id bigint, worker bigint, t_s double, bytes_current bigint")
        df.write.mode("append").parquet(work + "/in")
        rates.smoothed_rates(spark.readStream.schema(df.schema).parquet(work + "/in"), work + "/out", work + "/c")

    feed([(1, 1, 0.0, 0), (2, 1, 1.0, 1048576)])
    feed([(3, 1, 0.5, 99), (4, 1, 2.0, 1048576 * 3)])
    got = {r.event_id: r.rate for r in spark.read.schema(rates.OUTPUT).parquet(work + "/out").collect()}
    assert got == {1: 0.0, 2: 1.0, 4: 0.25 * 2 + 0.75 * 1}


def test_stream_rates_cut_a_batch_and_count_what_is_late(spark, work):
    schema = "event_id bigint, worker bigint, t_s double, bytes_current bigint"
    rows = [(i, w, i * 0.25, i * i * 40_000) for i in range(400) for w in (1, None)] + [(i, 2, i * 0.5, i << 20) for i in range(5)]
    halves = [[r for r in rows if r[0] < 150], [r for r in rows if r[0] >= 150] + [(900, 1, 3.0, 5), (901, 3, None, 5), (902, None, 0.0, 5)]]
    counts = []
    for half in halves:
        df = spark.createDataFrame(half, schema)
        df.write.mode("append").parquet(work + "/in")
        stream = spark.readStream.schema(df.schema).parquet(work + "/in")
        counts.append(rates.smoothed_rates(stream, work + "/out", work + "/c"))
    late = spark.read.schema(rates.LATE).parquet(work + "/out-late").collect()
    assert counts == [0, 3] and sorted(r.event_id for r in late) == [900, 901, 902]
    got = {(r.event_id, r.worker): r for r in spark.read.schema(rates.OUTPUT).parquet(work + "/out").collect()}
    assert len(got) == len(rows)
    for worker in (1, 2, None):
        mine = [r for r in rows if r[1] == worker]
        columns = {"t_s": np.array([r[2] for r in mine]), "bytes_current": np.array([r[3] for r in mine])}
        _, want = sequence.SmoothedRate().walk(None, columns)
        for r, rate, elapsed in zip(mine, want["rate"].to_pylist(), want["elapsed_s"].to_pylist()):
            assert got[r[0], worker].rate == pytest.approx(rate, rel=1e-9) and got[r[0], worker].elapsed_s == elapsed


def test_stream_throughput_drops_late_events(spark, work):
    def feed(rows):
        df = spark.createDataFrame(rows, "ts string, kind string, size_bytes bigint").withColumn("ts", F.col("ts").cast("timestamp_ntz"))
        df.write.mode("append").parquet(work + "/in")
        reports.throughput(spark.readStream.schema(df.schema).parquet(work + "/in"), work + "/out", work + "/c")

    feed([("2024-01-01 00:10:00", "finished", 5), ("2024-01-01 03:00:00", "finished", 7), ("2024-01-01 03:01:00", "started", 9)])
    feed([("2024-01-01 00:20:00", "finished", 100), ("2024-01-01 02:55:00", "finished", 1), ("2024-01-01 03:30:00", "finished", 2)])
    got = {str(r.window_start): (r.finished, r.size_bytes) for r in reports.latest_throughput(spark, work + "/out").collect()}
    assert got == {"2024-01-01 00:00:00": (1, 5), "2024-01-01 02:00:00": (1, 1), "2024-01-01 03:00:00": (2, 9)}
