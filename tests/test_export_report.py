import os

from pyspark.sql import functions as F

from tablehaul.operators.dump_writer import write_dump
from tablehaul.plans.export import export_plan, export_report, run_export


def held(folder):
    return sum(os.path.getsize(f"{folder}/{f}") for f in os.listdir(folder) if f.startswith("part-"))


def test_what_was_written_is_counted(spark, work):
    rows = spark.range(0, 1000, 1, 4).select("id", F.lit("é'\n").alias("t"))
    told = write_dump(rows, f"{work}/a", "shop", "t", buffer_bytes=500)
    assert told == {"rows": 1000, "text_bytes": held(f"{work}/a")}
    assert write_dump(rows, f"{work}/b", "shop", "t", block_bytes=1000, buffer_bytes=500) == told
    empty = write_dump(rows.where("id < 0"), f"{work}/c", "shop", "t")
    assert empty == {"rows": 0, "text_bytes": held(f"{work}/c")}
    none = write_dump(spark.createDataFrame([], "id int"), f"{work}/d", "shop", "t")
    assert none == {"rows": 0, "text_bytes": held(f"{work}/d")}
    bare = write_dump(rows, f"{work}/e", "shop", "t", rows=False)
    assert bare == {"rows": 0, "text_bytes": held(f"{work}/e")}


def test_report_of_finished_failed_and_pending_tables(spark, work):
    catalog = spark.createDataFrame([("shop", t, 10, 99) for t in ("good", "bad", "later")], "db string, table_name string, bytes long, rows long")
    plan = export_plan(catalog, work, databases="shop")

    def read(_, name):
        return spark.range(7) if name == "good" else 1 / 0

    events = run_export(spark, plan.where("table_name <> 'later'"), read)
    report = {r.table_name: r for r in export_report(plan, events).collect()}
    assert (report["good"].state, report["good"].written_rows, report["good"].estimated_rows) == ("finished", 7, 99)
    assert report["good"].written_bytes == held(f"{work}/{'shop__good.sql'}")
    assert (report["bad"].state, report["bad"].written_rows, report["bad"].message) == ("failed", None, "division by zero")
    assert (report["later"].state, report["later"].written_bytes) == ("pending", None)
