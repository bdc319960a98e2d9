"""How often an import reads a dump."""

from tablehaul.operators.dump_writer import write_dump
from tablehaul.plans.imports import candidates, import_plan, run_import
from tablehaul.sources import dump_reader


def test_an_import_looks_for_the_schemas_once(spark, work, monkeypatch):
    write_dump(spark.range(9).toDF("id"), f"{work}/in/shop__t.sql.gz", "shop", "t", compress=True)
    found, reads = dump_reader._placed_lines, []
    monkeypatch.setattr(dump_reader, "_placed_lines", lambda *a: reads.append(a) or found(*a))
    run_import(spark, import_plan(candidates(spark, f"{work}/in")), f"{work}/out")
    assert len(reads) == 1
    assert spark.read.parquet(f"{work}/out/shop/t").count() == 9
