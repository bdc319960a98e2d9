import datetime
import os
import threading
from concurrent.futures import ThreadPoolExecutor

import pytest
from pyspark.sql import functions as F

from tablehaul.operators import versions
from tablehaul.operators.ledger import SCHEMA


def wave(spark, names, day=1, size=1):
    at = datetime.datetime(2024, 1, day)
    return spark.createDataFrame([("db", n, n, size, at) for n in names], SCHEMA)


def names(df):
    return sorted(r.relative_path for r in df.collect())


def test_versions_and_changes(spark, work):
    assert versions.latest_version(spark, work) == 0 and names(versions.read(spark, work)) == []
    assert versions.append(wave(spark, "ab"), work) == 1
    assert versions.append(wave(spark, "bc", 2, 9), work) == 2
    assert versions.append(wave(spark, ""), work) == 3
    assert names(versions.read(spark, work, 1)) == ["a", "b"]
    assert {r.relative_path: r.size_bytes for r in versions.read(spark, work).collect()} == {"a": 1, "b": 9, "c": 9}
    assert names(versions.changes(spark, work, 1)) == ["b", "c"] and names(versions.changes(spark, work, 0, 1)) == ["a", "b"]


def test_writers_at_one_time_take_different_numbers(spark, work):
    with ThreadPoolExecutor(6) as pool:
        taken = list(pool.map(lambda i: versions.append(wave(spark, [f"n{i}"]), work), range(6)))
    assert sorted(taken) == [1, 2, 3, 4, 5, 6]
    assert names(versions.read(spark, work)) == [f"n{i}" for i in range(6)]
    assert len(os.listdir(f"{work}/data")) == 6  # a folder a wave


@pytest.mark.parametrize("keep", [0, 3, 15, 40])
def test_a_torn_last_commit_is_void(spark, work, keep):
    versions.append(wave(spark, "a"), work)
    versions.append(wave(spark, "b"), work)
    torn = versions._file(work, 2)
    whole = open(torn, "rb").read()
    open(torn, "wb").write(whole[:keep])
    assert versions.latest_version(spark, work) == 1 and names(versions.read(spark, work)) == ["a"]
    assert versions.append(wave(spark, "c"), work) == 3
    assert names(versions.read(spark, work)) == ["a", "c"] and names(versions.changes(spark, work, 0)) == ["a", "c"]
    versions.compact(spark, work)
    open(torn, "wb").write(whole)  # the writer was only slow: its number counts, whatever came behind it
    assert names(versions.read(spark, work)) == ["a", "b", "c"]


def test_a_writer_that_dies_before_its_commit_leaves_nothing(spark, work, monkeypatch):
    versions.append(wave(spark, "a"), work)
    with monkeypatch.context() as m:
        m.setattr(versions, "_commit", lambda *a: 1 / 0)
        with pytest.raises(ZeroDivisionError):
            versions.append(wave(spark, "b"), work)
    assert names(versions.read(spark, work)) == ["a"]


def test_compaction(spark, work):
    for i in range(4):
        versions.append(wave(spark, ["same", f"n{i}"], i + 1, i), work)
    before = sorted(map(tuple, versions.read(spark, work).collect()))
    assert versions.compact(spark, work) == 5 and len(versions._live(spark, work, None)) == 1
    assert sorted(map(tuple, versions.read(spark, work).collect())) == before
    assert names(versions.read(spark, work, 2)) == ["n0", "n1", "same"]
    assert versions.compact(spark, work) == 5  # nothing to fold


def test_an_append_during_a_compaction_stays_and_a_second_compaction_conflicts(spark, work, monkeypatch):
    versions.append(wave(spark, "a"), work)
    versions.append(wave(spark, "b"), work)
    real, first = versions._commit, threading.Event()

    def late(*args):
        if not first.is_set():
            first.set()
            versions.append(wave(spark, "c"), work)
            versions.compact(spark, work)
        return real(*args)

    monkeypatch.setattr(versions, "_commit", late)
    with pytest.raises(versions.Conflict):
        versions.compact(spark, work)
    assert names(versions.read(spark, work)) == ["a", "b", "c"]


def test_null_fields_and_repeated_records(spark, work):
    rows = spark.createDataFrame([(None, "a", None, None, None), (None, "a", None, None, None)], SCHEMA)
    versions.append(rows.unionAll(rows), work)
    assert versions.read(spark, work).select(F.count("*")).first()[0] == 1
