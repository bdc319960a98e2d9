import gzip
import io

import pytest
from pyspark.sql import functions as F

from tablehaul.operators.dump_writer import write_dump
from tablehaul.sources import indexed_gzip
from tablehaul.sources.dump_reader import read_dump, read_indexed_dump
from tablehaul.sources.indexed_gzip import find_blocks, indexed_lines, inflated, read_blocks, write_indexed


@pytest.fixture
def dump(spark, work):
    rows = spark.range(0, 20000, 1, 3).select("id", F.concat(F.lit("a;'\n\\é "), F.sha2(F.col("id").cast("string"), 256)).alias("t"))
    write_dump(rows, f"{work}/d", "shop", "t", block_bytes=64 << 10, buffer_bytes=8 << 10)
    return rows, f"{work}/d"


def test_one_file_is_read_by_many_tasks(spark, dump):
    rows, path = dump
    blocks = read_blocks(spark, path)
    files = blocks.select("file").distinct().count()
    assert files == 4 and blocks.count() > 20  # the structure, and a file for each partition
    lines = indexed_lines(blocks, 32 << 10)
    busy = lines.select(F.spark_partition_id().alias("p")).distinct().count()
    assert busy > 2 * files
    back = read_indexed_dump(spark, path, split_bytes=32 << 10)
    assert back.schema.names == ["id", "t"] and sorted(back.collect()) == sorted(rows.collect())


def test_any_gzip_reader_reads_the_files(spark, dump):
    rows, path = dump
    assert read_dump(spark, path).exceptAll(rows).isEmpty() and read_dump(spark, path).count() == rows.count()
    for file in {r.file for r in read_blocks(spark, path).collect()}:
        assert gzip.open(file).read().startswith(b"-- Table dump")


def test_found_blocks_are_the_written_ones(spark, dump):
    _, path = dump
    found = {tuple(r)[1:] for r in find_blocks(spark, f"{path}/*.sql.gz").collect()}
    assert found == {tuple(r)[1:] for r in read_blocks(spark, path).collect()}


def test_foreign_members_that_cut_lines(spark, work, monkeypatch):
    text = b"".join(b"line %d %s\n" % (i, b"x" * (i % 50)) for i in range(3000)) + b"no end of line"
    cuts = [0, 10, 11, 5000, 5000, 20000, len(text)]
    with open(f"{work}/cut.gz", "wb") as out:
        for a, b in zip(cuts, cuts[1:]):
            out.write(gzip.compress(text[a:b]))
    blocks = find_blocks(spark, f"{work}/cut.gz")
    assert blocks.agg(F.sum("text_bytes"), F.sum("lines")).first() == (len(text), 3001)
    got = [bytes(r.value) for r in indexed_lines(blocks, 1).orderBy("file_block_start").collect()]
    assert sorted(got) == sorted(text.split(b"\n"))


def test_pieces_smaller_than_members(monkeypatch):
    monkeypatch.setattr(indexed_gzip, "_PIECE", 7)
    texts = [b"a" * 10000, b"", b"bc" * 33]
    found = list(inflated(io.BytesIO(b"".join(map(gzip.compress, texts)))))
    assert b"".join(p for p, _ in found) == b"".join(texts)
    assert [end for _, end in found if end is not None][-1] == sum(len(gzip.compress(t)) for t in texts)
    for broken in (gzip.compress(b"abc" * 99)[:-1], gzip.compress(b"abc") + b"\x1f"):
        with pytest.raises(ValueError):
            list(inflated(io.BytesIO(broken)))


def test_damaged_and_unfinished_folders_fail(spark, dump, work):
    _, path = dump
    file = read_blocks(spark, path).orderBy(F.desc("size")).first().file
    with open(file, "r+b") as out:
        out.truncate(out.seek(0, 2) - 5)
    with pytest.raises(Exception, match="its index says"):
        read_indexed_dump(spark, path).count()
    with pytest.raises(Exception, match="PATH_NOT_FOUND"):
        read_blocks(spark, f"{work}/none").count()


def test_empty_text_and_a_folder_written_again(spark, dump):
    _, path = dump
    nothing = spark.createDataFrame([], "value string")
    with pytest.raises(Exception, match="ALREADY_EXISTS"):
        write_indexed(nothing, path, mode="errorifexists")
    write_indexed(nothing, path)
    assert read_blocks(spark, path).count() == 0 and indexed_lines(read_blocks(spark, path)).count() == 0
    write_indexed(spark.createDataFrame([("",), ("a",), ("",)], "value string").coalesce(1), path)
    assert [bytes(r.value) for r in indexed_lines(read_blocks(spark, path)).collect()] == [b"", b"a", b""]
