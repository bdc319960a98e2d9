import pytest


@pytest.fixture(scope="session")
def texts(spark):
    """Documents with what may go wrong: nulls, blanks, repeats, long words, odd columns."""
    rows = [(i, t) for i, t in enumerate(["", " \n\t ", None, "one", "a b c d", "x" * 5000, "é😀 ü", "same words here now and then", "same  words here now and then"])]
    rows += [(None, "nobody wrote this text at all"), (7, "same words here now and then"), (99, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    for name in ("score", "node", "f", "bands", "_id", "spans", "shard", "seed"):
        df = df.selectExpr("*", f"'clash' AS {name}")
    return df
