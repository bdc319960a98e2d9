"""Every registered query against its SQL."""

import os
import re

import pytest

import __spark_entry__ as entry_points
from compare import connect, difference

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
QUERIES = entry_points.queries()
ORACLES = entry_points.oracle_sql()
# Operators beyond SQL are tested against brute force in a folder of their own.
OWN_TESTS = {n for n in QUERIES if re.match(r"op\d+_|pipeline$", n)}


@pytest.fixture(scope="module")
def con():
    return connect(SF)


def test_every_query_has_an_oracle():
    assert set(QUERIES) - OWN_TESTS <= set(ORACLES) <= set(QUERIES)


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query(spark, con, name):
    assert difference(QUERIES[name](spark, SF), con, ORACLES[name]) is None


def test_entry(spark):
    df = entry_points.entry(spark)
    assert df.count() == 6000 and df.columns[0] == "l_orderkey"
