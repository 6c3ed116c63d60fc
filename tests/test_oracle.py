"""All queries of the suite against their SQL on the smallest tables."""

import pytest

import __spark_entry__ as entry
import suite
from tests.oracle import compare, connect

FOLDER = "/root/testdata/sf0.001"
SQL = suite.ORACLES


@pytest.fixture(scope="module")
def con():
    return connect(FOLDER)


@pytest.mark.parametrize("name", sorted(suite.QUERIES))
def test_query(spark, con, name):
    assert compare(spark, con, FOLDER, name, suite.QUERIES[name], SQL.get(name)) == []


def test_entry(spark):
    assert entry.entry(spark).count() > 0


def test_the_comparison_notices_differences(spark, con):
    fn = suite.QUERIES["health"]
    assert compare(spark, con, FOLDER, "health", fn, "SELECT 1::bigint AS health")
    assert compare(spark, con, FOLDER, "health", fn, "SELECT 81::bigint AS other")
