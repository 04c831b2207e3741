"""Every registered query with SQL is compared with DuckDB on the small tables."""

import pytest

import __spark_entry__ as entry
from opsloom.plans import registry
from tests.oracle import compare, connect

SF = "/root/testdata/sf0.001"
QUERIES, ORACLES = registry()


@pytest.fixture(scope="module")
def con():
    return connect(SF)


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_matches_sql(spark, con, name):
    result = compare(QUERIES[name](spark, SF), con, ORACLES[name])
    assert result["ok"], result


def test_entry(spark):
    assert entry.entry(spark).count() > 0


def test_every_oracle_has_a_query():
    assert set(ORACLES) <= set(QUERIES) and set(QUERIES) <= set(entry.queries())
