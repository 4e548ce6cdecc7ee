from __future__ import annotations

import pytest

import __spark_entry__ as contract
from qaprep.plans import oracles, queries
from tests.compare import compare, connect

SF = "/root/testdata/sf0.001"
QUERIES, ORACLES = contract.queries(), contract.oracle_sql()
OWN = set(queries.QUERIES)  # without those of the subpackage that may be left out


@pytest.fixture(scope="module")
def tables():
    return connect(SF)


def test_every_oracle_has_a_query():
    assert set(ORACLES) <= set(QUERIES)
    assert set(oracles.ORACLES) <= OWN <= set(QUERIES)
    assert OWN <= set(ORACLES)


def test_entry(spark):
    df = contract.entry(spark)
    assert df.columns[0] == "input_text"
    assert df.count() > 0


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_equals_sql(spark, tables, name):
    assert compare(tables, QUERIES[name](spark, SF), ORACLES[name]) == ""


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLES)))
def test_query_without_sql_runs(spark, name):
    assert QUERIES[name](spark, SF).count() > 0
