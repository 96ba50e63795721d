"""Every registered query against its SQL oracle on the smallest data folder."""

import pytest

import __spark_entry__ as entry
from tests.check_oracles import compare, oracle_connection

FOLDER = "/root/testdata/sf0.001"
QUERIES = entry.queries()
ORACLES = entry.oracle_sql()


@pytest.fixture(scope="module")
def con():
    return oracle_connection(FOLDER)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query_equals_oracle(spark, con, name):
    _, problem, _ = compare(spark, con, name, QUERIES[name], ORACLES.get(name), FOLDER)
    assert problem is None, problem


def test_every_oracle_belongs_to_a_query():
    assert set(ORACLES) <= set(QUERIES)


def test_entry_returns_rows(spark):
    assert entry.entry(spark).count() > 0
