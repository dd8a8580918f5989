"""Every registered query against its checking SQL."""

import pytest
from oracle import connect, differences

import __spark_entry__ as contract

QUERIES, ORACLES = contract.queries(), contract.oracle_sql()


@pytest.fixture(scope="module")
def con(folder):
    return connect(folder)


def test_every_check_belongs_to_a_query():
    assert set(ORACLES) <= set(QUERIES)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, folder, con, name):
    result = QUERIES[name](spark, folder)
    if name in ORACLES:
        assert differences(result, con, ORACLES[name]) is None
    else:
        assert result.count() >= 0


def test_entry(spark):
    assert contract.entry(spark).count() > 0
