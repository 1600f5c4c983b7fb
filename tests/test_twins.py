"""Every query with a SQL twin, row for row, on the smallest tables."""

import pytest

import __spark_entry__ as contract
from check import compare, twin
from tests.conftest import SMALL

SQL = contract.oracle_sql()


@pytest.fixture(scope="module")
def connection():
    return twin(SMALL)


@pytest.mark.parametrize("name", sorted(SQL))
def test_twin(spark, connection, name):
    assert compare(contract.queries()[name](spark, SMALL), connection.sql(SQL[name])) == []


def test_every_twin_has_a_query():
    assert set(SQL) <= set(contract.queries())
