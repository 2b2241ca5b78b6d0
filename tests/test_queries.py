"""Every registered query with SQL matches it on the smallest data set."""

from __future__ import annotations

import pytest

import __spark_entry__ as contract
from conftest import SF
from oracle import compare, connect

ORACLES = contract.oracle_sql()


@pytest.fixture(scope="module")
def connection():
    return connect(SF)


def test_every_oracle_has_a_query():
    assert set(ORACLES) <= set(contract.queries())


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_matches_sql(spark, connection, name):
    assert compare(contract.queries()[name](spark, SF), connection, ORACLES[name]) is None


def test_entry(spark):
    assert contract.entry(spark).count() == 1500
