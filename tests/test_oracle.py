"""Every registered query that has SQL, compared at the smallest scale."""

from __future__ import annotations

import pytest
from oracle import connect, differences

import __spark_entry__ as entry

ORACLES = entry.oracle_sql()


@pytest.fixture(scope="module")
def con(small):
    return connect(small)


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_equals_sql(spark, con, small, name):
    assert differences(entry.queries()[name](spark, small), con, ORACLES[name]) == []


def test_every_check_has_a_query():
    assert set(ORACLES) <= set(entry.queries())


def test_entry(spark):
    assert len(entry.entry(spark).collect()) == 30
