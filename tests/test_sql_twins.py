"""Every query with an SQL twin gives the same rows as the twin, on the smallest tables."""

import pytest

from __spark_entry__ import entry, oracle_sql, queries
from workload.compare import compare, connect

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    return connect(SF)


@pytest.mark.parametrize("name", sorted(oracle_sql()))
def test_matches_sql(spark, con, name):
    ok, note = compare(spark, con, name, queries()[name], oracle_sql()[name], SF)
    assert ok, note


def test_every_twin_has_a_query():
    assert set(oracle_sql()) <= set(queries())


def test_entry(spark):
    assert entry(spark).count() > 0
