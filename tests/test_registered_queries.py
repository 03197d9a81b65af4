"""Every registered query against its SQL on the smallest tables."""

import pytest
from oracle_check import compare, connect

from __spark_entry__ import entry, oracle_sql, queries

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    return connect(SF)


def test_entry_has_rows(spark):
    assert entry(spark).count() > 0


def test_sql_only_for_registered_queries():
    assert set(oracle_sql()) <= set(queries())


@pytest.mark.parametrize("name", sorted(oracle_sql()))
def test_query_equals_sql(spark, con, name):
    ok, note = compare(spark, con, name, SF, queries()[name], oracle_sql()[name])
    assert ok, note
