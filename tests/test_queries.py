"""Every named query against its SQL twin on the smallest tables."""

import duckdb  # noqa: F401
import pytest

from __spark_entry__ import entry, oracle_sql, queries
from tests.compare import compare, database


@pytest.fixture(scope="module")
def con(sf):
    return database(sf)


@pytest.mark.parametrize("name", sorted(queries()))
def test_query(spark, con, sf, name):
    ok, note = compare(spark, con, sf, name)
    assert ok, note


def test_entry(spark):
    assert entry(spark).columns == ["field", "rule", "n_bad", "message"]


def test_twins_belong_to_queries():
    assert set(oracle_sql()) <= set(queries())
