"""Every registered query against its SQL on the smallest tables."""

import pytest
from compare import compare, connect

from __spark_entry__ import entry, oracle_sql, queries


@pytest.fixture(scope="module")
def db(sf):
    return connect(sf)


def test_entry(spark):
    assert entry(spark).columns == ["username", "topic", "total", "correct", "accuracy"]


def test_sql_belongs_to_queries():
    assert set(oracle_sql()) <= set(queries())


@pytest.mark.parametrize("name", sorted(queries()))
def test_query(spark, db, sf, name):
    problem, _ = compare(spark, db, sf, name)
    assert problem is None
