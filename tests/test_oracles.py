"""Every registered query against its SQL on the smallest tables."""

import pytest

from __spark_entry__ import entry, oracle_sql, queries
from tests.oracle import compare, connect
from whence.plans import load
from whence.plans.registry import QUERIES

SMALL = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    return connect(SMALL)


load()


def test_every_query_has_sql():
    assert {name for name, q in QUERIES.items() if not q.sql} == set()
    assert set(QUERIES) <= set(queries()) and set(QUERIES) <= set(oracle_sql())


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, con, name):
    result = compare(spark, con, name, SMALL)
    assert result["ok"], result["why"]


def test_entry(spark):
    assert entry(spark).count() > 0
