"""Batch queries next to their SQL on the smallest tables; `check_oracle.py` runs all of them at any scale."""

from pathlib import Path

import pytest

import __spark_entry__ as contract
from tests.check_oracle import compare, connect
from workload import oracle, registry

FOLDER = contract.SMOKE_DIR
QUERIES, SQL = registry.all_queries(), oracle.all_sql()
NAMES = [n for n in QUERIES if not n.startswith("stream_")]

pytestmark = pytest.mark.skipif(not Path(FOLDER).exists(), reason="the tables are not here")


@pytest.fixture(scope="module")
def db():
    return connect(FOLDER)


def test_every_query_has_sql():
    assert QUERIES.keys() == SQL.keys()
    assert QUERIES.keys() <= contract.queries().keys() and SQL.items() <= contract.oracle_sql().items()


@pytest.mark.parametrize("name", NAMES)
def test_query_equals_sql(spark, db, name):
    assert compare(spark, db, FOLDER, name, QUERIES[name], SQL[name]) is None


def test_entry(spark):
    assert contract.entry(spark).columns == ["key", "id", "eventName", "value"]
