"""Every query that has SQL, against DuckDB on the small tables; every other one runs and has a stable schema."""

import importlib

import pytest
from conftest import SMALL, same_rows

from trackweave import plans

Q, SQL = plans.queries(), plans.oracle_sql()


@pytest.mark.parametrize("name", sorted(SQL))
def test_sql(spark, duck, name):
    same_rows(Q[name](spark, SMALL), duck, SQL[name])


@pytest.mark.parametrize("name", sorted(set(Q) - set(SQL)))
def test_runs(spark, name):
    out = Q[name](spark, SMALL)
    assert out.count() > 0 and out.schema == Q[name](spark, SMALL).schema


def test_entry(spark):
    entry = importlib.import_module("__spark_entry__")
    assert entry.entry(spark).count() > 0
    assert set(Q) <= set(entry.queries()) and set(entry.oracle_sql()) <= set(entry.queries())
