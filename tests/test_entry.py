"""The queries of the reference's operators against DuckDB, on the smallest tables."""

import datetime
import decimal
import math

import duckdb
import pytest

import __spark_entry__ as entry_module
from ladle.plans.registry import QUERIES
from tests.conftest import SF

TABLES = "region nation customer supplier part orders lineitem events".split()
#: Model fits take long; one of each kind is tried elsewhere.
#: On the smallest tables no series is long enough to train on.
LARGER = {"forecast_model": "/root/testdata/sf0.01"}
SLOW = {"item_classifier", "recommendations", "recommendation_counts", "recommendation_summary", "scenarios"}


def norm(v):
    if isinstance(v, float):
        return None if math.isnan(v) else round(v, 3) + 0.0
    if isinstance(v, decimal.Decimal):
        return round(float(v), 3)
    if isinstance(v, (datetime.date, datetime.datetime)):
        return v.isoformat()[:19]
    return v


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    return con


def close(a, b):
    return a == b or (isinstance(a, float) and isinstance(b, float) and abs(a - b) <= 0.002 * max(1, abs(a)))


@pytest.mark.parametrize("name", sorted(set(QUERIES) - SLOW))
def test_query_equals_sql(spark, duck, name):
    query = QUERIES[name]
    df = query.run(spark, LARGER.get(name, SF))
    columns = sorted(df.columns)
    rows = sorted((tuple(norm(r[c]) for c in columns) for r in df.collect()), key=repr)
    if (sql := query.oracle()) is None:
        assert rows
        return
    found = duck.sql(sql)
    assert sorted(found.columns) == columns
    order = [found.columns.index(c) for c in columns]
    expected = sorted((tuple(norm(r[i]) for i in order) for r in found.fetchall()), key=repr)
    assert len(rows) == len(expected)
    assert all(close(a, b) for x, y in zip(rows, expected) for a, b in zip(x, y))


def test_entry_has_rows(spark):
    assert entry_module.entry(spark).count() > 0


def test_every_sql_has_a_query():
    assert set(entry_module.oracle_sql()) <= set(entry_module.queries())


def test_imports_without_training_data_modules(monkeypatch):
    monkeypatch.setattr(entry_module, "_llm", lambda module: None)
    assert set(entry_module.queries()) == set(QUERIES)
