"""Every query with a SQL counterpart gives the same rows, at the smallest size."""

import math

import duckdb
import pytest

import __spark_entry__ as entry
from lintel.plans import registry

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for name in TABLES:
        con.sql(f"CREATE VIEW {name} AS SELECT * FROM '{SF}/{name}.parquet'")
    return con


def _plain(value):
    if isinstance(value, float):
        return "nan" if math.isnan(value) else round(value, 6)
    return value


def _rows(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted((tuple(_plain(r[i]) for i in order) for r in rows), key=lambda r: tuple((v is None, str(v)) for v in r))


@pytest.mark.parametrize("name", sorted(registry.queries()))
def test_query_equals_sql(spark, duck, name):
    found = registry.queries()[name](spark, SF)
    rows = [tuple(r) for r in found.collect()]
    sql = registry.oracle_sql().get(name)
    if sql is None:
        assert rows
        return
    expected = duck.sql(sql)
    assert sorted(found.columns) == sorted(expected.columns)
    assert _rows(found.columns, rows) == _rows(expected.columns, expected.fetchall())


def test_entry(spark):
    assert entry.entry(spark).count() >= 0
    assert set(entry.oracle_sql()) <= set(entry.queries())
