"""Every named query against its SQL, on the smallest given tables."""

import math
import os

import duckdb
import pytest

import __spark_entry__ as entry_point
from answergauge.plans import all_queries

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="tables not present")

QUERIES, SQL = entry_point.queries(), entry_point.oracle_sql()
NAMES = list(all_queries())


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    con.execute("SET timezone = 'UTC'")
    for name in os.listdir(SF):
        con.execute(f"CREATE VIEW {name.removesuffix('.parquet')} AS SELECT * FROM '{SF}/{name}'")
    return con


def _plain(value):
    if isinstance(value, float):
        return None if math.isnan(value) else round(value, 9)
    return value


def _table(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(columns), sorted((tuple(_plain(r[i]) for i in order) for r in rows), key=repr)


@pytest.mark.parametrize("name", NAMES)
def test_query_equals_its_sql(spark, duck, name):
    df = QUERIES[name](spark, SF)
    got = _table(df.columns, df.collect())
    result = duck.execute(SQL[name])
    expected = _table([d[0] for d in result.description], result.fetchall())
    assert got == expected


def test_entry(spark):
    assert entry_point.entry(spark).count() == 5


def test_every_query_has_sql():
    assert set(NAMES) <= set(SQL)
