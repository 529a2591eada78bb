import os

import duckdb
import pytest

import __spark_entry__ as entry


def canon(rows, columns):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    value = lambda x: round(x, 6) if isinstance(x, float) else x if x is None or isinstance(x, (int, bool)) else str(x)
    return sorted(tuple(str(value(r[i])) for i in order) for r in rows), sorted(columns)


@pytest.fixture(scope="module")
def duck(sf):
    con = duckdb.connect()
    for f in os.listdir(sf):
        con.execute(f"create view {f.split('.')[0]} as select * from read_parquet('{sf}/{f}')")
    return con


@pytest.mark.parametrize("name", sorted(entry.oracle_sql()))
def test_query_equals_its_sql(spark, duck, sf, name):
    df = entry.queries()[name](spark, sf)
    r = duck.execute(entry.oracle_sql()[name])
    assert canon([tuple(x) for x in df.collect()], df.columns) == canon(r.fetchall(), [c[0] for c in r.description])


@pytest.mark.parametrize("name", sorted(set(entry.queries()) - set(entry.oracle_sql())))
def test_query_runs(spark, sf, name):
    df = entry.queries()[name](spark, sf)
    assert len(df.columns) == len(set(df.columns)) and df.count() >= 0


def test_entry(spark):
    assert entry.entry(spark).count() > 0
