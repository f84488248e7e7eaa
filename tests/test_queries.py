"""Every registered query runs on small tables; where SQL is given, the values agree."""

import duckdb
import pytest

import __spark_entry__ as entry
from oracle import compare
from tabprep.registry.views import TABLES

QUERIES, SQL = entry.queries(), entry.oracle_sql()


@pytest.fixture(scope="module")
def duck(folder):
    con = duckdb.connect()
    con.execute("set timezone='UTC'")
    for t in TABLES:
        con.execute(f"create view {t} as select * from read_parquet('{folder}/{t}.parquet')")
    return con


def test_every_sql_has_a_query():
    assert set(SQL) <= set(QUERIES)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, folder, duck, name):
    df = QUERIES[name](spark, folder)
    rows = [tuple(r) for r in df.collect()]
    if name not in SQL:
        assert rows
        return
    found = duck.execute(SQL[name])
    assert compare(df.columns, rows, [d[0] for d in found.description], found.fetchall()) == ""


def test_entry(spark, folder):
    assert entry.entry(spark).count() > 0
