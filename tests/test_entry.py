import glob
import os

import duckdb
import pytest

import __spark_entry__ as entry
from tallyframe.plans import catalogue

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no tables")


def same(df, rows, names):
    columns = sorted(df.columns)
    assert columns == sorted(names)
    got = sorted(repr(tuple(r[c] for c in columns)) for r in df.collect())
    place = [names.index(c) for c in columns]
    assert got == sorted(repr(tuple(r[p] for p in place)) for r in rows)


@pytest.fixture(scope="module")
def tables():
    con = duckdb.connect()
    for f in glob.glob(f"{SF}/*.parquet"):
        con.sql(f"create view {os.path.basename(f)[:-8]} as select * from '{f}'")
    return con


@pytest.mark.parametrize("name", sorted(catalogue.ORACLE_SQL))
def test_query_equals_sql(spark, tables, name):
    told = tables.sql(catalogue.ORACLE_SQL[name])
    same(catalogue.QUERIES[name](spark, SF), told.fetchall(), list(told.columns))


@pytest.mark.parametrize("name", sorted(set(catalogue.QUERIES) - set(catalogue.ORACLE_SQL)))
def test_other_queries_run(spark, name):
    assert catalogue.QUERIES[name](spark, SF).count() > 0


def test_entry_and_registers(spark):
    assert entry.entry(spark).count() == 100
    assert set(entry.oracle_sql()) <= set(entry.queries()) >= set(catalogue.QUERIES)
