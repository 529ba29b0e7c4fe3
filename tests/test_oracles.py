"""Every query with SQL against DuckDB over the same files."""

import glob
import os

import duckdb
import pytest

from tesserae.plans import queries

D = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for path in glob.glob(f"{D}/*.parquet"):
        con.sql(f"create view {os.path.basename(path)[:-8]} as select * from read_parquet('{path}')")
    return con


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_same_rows_as_sql(spark, duck, name):
    got, want = queries.queries()[name](spark, D).toPandas(), duck.sql(queries.oracle_sql()[name]).df()
    names = sorted(got.columns)
    assert sorted(want.columns) == names
    a, b = (df[names].astype(str).sort_values(names).reset_index(drop=True) for df in (got, want))
    assert len(a) > 0
    assert a.equals(b)


@pytest.mark.parametrize("name", sorted(set(queries.queries()) - set(queries.oracle_sql())))
def test_others_give_rows(spark, name):
    assert queries.queries()[name](spark, D).count() > 0


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0
