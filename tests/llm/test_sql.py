"""The queries of the last operators against their SQL."""

import duckdb
import pytest

from tesserae.llm import queries

D = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", ["op11_segment_bounds", "op12_lexical_search"])
def test_same_rows_as_sql(spark, name):
    con = duckdb.connect()
    for table in ("documents", "benchmark", "embeddings"):
        con.sql(f"create view {table} as select * from read_parquet('{D}/{table}.parquet')")
    got, want = queries.queries()[name](spark, D).toPandas(), con.sql(queries.oracle_sql()[name]).df()
    names = sorted(got.columns)
    assert sorted(want.columns) == names
    a, b = (df[names].astype(str).sort_values(names).reset_index(drop=True) for df in (got, want))
    assert len(a) and a.equals(b)
