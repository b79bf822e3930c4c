"""The queries against their SQL in DuckDB, whole tables on both sides."""

import glob
import os

import duckdb
import pytest

from tidelog.llm import registry

D = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(registry.ORACLE_SQL))
def test_query_equals_sql(spark, name):
    c = duckdb.connect()
    for f in glob.glob(f"{D}/*.parquet"):
        c.sql(f"create view {os.path.basename(f)[:-8]} as select * from read_parquet('{f}')")
    got, rel = registry.QUERIES[name](spark, D), c.sql(registry.ORACLE_SQL[name])
    cols = sorted(got.columns)
    assert sorted(rel.columns) == cols
    at = [rel.columns.index(x) for x in cols]
    assert sorted(tuple(str(r[x]) for x in cols) for r in got.collect()) == sorted(tuple(str(r[i]) for i in at) for r in rel.fetchall())
