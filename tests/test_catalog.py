"""Every catalogue query against its SQL in DuckDB."""

import glob
import os

import duckdb
import pytest

from tidelog.plans import catalog

D = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def db():
    c = duckdb.connect()
    for f in glob.glob(f"{D}/*.parquet"):
        c.sql(f"create view {os.path.basename(f)[:-8]} as select * from read_parquet('{f}')")
    return c


@pytest.mark.parametrize("name", sorted(catalog.QUERIES))
def test_query_equals_sql(spark, db, name):
    got = catalog.QUERIES[name](spark, D)
    cols = sorted(got.columns)
    rel = db.sql(catalog.ORACLE_SQL[name])
    assert sorted(rel.columns) == cols
    at = [rel.columns.index(c) for c in cols]
    ours = sorted(tuple(str(r[c]) for c in cols) for r in got.collect())
    theirs = sorted(tuple(str(r[i]) for i in at) for r in rel.fetchall())
    assert ours == theirs
