"""Every registered query with SQL against DuckDB on the smallest tables."""

import glob
import math
import os

import duckdb
import pytest

from tessera import plans, registry

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no tables")


@pytest.fixture(scope="module")
def tables():
    con = duckdb.connect()
    for p in glob.glob(f"{SF}/*.parquet"):
        con.sql(f"CREATE VIEW {os.path.basename(p)[:-8]} AS SELECT * FROM '{p}'")
    return con


def plain(v):
    if v is None or (isinstance(v, float) and math.isnan(v)):
        return "null"
    if isinstance(v, bool):
        return str(v)
    if isinstance(v, int | float):
        return repr(float(v))
    return str(v)


@pytest.mark.parametrize("name", sorted(registry.ORACLES))
def test_query(spark, tables, name):
    assert plans
    got = registry.QUERIES[name](spark, SF)
    want = tables.sql(registry.ORACLES[name])
    assert sorted(got.columns) == sorted(want.columns)
    order = sorted(got.columns)
    mine = sorted([plain(r[c]) for c in order] for r in got.collect())
    at = [want.columns.index(c) for c in order]
    theirs = sorted([plain(r[i]) for i in at] for r in want.fetchall())
    assert mine == theirs
