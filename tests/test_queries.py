"""Every registered voxel query against its SQL in DuckDB, at the smallest scale."""

import math

import duckdb
import pytest

from voxelweave.plans import catalog

DATA = "/root/testdata/sf0.001"
TYPES = {"bigint": "BIGINT", "double": "DOUBLE", "string": "VARCHAR", "boolean": "BOOLEAN"}


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in ("customer", "supplier", "part", "orders", "lineitem"):
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{DATA}/{t}.parquet'")
    return con


def plain(v):
    return round(v, 4) + 0.0 if isinstance(v, float) and math.isfinite(v) else v


@pytest.mark.parametrize("name", catalog.queries())
def test_query(spark, duck, name):
    df, sql = catalog.queries()[name](spark, DATA), catalog.oracle_sql().get(name)
    columns = sorted(df.columns)
    got = sorted((tuple(plain(r[c]) for c in columns) for r in df.collect()), key=repr)
    assert got
    if sql:
        expected = duck.sql(sql)
        assert sorted(expected.columns) == columns
        assert {c: TYPES[t] for c, t in df.dtypes} == dict(zip(expected.columns, map(str, expected.types), strict=True))
        place = [expected.columns.index(c) for c in columns]
        assert got == sorted((tuple(plain(r[i]) for i in place) for r in expected.fetchall()), key=repr)
