"""Every query against its SQL in another engine, on the smallest tables."""

import glob
import math
import os
from decimal import Decimal

import duckdb
import pytest

from tidemark.plans.registry import QUERIES, SQL


def plain(v):
    if v is None or v != v:
        return None
    if isinstance(v, bool):
        return v
    if isinstance(v, (float, Decimal)):
        v = float(v)
        return round(v, 6) + 0.0
    return int(v) if hasattr(v, "__int__") and not isinstance(v, str) else v


def rows(columns, data):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted((tuple(plain(r[i]) for i in order) for r in data), key=str)


def close(a, b):
    return a == b or (isinstance(a, (int, float)) and isinstance(b, (int, float)) and math.isclose(a, b, rel_tol=2e-6, abs_tol=2e-6))


@pytest.fixture(scope="module")
def duck(sf):
    con = duckdb.connect()
    for f in glob.glob(f"{sf}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(f)[:-8]} AS SELECT * FROM '{f}'")
    return con


@pytest.mark.parametrize("name", sorted(SQL))
def test_query_equals_sql(spark, duck, sf, name):
    df = QUERIES[name](spark, sf)
    got = rows(df.columns, df.collect())
    found = duck.execute(SQL[name])
    want = rows([d[0] for d in found.description], found.fetchall())
    assert sorted(df.columns) == sorted(d[0] for d in found.description)
    assert len(got) == len(want)
    assert all(close(x, y) for a, b in zip(got, want, strict=True) for x, y in zip(a, b, strict=True))


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(SQL)))
def test_query_without_sql_has_rows(spark, sf, name):
    assert QUERIES[name](spark, sf).limit(1).count() == 1
