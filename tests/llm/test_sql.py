"""Every query of the subpackage that SQL can express against its SQL in another engine, on the smallest tables."""

import glob
import os

import duckdb
import pytest

from tests.test_queries import close, rows
from tidemark.llm.queries import QUERIES, SQL


@pytest.mark.parametrize("name", sorted(SQL))
def test_query_equals_sql(spark, sf, name):
    con = duckdb.connect()
    for f in glob.glob(f"{sf}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(f)[:-8]} AS SELECT * FROM '{f}'")
    df = QUERIES[name](spark, sf)
    found = con.execute(SQL[name])
    columns = [d[0] for d in found.description]
    got, want = rows(columns, df.select(*columns).collect()), rows(columns, found.fetchall())
    assert sorted(df.columns) == sorted(columns) and len(got) == len(want)
    assert all(close(x, y) for a, b in zip(got, want, strict=True) for x, y in zip(a, b, strict=True))
