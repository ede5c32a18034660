"""Every registered query of the engine against its SQL in DuckDB, on the smallest tables."""

import math
import os

import duckdb
import pytest

from sedimark.plans.registry import QUERIES, SQL

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def db():
    con = duckdb.connect()
    for f in os.listdir(SF):
        con.execute(f"CREATE VIEW {f.removesuffix('.parquet')} AS SELECT * FROM '{SF}/{f}'")
    return con


def plain(x):
    if x is None or isinstance(x, float) and math.isnan(x):
        return "none"
    if isinstance(x, bool):
        return x
    return float(x) if isinstance(x, (int, float)) else str(x)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, db, name):
    df = QUERIES[name](spark, SF)
    columns = sorted(df.columns)
    rows = sorted(map(repr, (tuple(plain(r[c]) for c in columns) for r in df.collect())))
    assert rows or name not in SQL
    if name in SQL:
        res = db.execute(SQL[name])
        names = [d[0] for d in res.description]
        assert sorted(names) == columns
        want = sorted(map(repr, (tuple(plain(r[names.index(c)]) for c in columns) for r in res.fetchall())))
        assert rows == want
