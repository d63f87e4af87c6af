"""Each query against its SQL in DuckDB on the smallest tables."""

import math
import os

import duckdb
import pytest

from lumen.queries import QUERIES, SQL


@pytest.fixture(scope="module")
def con(small):
    c = duckdb.connect()
    for f in os.listdir(small):
        c.execute(f"create view {f[:-8]} as select * from '{small}/{f}'")
    return c


def plain(v):
    if v is None or isinstance(v, float) and math.isnan(v):
        return None
    if isinstance(v, (int, float)):
        return round(float(v), 4)
    return v.isoformat()[:19] if hasattr(v, "isoformat") else str(v)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, small, con, name):
    df = QUERIES[name](spark, small)
    cols = sorted(df.columns)
    got = sorted((tuple(map(plain, r)) for r in df.select(*[f"`{c}`" for c in cols]).collect()), key=repr)
    if name in SQL:
        quoted = ", ".join(f'"{c}"' for c in cols)
        want = con.sql(f"select {quoted} from ({SQL[name]})").fetchall()
        assert got == sorted((tuple(map(plain, r)) for r in want), key=repr)
    else:
        assert got
