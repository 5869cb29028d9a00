"""Every registered query with SQL against DuckDB, on the smallest tables; the others must give rows."""

import math
import os
from collections import Counter

import duckdb
import pytest

import __spark_entry__ as entry

QUERIES, SQL = entry.queries(), entry.oracle_sql()
MAY_BE_EMPTY = {"document_channels", "pasted_list"}


def norm(v):
    if isinstance(v, float):
        return None if math.isnan(v) else round(v, 6)
    if isinstance(v, (list, tuple)):
        return tuple(norm(x) for x in v)
    return v


@pytest.fixture(scope="module")
def db(sf):
    c = duckdb.connect()
    for f in os.listdir(sf):
        c.execute(f"CREATE VIEW {f.removesuffix('.parquet')} AS SELECT * FROM '{sf}/{f}'")
    return c


@pytest.mark.parametrize("name", list(QUERIES))
def test_query(spark, sf, db, name):
    df = QUERIES[name](spark, sf)
    cols = sorted(df.columns)
    got = Counter(repr(tuple(norm(r[c]) for c in cols)) for r in df.collect())
    if name not in SQL:
        assert got or name in MAY_BE_EMPTY
        return
    res = db.execute(SQL[name])
    names = [d[0] for d in res.description]
    assert sorted(names) == cols
    want = Counter(repr(tuple(norm(r[names.index(c)]) for c in cols)) for r in res.fetchall())
    assert got == want


def test_entry(spark):
    assert entry.entry(spark).count() > 0
