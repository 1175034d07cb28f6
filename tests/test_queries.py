"""Every query runs on the smallest tables and, where there is SQL for it, gives the same rows in DuckDB."""

import os

import duckdb
import numpy as np
import pandas as pd
import pytest

from textloom.plans import all_queries

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def plain(v):
    if v is None or v is pd.NaT or (isinstance(v, float) and v != v):
        return None
    if isinstance(v, (np.ndarray, list, tuple)):
        return tuple(plain(x) for x in v)
    if isinstance(v, dict):
        return tuple(sorted((k, plain(x)) for k, x in v.items()))
    if isinstance(v, (float, np.floating)):
        return round(float(v), 6)
    return v


@pytest.fixture(scope="session")
def duck(sf):
    c = duckdb.connect()
    for t in TABLES:
        p = f"{sf}/{t}.parquet"
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{p + '/*.parquet' if os.path.isdir(p) else p}')")
    return c


@pytest.mark.parametrize("name", sorted(all_queries.QUERIES))
def test_query(spark, sf, duck, name):
    df = all_queries.QUERIES[name](spark, sf)
    cols = sorted(df.columns)
    rows = sorted((tuple(plain(r[c]) for c in cols) for r in df.select(*[f"`{c}`" for c in cols]).toArrow().to_pylist()), key=repr)
    if name in all_queries.SQL:
        rel = duck.sql(all_queries.SQL[name])
        assert sorted(rel.columns) == cols
        at = [rel.columns.index(c) for c in cols]
        assert rows == sorted((tuple(plain(r[i]) for i in at) for r in rel.fetchall()), key=repr)


def test_sql_has_queries():
    assert set(all_queries.SQL) <= set(all_queries.QUERIES)
