"""Every registered graph query against its SQL in another engine."""

import math
import os

import duckdb
import pandas as pd
import pytest

from graphlens import queries as q


def plain(v):
    if v is None or v is pd.NaT or v is pd.NA or isinstance(v, float) and math.isnan(v):
        return None
    if hasattr(v, "item"):
        v = v.item()
    if isinstance(v, float):
        return int(v) if v == int(v) else round(v, 6)
    return v


def rows(df):
    cols = sorted(df.columns)
    return sorted(str([plain(v) for v in r]) for r in df[cols].itertuples(index=False, name=None))


@pytest.fixture(scope="module")
def duck(sf):
    c = duckdb.connect()
    for t in os.listdir(sf):
        c.execute(f"create view {t.split('.')[0]} as select * from '{sf}/{t}'")
    return c


@pytest.mark.parametrize("name", sorted(q.QUERIES))
def test_query(spark, sf, duck, name):
    got = q.QUERIES[name](spark, sf).toPandas()
    if name in q.ORACLES:
        want = duck.sql(q.ORACLES[name]).df()
        assert sorted(got.columns) == sorted(want.columns)
        assert rows(got) == rows(want)
