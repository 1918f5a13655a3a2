"""Every bound query against DuckDB at the smallest scale."""

import math
import os

import duckdb
import pandas as pd
import pytest

from quillon import workload

FOLDER = "/root/testdata/sf0.001"


def plain(v):
    if v is None or v is pd.NaT or v is pd.NA or isinstance(v, float) and math.isnan(v):
        return None
    return f"{round(v, 5):g}" if isinstance(v, float) else str(v)


def rows(df):
    names = sorted(df.columns)
    return names, sorted((tuple(map(plain, (x.item() if hasattr(x, "item") else x for x in r))) for r in df[names].astype(object).itertuples(index=False)), key=str)


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for f in os.listdir(FOLDER):
        c.execute(f"create view {f.removesuffix('.parquet')} as select * from read_parquet('{FOLDER}/{f}')")
    return c


@pytest.mark.parametrize("name", sorted(workload.ORACLE_SQL))
def test_query(spark, duck, name):
    got, want = rows(workload.QUERIES[name](spark, FOLDER).toPandas()), rows(duck.sql(workload.ORACLE_SQL[name]).df())
    same = len(got[1]) == len(want[1]) and all(plain_equal(a, b) for a, b in zip(got[1], want[1], strict=True))
    assert got[0] == want[0] and same


def plain_equal(a, b):
    return all(x == y or x is not None and y is not None and _number(x) == _number(y) != "" for x, y in zip(a, b, strict=True))


def _number(x):
    try:
        return float(x)
    except ValueError:
        return ""
