"""The queries of the subpackage that have SQL, against DuckDB at the smallest scale."""

import os

import duckdb
import pytest

from quillon.llm.queries import ORACLE_SQL, QUERIES

FOLDER = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_query(spark, name):
    c = duckdb.connect()
    for f in os.listdir(FOLDER):
        c.execute(f"create view {f.removesuffix('.parquet')} as select * from read_parquet('{FOLDER}/{f}')")
    got = QUERIES[name](spark, FOLDER)
    names = sorted(got.columns)
    found = c.sql(f"select {', '.join(names)} from ({ORACLE_SQL[name]})")
    assert sorted(found.columns) == names and sorted(found.fetchall(), key=str) == sorted(map(tuple, got.select(*names).collect()), key=str)
