"""The training-data queries that SQL can express give the rows of their SQL."""

from __future__ import annotations

import glob
import os

import duckdb
import pytest

import __spark_entry__ as entry
from lexmill.llm import oracles


@pytest.mark.parametrize("name", sorted(oracles.SQL))
def test_matches_sql(spark, sf, name):
    con = duckdb.connect()
    for f in glob.glob(f"{sf}/*.parquet"):
        con.sql(f"create view {os.path.basename(f)[:-8]} as select * from '{f}'")
    df = entry.queries()[name](spark, sf)
    want = con.sql(entry.oracle_sql()[name])
    columns = sorted(df.columns)
    assert sorted(want.columns) == columns
    at = [want.columns.index(c) for c in columns]
    got = [tuple(r[c] for c in columns) for r in df.collect()]
    assert sorted(got, key=str) == sorted((tuple(r[i] for i in at) for r in want.fetchall()), key=str)


def test_every_operator_has_one_query():
    names = [n.split("_")[0] for n in entry.queries() if n.startswith("op")]
    assert sorted(names) == sorted(f"op{i}" for i in range(1, 14)) and "pipeline" in entry.queries()
