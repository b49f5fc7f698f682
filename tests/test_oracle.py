"""Every query with SQL against DuckDB on the smallest tables."""

from __future__ import annotations

import glob
import os

import duckdb
import pytest

from sluiceway import queries, table_queries  # noqa: F401

from .conftest import DATA


@pytest.fixture(scope="session")
def duck():
    con = duckdb.connect()
    for f in glob.glob(f"{DATA}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(f)[:-8]} AS SELECT * FROM '{f}'")
    return con


def plain(value):
    return f"{value:.6g}" if isinstance(value, float) else str(value)


@pytest.mark.parametrize("name", sorted(queries.QUERIES))
def test_query(spark, duck, name):
    got = queries.QUERIES[name](spark, str(DATA))
    names = sorted(got.columns)
    mine = sorted(tuple(plain(r[c]) for c in names) for r in got.collect())
    if name not in queries.SQL:
        assert mine
        return
    result = duck.execute(queries.SQL[name])
    theirs_names = [d[0] for d in result.description]
    assert sorted(theirs_names) == names
    theirs = sorted(tuple(plain(r[theirs_names.index(c)]) for c in names) for r in result.fetchall())
    assert mine == theirs
