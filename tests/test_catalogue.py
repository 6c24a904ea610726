"""Every registered query with SQL gives DuckDB's rows on the smallest tables."""

from __future__ import annotations

import glob
import math
import os

import duckdb
import pytest

from gritstone.plans import catalogue


@pytest.fixture(scope="module")
def db(sf):
    con = duckdb.connect()
    for p in glob.glob(f"{sf}/*.parquet"):
        con.sql(f"create view {os.path.basename(p)[:-8]} as select * from '{p}'")
    return con


def plain(v):
    if isinstance(v, float):
        return round(v, 6) if math.isfinite(v) else str(v)
    return v.isoformat() if hasattr(v, "isoformat") else float(v) if hasattr(v, "normalize") else v


@pytest.mark.parametrize("name", sorted(catalogue.oracle_sql()))
def test_same_as_sql(spark, sf, db, name):
    df, want = catalogue.queries()[name](spark, sf), db.sql(catalogue.oracle_sql()[name])
    columns = sorted(df.columns)
    assert columns == sorted(want.columns)
    at = [want.columns.index(c) for c in columns]
    assert sorted(repr([plain(r[c]) for c in columns]) for r in df.collect()) == sorted(repr([plain(r[k]) for k in at]) for r in want.fetchall())
