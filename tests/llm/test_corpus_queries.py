"""Queries of the corpus operators with SQL, against DuckDB on the smallest tables."""

from __future__ import annotations

import math
import os

import duckdb
import pytest

from wordloom.llm import queries

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


def norm(v):
    if v is None:
        return "~"
    return ("nan" if math.isnan(v) else f"{v:.6g}") if isinstance(v, float) else str(v)


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_equals_sql(spark, name):
    con = duckdb.connect()
    for t in "documents pages labels conversations".split():
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    df = queries.QUERIES[name](spark, SF)
    result = con.execute(queries.oracle_sql()[name])
    names, columns = [d[0] for d in result.description], sorted(df.columns)
    assert sorted(names) == columns
    want = sorted(tuple(norm(dict(zip(names, r, strict=True))[c]) for c in columns) for r in result.fetchall())
    assert sorted(tuple(norm(r[c]) for c in columns) for r in df.collect()) == want
