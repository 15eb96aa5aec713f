"""Every query with SQL against DuckDB on the smallest tables."""

from __future__ import annotations

import math
import os

import duckdb
import pytest

from wordloom import catalog, catalog_studies  # noqa: F401 (registers queries)

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


def norm(v):
    if v is None:
        return "~"
    return ("nan" if math.isnan(v) else f"{v:.6g}") if isinstance(v, float) else str(v)


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in "events documents embeddings pages benchmark labels conversations".split():
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", sorted(catalog.ORACLE_SQL))
def test_equals_sql(spark, duck, name):
    df = catalog.QUERIES[name](spark, SF)
    columns = sorted(df.columns)
    result = duck.execute(catalog.ORACLE_SQL[name])
    names = [d[0] for d in result.description]
    assert sorted(names) == columns
    want = sorted(tuple(norm(dict(zip(names, r, strict=True))[c]) for c in columns) for r in result.fetchall())
    assert sorted(tuple(norm(r[c]) for c in columns) for r in df.collect()) == want


def test_keyed_results_do_not_depend_on_partitions(spark):
    one = catalog.attack_composed(spark, SF).collect()
    spark.conf.set("spark.sql.files.maxPartitionBytes", "4k")
    try:
        assert sorted(map(str, catalog.attack_composed(spark, SF).collect())) == sorted(map(str, one))
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
