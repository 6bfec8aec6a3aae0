"""Every query with SQL gives the rows that DuckDB gives, on the smallest tables."""

from __future__ import annotations

import glob
import os

import duckdb
import pytest

from numerion.plans import catalog

SF = os.environ.get("NUMERION_TEST_SF", "/root/testdata/sf0.001")
QUERIES, SQL = catalog.queries(), catalog.oracle_sql()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for path in glob.glob(f"{SF}/*.parquet"):
        con.sql(f"CREATE VIEW {os.path.basename(path).removesuffix('.parquet')} AS SELECT * FROM '{path}'")
    return con


@pytest.mark.parametrize("name", sorted(SQL))
def test_rows_equal_sql(spark, duck, name):
    got, want = QUERIES[name](spark, SF).toPandas(), duck.sql(SQL[name]).df()
    columns = sorted(got.columns)
    assert columns == sorted(want.columns) and len(got)
    plain = lambda df: sorted(map(repr, df[columns].astype(object).where(df[columns].notna(), None).values.tolist()))
    assert plain(got) == plain(want)
    assert {c: str(got[c].dtype) for c in columns} == {c: str(want[c].dtype) for c in columns}


def test_queries_without_sql_are_the_image_runs():
    assert sorted(set(QUERIES) - set(SQL)) == ["detected_pages", "detection_accuracy", "digit_crops", "sheet_search"]


def test_sample_pages_are_read(spark):
    """Exact texts and digits over all kinds of damage, at the floors that the reading is held to."""
    rows = {r["category"]: r for r in QUERIES["detection_accuracy"](spark, "/root/testdata/sf0.01").collect()}
    everything = rows["(all)"]
    assert everything["right"] >= 0.95 * everything["digits"] and everything["exact"] >= 0.8 * everything["n"]
    assert all(r["exact"] >= 0.5 * r["n"] for r in rows.values())
