"""Relational registered queries against their DuckDB oracle at sf0.001."""

import math
import os

import duckdb
import pandas as pd
import pytest

from __spark_entry__ import entry, oracle_sql, queries

SF = "/root/testdata/sf0.001"
FAST = ["kpi_summary", "kpi_summary_filtered", "daily_revenue", "top_stores",
        "top_categories_store", "filter_options", "store_metrics_scaled", "assign_to_centroids",
        "onehot_drop_first", "display_names", "forecast_future_frame", "clean_report",
        "store_dimension", "product_dimension"]


def norm(v):
    if v is None or (isinstance(v, float) and math.isnan(v)):
        return None
    if isinstance(v, float):
        return round(v, 9)
    if hasattr(v, "isoformat"):
        return str(pd.Timestamp(v))
    return str(v)


def canon(df):
    cols = sorted(df.columns)
    out = [tuple(norm(v) for v in r) for r in df[cols].itertuples(index=False)]
    return cols, sorted(out, key=str)


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for f in os.listdir(SF):
        c.execute(f"CREATE VIEW {f[:-8]} AS SELECT * FROM read_parquet('{SF}/{f}')")
    return c


@pytest.mark.parametrize("name", FAST)
def test_matches_oracle(spark, con, name):
    s = queries()[name](spark, SF).toPandas()
    o = con.execute(oracle_sql()[name]).df()
    assert canon(s) == canon(o)


def test_every_oracle_has_a_query():
    assert set(oracle_sql()) <= set(queries())


def test_entry(spark):
    assert entry(spark).count() > 0
