"""The entry module: names, and results against DuckDB on the smallest tables."""

import os

import pytest

import __spark_entry__ as entry

DATA = "/root/testdata/sf0.001"
needs_data = pytest.mark.skipif(not os.path.isdir(DATA), reason="no tables")


def test_every_oracle_has_a_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert len(entry.queries()) > 150


@needs_data
def test_flagship(spark):
    assert entry.entry(spark).columns == ["x", "y", "z", "t", "v"]


@needs_data
@pytest.mark.parametrize("name", ["demean_chain", "exp", "round", "add_img_3d", "Tmedian", "thrp", "rank", "bptf", "fmean", "index", "inm", "robust_range"])
def test_against_duckdb(spark, name):
    import duckdb

    con = duckdb.connect()
    for t in ("embeddings", "events"):
        con.sql(f"create view {t} as select * from read_parquet('{DATA}/{t}.parquet')")
    want = con.sql(entry.oracle_sql()[name]).df()
    got = entry.queries()[name](spark, DATA).toPandas()
    keys = [c for c in ("x", "y", "z", "t") if c in got.columns] or list(got.columns)
    want, got = (d[sorted(d.columns)].sort_values(keys).reset_index(drop=True).astype(float) for d in (want, got))
    assert list(want.columns) == list(got.columns) and len(want) == len(got)
    assert ((want - got).abs().max() < 1e-5).all()
