"""Every query that has SQL equals it on the smallest tables."""

import os

import duckdb
import pandas as pd
import pytest

from fleetmetrics.queries import ORACLES, QUERIES


def plain(df):
    show = lambda v: "None" if v is None or v is pd.NA or v is pd.NaT or v != v else str(float(v)) if isinstance(v, (int, float)) and not isinstance(v, bool) else str(v)
    df = df[sorted(df.columns)].map(show)
    return df.sort_values(list(df.columns)).reset_index(drop=True)


@pytest.fixture(scope="module")
def db(sf_dir):
    c = duckdb.connect()
    for t in os.listdir(sf_dir):
        c.execute(f"create view {t.removesuffix('.parquet')} as select * from '{sf_dir}/{t}'")
    return c


def test_every_query_has_sql():
    assert set(QUERIES) == set(ORACLES)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_equals_sql(spark, sf_dir, db, name):
    got, want = plain(QUERIES[name](spark, sf_dir).toPandas()), plain(db.sql(ORACLES[name]).df())
    assert list(got.columns) == list(want.columns)
    pd.testing.assert_frame_equal(got, want)
