"""Every registered query of the library against its SQL, and the rest for rows and shape."""

import os

import duckdb
import pandas as pd
import pytest

from repolytics import registry

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def plain(df):
    df = df[sorted(df.columns)].copy()

    def one(v):
        if v is None or v is pd.NaT or v is pd.NA or (isinstance(v, float) and v != v):
            return ""
        if hasattr(v, "tolist") and getattr(v, "shape", ()):
            v = v.tolist()
        if isinstance(v, float):
            return f"{v:.9g}"
        if type(v).__name__ in ("bool", "bool_"):
            return str(bool(v))
        return str(v)

    for c in df.columns:
        df[c] = df[c].map(one)
    return df.sort_values(list(df.columns)).reset_index(drop=True)


@pytest.fixture(scope="module")
def duck(sf_dir):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{sf_dir}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", sorted(registry.QUERIES))
def test_query(spark, sf_dir, duck, name):
    got = registry.QUERIES[name](spark, sf_dir).toPandas()
    if name not in registry.ORACLE_SQL:
        assert len(got.columns) > 1
        return
    expected = duck.execute(registry.ORACLE_SQL[name]).df()
    assert sorted(got.columns) == sorted(expected.columns)
    pd.testing.assert_frame_equal(plain(got), plain(expected))


def test_registry_is_whole():
    assert registry.FLAGSHIP in registry.QUERIES and set(registry.ORACLE_SQL) <= set(registry.QUERIES)
    assert os.path.isdir("/root/testdata/sf0.001")
