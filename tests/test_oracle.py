"""Every registered query of the engine against its SQL, on the smallest tables."""

import os

import duckdb
import pandas as pd
import pytest

from factloom.plans import registry

DATA = os.environ.get("FACTLOOM_TESTDATA", "/root/testdata/sf0.001")
TABLES = "region nation customer supplier part orders lineitem events documents pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in TABLES:
        path = f"{DATA}/{t}.parquet"
        c.sql(f"create view {t} as select * from '{path + '/*.parquet' if os.path.isdir(path) else path}'")
    return c


def plain(v):
    if v is None or v is pd.NaT or v is pd.NA or v != v:
        return None
    if isinstance(v, (bool, int, float)) or hasattr(v, "item"):
        return float(f"{float(v):.9g}")
    return str(v)


def rows(df):
    df = df[sorted(df.columns)]
    return sorted([tuple(plain(v) for v in r) for r in df.itertuples(index=False, name=None)], key=str)


@pytest.mark.parametrize("name", sorted(registry.QUERIES))
def test_query(spark, con, name):
    got = registry.QUERIES[name](spark, DATA).toPandas()
    if name in registry.ORACLE:
        want = con.sql(registry.ORACLE[name]).df()
        assert sorted(got.columns) == sorted(want.columns)
        assert rows(got) == rows(want)
    else:
        assert len(got) > 0
