"""Every registered query against its SQL."""

import duckdb
import numpy as np
import pandas as pd
import pytest

from latticework.plans.queries import ORACLES, QUERIES

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck(sf):
    con = duckdb.connect()
    con.execute("set timezone = 'UTC'")
    for t in TABLES:
        con.execute(f"create view {t} as select * from read_parquet('{sf}/{t}.parquet')")
    return con


def rows(d):
    def show(v):
        if isinstance(v, (list, np.ndarray)):
            return str([show(x) for x in v])
        if pd.isna(v):
            return "none"
        return f"{v:.5g}" if isinstance(v, float) else str(v)

    return sorted(tuple(show(v) for v in r) for r in d[sorted(d.columns)].itertuples(index=False))


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, sf, duck, name):
    got = QUERIES[name](spark, sf).toPandas()
    assert len(got.columns) == len(set(got.columns))
    if name in ORACLES:
        want = duck.execute(ORACLES[name]).df()
        assert sorted(got.columns) == sorted(want.columns)
        assert rows(got) == rows(want)
    else:
        assert len(got)


def test_names():
    assert set(ORACLES) <= set(QUERIES)
