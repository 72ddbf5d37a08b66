"""Every query with SQL gives DuckDB's rows; every other one gives rows."""

import math

import duckdb
import pytest

from assayloom.catalogue import ORACLES, QUERIES

from .conftest import SF

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
SLOW = {"mi_matrix", "search_trials", "mice"}


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


def plain(frame):
    frame = frame[sorted(frame.columns)]
    rows = [tuple(None if v is None or v != v else float(v) if isinstance(v, float) else v for v in r) for r in frame.itertuples(index=False, name=None)]
    return sorted(rows, key=lambda r: [(v is None, str(v)) for v in r])


def same(a, b):
    return a == b or (a is not None and b is not None and not isinstance(a, str) and math.isclose(a, b, abs_tol=2e-6))


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_agrees_with_sql(spark, duck, name):
    got, want = QUERIES[name](spark, SF).toPandas(), duck.sql(ORACLES[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert len(got) == len(want)
    assert all(same(x, y) for r, s in zip(plain(got), plain(want), strict=True) for x, y in zip(r, s, strict=True))


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLES) - SLOW))
def test_runs(spark, name):
    assert QUERIES[name](spark, SF).count() > 0
