"""Every registered map query against its SQL on the smallest tables."""

import os

import duckdb
import pandas as pd
import pytest

from wayfield.plans.oracle import ORACLES
from wayfield.plans.queries import QUERIES, location, prepared, projectors, run_stream  # noqa: F401

from .conftest import DATA


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for f in os.listdir(DATA):
        c.execute(f"CREATE VIEW {f.split('.')[0]} AS SELECT * FROM '{DATA}/{f}'")
    return c


def text(v):
    if v is None or v is pd.NaT or (isinstance(v, float) and v != v) or v is pd.NA:
        return ""
    return str(v) if isinstance(v, (str, pd.Timestamp)) else f"{float(v) + 0.0:.3f}"


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_oracle(spark, duck, name):
    got, want = QUERIES[name](spark, DATA).toPandas(), duck.execute(ORACLES[name]).df()
    cols = sorted(got.columns)
    assert cols == sorted(want.columns)
    rows = [sorted(tuple(map(text, r)) for r in d[cols].itertuples(index=False)) for d in (got, want)]
    assert rows[0] == rows[1]


def test_every_query_has_rows_or_sql(spark):
    assert set(ORACLES) <= set(QUERIES)
    for name in ("agg7_nearest_open_gate", "iter1_shortest_routes", "iter2_cost_field"):
        assert QUERIES[name](spark, DATA).limit(5).count() == 5
