"""Registered queries against their SQL, on the smallest tables."""

from __future__ import annotations

import glob
import os

import duckdb
import pytest

from marketloom.plans import catalogue

from .conftest import SF


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for f in glob.glob(f"{SF}/*.parquet"):
        c.execute(f"CREATE VIEW {os.path.basename(f)[:-8]} AS SELECT * FROM '{f}'")
    return c


def _key(v):
    return (v is None, str(type(v)), round(v, 5) if isinstance(v, float) else v)


@pytest.mark.parametrize("name", sorted(catalogue.SQL))
def test_query_matches_sql(spark, duck, name):
    got = catalogue.QUERIES[name](spark, SF)
    want = duck.execute(catalogue.SQL[name])
    columns = [d[0] for d in want.description]
    assert sorted(columns) == sorted(got.columns)
    order = sorted(columns)
    mine = sorted((tuple(r[c] for c in order) for r in got.collect()), key=lambda r: tuple(map(_key, r)))
    theirs = sorted((tuple(r[columns.index(c)] for c in order) for r in want.fetchall()), key=lambda r: tuple(map(_key, r)))
    assert len(mine) == len(theirs)
    for a, b in zip(mine, theirs, strict=True):
        for x, y in zip(a, b, strict=True):
            assert x == y or (isinstance(x, float) and x == pytest.approx(y, abs=2e-5)), (a, b)


@pytest.mark.parametrize("name", sorted(set(catalogue.QUERIES) - set(catalogue.SQL)))
def test_query_has_rows(spark, name):
    if name in ("coverage_metrics", "base_rates", "signal_screen", "fold_selection", "selection_null", "competing_risk", "platt", "ablation"):
        pytest.skip("needs more rows than the smallest tables have; tested on its own inputs")
    assert catalogue.QUERIES[name](spark, SF).schema.fields
