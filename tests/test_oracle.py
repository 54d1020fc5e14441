"""Every registered query with SQL gives DuckDB's rows."""

from __future__ import annotations

import math
import os

import duckdb
import pytest

from tessella.plans.registry import ORACLES, QUERIES  # the package registers all
from tessella.sources import TABLES

SF = os.environ.get("TEST_SF", "/root/testdata/sf0.001")


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for t in TABLES:
        c.sql(f"create view {t} as select * from '{SF}/{t}.parquet'")
    return c


def same(a, b) -> bool:
    if isinstance(a, float) or isinstance(b, float):
        return a is not None and b is not None and (math.isclose(a, b, rel_tol=1e-9, abs_tol=1e-9) or (math.isnan(a) and math.isnan(b)))
    return a == b


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_oracle(spark, duck, name):
    got = QUERIES[name](spark, SF)
    want = duck.sql(ORACLES[name])
    assert sorted(got.columns) == sorted(want.columns)
    order = sorted(got.columns)
    key = lambda row: [(x is None, str(round(x, 3) if isinstance(x, float) else x)) for x in row]
    left = sorted((tuple(r[c] for c in order) for r in got.collect()), key=key)
    right = sorted(want.select(*order).fetchall(), key=key)
    assert len(left) == len(right)
    for a, b in zip(left, right):
        assert all(map(same, a, b)), (a, b)


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLES)))
def test_rows(spark, name):
    assert QUERIES[name](spark, SF).count() > 0
