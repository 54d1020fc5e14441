"""Doubles near a half are rounded as the SQL rounds them."""

from __future__ import annotations

import duckdb

from tessella.operators import vectors
from tessella.plans.registry import ORACLES, QUERIES


def test_halves(spark):
    values = [k / 10**6 for k in range(-200_005, 900_000, 1010)] + [0.0, 0.5, -0.5, 2.5]
    want = [r[0] for r in duckdb.sql("select round(x, 5) from (select unnest($1::double[]) as x)", params=[values]).fetchall()]
    rows = spark.createDataFrame([(i, x) for i, x in enumerate(values)], "i int, x double")
    assert [r.y for r in rows.select("i", vectors.rounded("x", 5).alias("y")).orderBy("i").collect()] == want


def test_merged_distances(spark):
    sf, name = "/root/testdata/sf0.01", "knn_join_merge_dedupe"
    c = duckdb.connect()
    c.sql(f"create view embeddings as select * from '{sf}/embeddings.parquet'")
    want = c.sql(ORACLES[name])
    got = QUERIES[name](spark, sf).select(*want.columns).collect()
    assert sorted(map(tuple, got)) == sorted(want.fetchall())
