"""Ranks of tables whose ranges Spark draws anew each time it reads them."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessella.operators.ranks import global_rank


def test_ranks_of_many_rows(spark):
    n = 400_000
    rows = spark.range(n, numPartitions=8).select((F.col("id") * 7919 % n).alias("k"), F.repeat(F.lit("x"), 50).alias("other")).repartition(8, "other", "k")
    ranked = global_rank(rows.withColumn("key", F.struct(F.lit(None).cast("int"), "k")), "key")
    found = ranked.agg(F.count("*"), F.count_if(F.col("rank") != F.col("k") + 1)).first()
    assert tuple(found) == (n, 0)


def test_ranks_of_nulls_and_nothing(spark):
    rows = spark.createDataFrame([(3,), (None,), (1,)], "k int")
    assert sorted((r.k or 0, r["rank"]) for r in global_rank(rows, "k").collect()) == [(0, 1), (1, 2), (3, 3)]
    assert global_rank(rows.limit(0), "k").count() == 0
