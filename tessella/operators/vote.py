"""Votes among candidates by the results that they return."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def rows_hash(columns: list[str]) -> Column:
    """A hash of an item's distinct rows, whatever their order."""
    row = F.to_json(F.struct(*columns), {"ignoreNullFields": "false"})
    return F.sha2(F.array_join(F.sort_array(F.collect_set(F.sha2(row, 256))), ","), 256)


def consistency(candidates: DataFrame, item: str = "item", slot: str = "slot", result: str = "result_hash") -> DataFrame:
    """item, representative slot, cluster_size, score of each cluster of equal results among valid slots (a result
    that isn't null), best first: larger clusters, then earlier slots."""
    valid = candidates.where(F.col(result).isNotNull())
    each = valid.groupBy(item, result).agg(F.min(slot).alias("representative"), F.count("*").alias("cluster_size"))
    whole = F.sum("cluster_size").over(Window.partitionBy(item))
    rank = F.row_number().over(Window.partitionBy(item).orderBy(F.desc("cluster_size"), "representative"))
    return each.select(item, "representative", "cluster_size", (F.col("cluster_size") / whole).alias("score"), rank.alias("rank"))


def pairwise_ranking(votes: DataFrame) -> DataFrame:
    """item, candidate, win_rate, rank from votes (item, a, b, n_a, n_b, n_tie): a tie is half a win; the mean is over all
    candidates, itself included as zero."""
    share = lambda own: (F.col(own) + 0.5 * F.col("n_tie")) / (F.col("n_a") + F.col("n_b") + F.col("n_tie"))
    sides = F.explode(F.array(F.struct(F.col("a").alias("candidate"), share("n_a").alias("w")), F.struct(F.col("b").alias("candidate"), share("n_b").alias("w")))).alias("x")
    each = votes.select("item", sides).select("item", "x.*").groupBy("item", "candidate").agg(F.sum("w").alias("w"))
    n = F.count("*").over(Window.partitionBy("item"))
    scored = each.select("item", "candidate", (F.col("w") / n).alias("win_rate"))
    return scored.withColumn("rank", F.row_number().over(Window.partitionBy("item").orderBy(F.desc(F.round("win_rate", 9)), "candidate")))
