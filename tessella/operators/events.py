"""Event logs: latest versions, ledgers, windows and gates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def latest(df: DataFrame, key: list[str], order: list[str]) -> DataFrame:
    """The last version of each key; order is total. One pass of aggregation, no sort of whole groups."""
    rest = [c for c in df.columns if c not in key]
    top = F.max_by(F.struct(*rest), F.struct(*order))
    return df.groupBy(*key).agg(top.alias("x")).select(*key, "x.*")


def next_number(df: DataFrame, key: str, number: str) -> DataFrame:
    return df.groupBy(key).agg((F.coalesce(F.max(number), F.lit(0)) + 1).alias("next_no"))


def trailing_count(df: DataFrame, key: str, seconds: Column, width: int) -> DataFrame:
    """df with n_recent: rows of the key in the `width` seconds up to and with the row's own."""
    by = Window.partitionBy(key).orderBy(seconds).rangeBetween(-width + 1, 0)
    return df.withColumn("n_recent", F.count("*").over(by))


def gate(df: DataFrame, group: str, at: str, order: str, share: float) -> DataFrame:
    """When so large a share of a group's rows had come: the time of the ceil(share * n)-th."""
    by = Window.partitionBy(group).orderBy(at, order)
    n = F.count("*").over(Window.partitionBy(group))
    return df.withColumn("k", F.row_number().over(by)).withColumn("n", n).where(F.col("k") == F.ceil(F.lit(share) * F.col("n"))).select(group, "n", "k", F.col(at).alias("opened"))
