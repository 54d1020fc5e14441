"""Column profiles, examples and value dictionaries."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: What a value that is worth no index looks like.
UUID = r"^[0-9a-fA-F]{8}-([0-9a-fA-F]{4}-){3}[0-9a-fA-F]{12}$"
NUMBER = r"^[0-9]+\.?[0-9]*$"


def column_profile(df: DataFrame) -> DataFrame:
    """column_name, total_count (not null), distinct_count, null_count: each row gives a pair of 64-bit hashes a column, whose distinct ones are
    counted by partial aggregation, so that no column's values meet in one task and no row is copied whole. A table without rows has zeros."""
    cells = [F.struct(F.lit(i).alias("i"), F.col(f"`{c}`").isNull().alias("none"), F.xxhash64(F.lit(1), f"`{c}`").alias("h1"), F.xxhash64(F.lit(2), f"`{c}`").alias("h2")) for i, c in enumerate(df.columns)]
    each = df.select(F.inline(F.array(*cells))).groupBy("i", "none", "h1", "h2").agg(F.count("*").alias("n"))
    found = each.groupBy("i").agg(F.sum(F.when(~F.col("none"), F.col("n"))).alias("t"), F.count_if(~F.col("none")).alias("d"), F.sum(F.when(F.col("none"), F.col("n"))).alias("m"))
    names = df.sparkSession.createDataFrame(list(enumerate(df.columns)), "i int, column_name string")
    none = lambda c: F.coalesce(c, F.lit(0).cast("long"))
    return names.join(found, "i", "left").select("column_name", none("t").alias("total_count"), none("d").alias("distinct_count"), none("m").alias("null_count"))


def values(df: DataFrame, columns: list[str]) -> DataFrame:
    """column_name, value: the distinct eligible values (not null, 1 to 100 characters) of text columns."""
    pairs = F.explode(F.array(*[F.struct(F.lit(c).alias("column_name"), F.col(c).cast("string").alias("value")) for c in columns])).alias("x")
    rows = df.select(pairs).select("x.*").where(F.length("value").between(1, 100))
    return rows.distinct()


def first_values(found: DataFrame, n: int, *order) -> DataFrame:
    """The first n values of each column."""
    rank = F.row_number().over(Window.partitionBy("column_name").orderBy(*order))
    return found.withColumn("rank", rank).where(F.col("rank") <= n)


def dictionary(df: DataFrame, columns: list[str], n: int) -> DataFrame:
    """A pseudo-random but deterministic sample of each column's values: the first n by md5, then value."""
    return first_values(values(df, columns), n, F.md5(F.col("value").cast("binary")), "value")


def column_status(found: DataFrame) -> DataFrame:
    """Whether a column's values are worth an index: all UUIDs and all numbers are not."""
    all_of = lambda p: F.bool_and(F.col("value").rlike(p))
    status = F.when(all_of(UUID), "uuid").when(all_of(NUMBER), "numeric").otherwise("collected")
    return found.groupBy("column_name").agg(F.count("*").alias("n_values"), status.alias("status"))


def union_all(frames: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, frames)
