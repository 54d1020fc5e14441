"""Ranks over a whole table without one task holding it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Ranges for each shuffle partition, and keys drawn for each range.
RANGES, DRAWN = 4, 16


def _bounds(df: DataFrame, key: str, ranges: int) -> DataFrame:
    """One row: bounds, the keys in order that part a drawn few into ranges. The few have the smallest hashes, so that they are a function
    of the table alone, whatever its layout and however often it is read."""
    few = df.select(key).where(F.col(key).isNotNull()).orderBy(F.xxhash64(key)).limit(ranges * DRAWN)
    return few.agg(F.sort_array(F.collect_list(key)).alias("bounds")).select(F.filter("bounds", lambda _, i: i % DRAWN == 0).alias("bounds"))


def _range(key: Column, ranges: int) -> Column:
    """How many bounds are no larger than a key, by binary search; of a null key none."""
    steps = F.array(*[F.lit(1 << k) for k in reversed(range(ranges.bit_length()))])

    def further(at: Column, step: Column) -> Column:
        return F.when((at + step <= F.size("bounds")) & (F.get("bounds", at + step - 1) <= key), at + step).otherwise(at)

    return F.aggregate(steps, F.lit(0), further)


def global_rank(df: DataFrame, key: str) -> DataFrame:
    """df with rank: its row number by a total order. Rows are dealt out by ranges of the key and numbered in their range; a
    table of one count a range gives what lies before. Which range a row is in follows from its key and the bounds, not from where
    Spark puts it, so that both sides agree though each reads the table."""
    ranges = RANGES * int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    placed = df.crossJoin(F.broadcast(_bounds(df, key, ranges))).withColumn("part", _range(F.col(key), ranges)).drop("bounds")
    counts = placed.groupBy("part").agg(F.count("*").alias("n"))
    before = counts.withColumn("before", F.coalesce(F.sum("n").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).select("part", "before")
    own = placed.withColumn("own", F.row_number().over(Window.partitionBy("part").orderBy(key)))
    return own.join(F.broadcast(before), "part").withColumn("rank", F.col("before") + F.col("own")).drop("part", "own", "before")
