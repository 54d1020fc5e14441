"""Three-valued pools, paired transitions, set metrics and corrections."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType


def kleene_or(flag: str) -> Column:
    """True if any is true, else unknown if any is unknown, else false (also of nothing)."""
    c = F.col(flag)
    return F.when(F.coalesce(F.bool_or(c), F.lit(False)), True).when(F.count_if(c.isNull()) > 0, F.lit(None).cast("boolean")).otherwise(False)


def pool_state(flag: str) -> Column:
    c = F.col(flag)
    return F.when(F.count_if(c) > 0, "has_match").when(F.count_if(c.isNull()) > 0, "unknown").otherwise("no_match")


def transition(before: str, after: str) -> Column:
    a, b = F.col(before), F.col(after)
    return (
        F.when(a.isNull() | b.isNull(), "unknown").when(~a & b, "repair").when(a & ~b, "harm").when(a, "unchanged_correct").otherwise("unchanged_incorrect")
    )


def strict_sum(c: str) -> Column:
    """null if any is null or there is none: an unknown amount isn't zero."""
    return F.when((F.count("*") == F.count(c)) & (F.count(c) > 0), F.sum(c))


@F.pandas_udf(DoubleType())
def mcnemar(gains: pd.Series, losses: pd.Series) -> pd.Series:
    """Exact two-sided binomial p of gains against losses; 1 if there are none."""
    def p(g: int, h: int) -> float:
        n, k = g + h, min(g, h)
        if n == 0:
            return 1.0
        i = np.arange(1, k + 1)
        logs = np.concatenate([[0.0], np.cumsum(np.log((n - i + 1) / i))]) - n * math.log(2)
        return min(1.0, 2 * float(np.exp(logs).sum()))

    return pd.Series([p(int(g), int(h)) for g, h in zip(gains, losses)])


def holm(df: DataFrame, p: str, order: list[str]) -> DataFrame:
    """df with holm: step-down adjusted p of all its rows, which are a family of tests and few."""
    by = Window.orderBy(p, *order)
    m = F.count("*").over(Window.partitionBy())
    step = F.least(F.lit(1.0), F.col(p) * (m - F.row_number().over(by) + 1))
    return df.withColumn("step", step).withColumn("holm", F.max("step").over(by.rowsBetween(Window.unboundedPreceding, 0))).drop("step")


def set_scores(df: DataFrame, gold: str, found: str) -> DataFrame:
    """df with tp, fp, fn, precision (0 of an empty prediction), recall (null of an empty gold), f1, exact, full_recall."""
    out = df.withColumn("tp", F.size(F.array_intersect(gold, found)).cast("long"))
    out = out.withColumn("fp", F.size(F.array_except(found, gold)).cast("long")).withColumn("fn", F.size(F.array_except(gold, found)).cast("long"))
    tp, fp, fn = F.col("tp"), F.col("fp"), F.col("fn")
    return (
        out.withColumn("precision", F.coalesce(F.try_divide(tp.cast("double"), tp + fp), F.lit(0.0)))
        .withColumn("recall", F.try_divide(tp.cast("double"), tp + fn))
        .withColumn("f1", F.coalesce(F.try_divide(2.0 * tp, 2 * tp + fp + fn), F.lit(0.0)))
        .withColumn("exact", (fp == 0) & (fn == 0)).withColumn("full_recall", fn == 0)
    )


def trimmed(df: DataFrame, group: str, value: str, sigmas: float = 3.0) -> DataFrame:
    """Mean of each group's values within so many population standard deviations of its mean."""
    stats = df.groupBy(group).agg(F.avg(value).alias("mu"), F.stddev_pop(value).alias("sd"))
    kept = df.join(stats, group).where(F.abs(F.col(value) - F.col("mu")) <= sigmas * F.col("sd") + 1e-12)
    return kept.groupBy(group).agg(F.count("*").alias("n"), F.avg(value).alias("trimmed_mean"))


def bootstrap_ratio(df: DataFrame, group: str, a: str, b: str, rounds: int = 2000, seed: int = 20260915) -> DataFrame:
    """Percentile interval of sum(b) / sum(a) by resampling pairs. The pairs are first counted, so that a group is its distinct
    pairs; a resample draws their multiplicities, which is drawing rows with replacement."""

    def draw(rows: pd.DataFrame) -> pd.DataFrame:
        x, y, n = (rows[c].to_numpy(float) for c in ("a", "b", "n"))
        rng = np.random.default_rng(seed)
        total = int(n.sum())
        order = np.lexsort((y, x))
        x, y, n = x[order], y[order], n[order]
        ratios = []
        for _ in range(rounds):
            m = rng.multinomial(total, n / total)
            ratios.append((m @ y) / (m @ x) if m @ x else np.nan)
        low, high = np.nanquantile(ratios, [0.025, 0.975])
        return pd.DataFrame({"grp": [str(rows["grp"].iloc[0])], "n": [total], "low": [low], "high": [high]})

    pairs = df.where(F.col(a).isNotNull() & F.col(b).isNotNull()).groupBy(F.col(group).cast("string").alias("grp"), F.col(a).cast("double").alias("a"), F.col(b).cast("double").alias("b")).agg(F.count("*").alias("n"))
    return pairs.groupBy("grp").applyInPandas(draw, "grp string, n long, low double, high double")
