"""Reports on paired conditions: every count that isn't known is its own column, never zero or false."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .metrics import kleene_or, strict_sum


def _n(test: Column) -> Column:
    return F.count_if(F.coalesce(test, F.lit(False)))


def _share(a: Column, b: Column) -> Column:
    return F.try_divide(a.cast("double"), b.cast("double"))


def _pair(df: DataFrame, key: list[str], mode: str, control: str, columns: list[str]) -> DataFrame:
    """Rows of each mode beside the control's of the same key, whose columns begin with base_."""
    base = df.where(F.col(mode) == control).select(*key, *[F.col(c).alias(f"base_{c}") for c in columns])
    return df.join(base, key, "left")


def candidate_matches(cells: DataFrame) -> DataFrame:
    """Of cells (grp, question, mode, slot, match, ...): candidates, matches, and the share of matches among the known."""
    known = F.count("match")
    return cells.groupBy("grp", "mode").agg(
        F.count("*").alias("candidate_count"), _n(F.col("match")).alias("matched"), known.alias("evaluable"),
        (F.count("*") - known).alias("unknown"), _share(_n(F.col("match")), known).alias("observed_match_ratio"),
    )


def _questions(cells: DataFrame) -> DataFrame:
    # a set of slots of any size as a number, so that equal sets are equal numbers
    examples = F.coalesce(F.bit_xor(F.when(F.col("match"), F.xxhash64("slot"))), F.lit(0).cast("long"))
    return cells.groupBy("grp", "question", "mode").agg(
        F.count("*").alias("n"), F.count("match").alias("known"), _n(F.col("match")).alias("matched"), kleene_or("match").alias("covered"),
        F.min_by(F.struct("match"), "slot")["match"].alias("final"), examples.alias("examples"), strict_sum("tokens").alias("tokens"),
    )


def candidate_changes(cells: DataFrame, control: str = "native") -> DataFrame:
    """How the matches among complete candidate sets of a question change from the control's."""
    q = _pair(_questions(cells), ["grp", "question"], "mode", control, ["n", "known", "matched"])
    complete = F.coalesce((F.col("n") == F.col("known")) & (F.col("base_n") == F.col("base_known")), F.lit(False))
    # shares compared as products of whole numbers
    delta = F.col("matched") * F.col("base_n") - F.col("base_matched") * F.col("n")
    return q.groupBy("grp", "mode").agg(
        _n(complete & (delta > 0)).alias("increased"), _n(complete & (delta < 0)).alias("decreased"), _n(complete & (delta == 0)).alias("unchanged"), _n(~complete).alias("incomplete")
    )


def coverage(cells: DataFrame, control: str = "native") -> DataFrame:
    """Questions with a match among their candidates, and how that changes."""
    q = _pair(_questions(cells), ["grp", "question"], "mode", control, ["covered"])
    a, b = F.col("base_covered"), F.col("covered")
    return q.groupBy("grp", "mode").agg(
        F.count("*").alias("total"), _n(b).alias("covered"), _n(b.isNull()).alias("unknown"), _share(_n(b), F.count("*")).alias("coverage_ratio"),
        _n(~a & b).alias("none_to_some"), _n(a & ~b).alias("some_to_none"), _n(a.isNull() | b.isNull()).alias("paired_unknown"),
    )


def final_outputs(cells: DataFrame, control: str = "native") -> DataFrame:
    """The first candidate as the answer."""
    q = _pair(_questions(cells), ["grp", "question"], "mode", control, ["final"])
    a, b = F.col("base_final"), F.col("final")
    return q.groupBy("grp", "mode").agg(
        F.count("*").alias("total"), _n(b).alias("matched"), F.count("final").alias("evaluable"), _share(_n(b), F.count("*")).alias("match_ratio"),
        _share(_n(b), F.count("final")).alias("observed_match_ratio"), _n(~a & b).alias("wrong_to_right"), _n(a & ~b).alias("right_to_wrong"), _n(a.isNull() | b.isNull()).alias("paired_unknown"),
    )


def voting(cells: DataFrame) -> DataFrame:
    """Of the questions with a match among their candidates: how many of the answers match."""
    q, can = _questions(cells), F.col("covered")
    return q.groupBy("grp", "mode").agg(
        _n(can).alias("correct_available"), _n(can & F.col("final")).alias("selected_correct"), _n(can & F.col("final").isNull()).alias("selected_unknown"),
        _share(_n(can & F.col("final")), _n(can)).alias("selection_ratio"), _n(~can).alias("all_incorrect"),
    )


def example_changes(cells: DataFrame, control: str = "native") -> DataFrame:
    """Whether a question has the control's examples."""
    q = _pair(_questions(cells), ["grp", "question"], "mode", control, ["examples"])
    same = F.col("examples") == F.col("base_examples")
    return q.groupBy("grp", "mode").agg(_n(same).alias("same"), _n(~same).alias("different"), _n(same.isNull()).alias("unknown"))


def mode_usage(cells: DataFrame) -> DataFrame:
    """Tokens of the questions whose every amount is known, and of how many it isn't."""
    return _questions(cells).groupBy("grp", "mode").agg(F.sum("tokens").alias("known_tokens"), _n(F.col("tokens").isNull()).alias("unknown_questions"), strict_sum("tokens").alias("tokens"))


def stage_pairs(pairs: DataFrame, by: str = "stage") -> DataFrame:
    """Of rows (stage, base, variant, base_tokens, variant_tokens): what pairs known on both sides say."""
    a, b = F.col("base"), F.col("variant")
    known, spent = a.isNotNull() & b.isNotNull(), F.col("base_tokens").isNotNull() & F.col("variant_tokens").isNotNull()
    of = lambda c: F.sum(F.when(spent, F.col(c)))
    pct = lambda x: 100 * _share(x, _n(known))
    return pairs.groupBy(by).agg(
        F.count("*").alias("finished"), _n(known).alias("pairs"), pct(_n(known & a)).alias("base_pct"), pct(_n(known & b)).alias("variant_pct"),
        pct(_n(known & b) - _n(known & a)).alias("delta_pp"), _n(known & ~a & b).alias("wrong_to_right"), _n(known & a & ~b).alias("right_to_wrong"),
        _n(~known).alias("excluded"), _n(spent).alias("token_pairs"), (100 * (1 - _share(of("variant_tokens"), of("base_tokens")))).alias("saving_pct"),
    )


def failure_class(selected: str, pool: str, shortlist: str, asked: str) -> Column:
    """Where a choice went wrong, from three-valued matches of the choice, all inputs and the shortlist."""
    s, p, l = F.col(selected), F.col(pool), F.col(shortlist)  # noqa: E741
    return (
        F.when(s, "selected_match").when(s.isNull(), "selected_unresolved").when(p.isNull(), "input_unresolved").when(~p, "input_no_match")
        .when(l.isNull(), "shortlist_unresolved").when(~l, "lost_before_final_choice").when(F.col(asked), "model_miss").otherwise("rule_miss")
    )


def symmetric_errors(df: DataFrame, gold: str, base: str, variant: str) -> DataFrame:
    """One row: in how many rows the variant's set has fewer, more or as many errors (missing or surplus) as the base's."""
    off = lambda c: F.size(F.array_except(gold, c)) + F.size(F.array_except(c, gold))
    d = off(variant) - off(base)
    return df.agg(F.count("*").alias("questions"), _n(d < 0).alias("improvements"), _n(d > 0).alias("regressions"), _n(d == 0).alias("unchanged"))


def recall_directions(df: DataFrame, gold: str, base: str, variant: str) -> DataFrame:
    """As symmetric_errors by recall; a question without gold has none and doesn't count."""
    hit = lambda c: F.size(F.array_intersect(gold, c))
    d = F.when(F.size(gold) > 0, hit(variant) - hit(base))
    return df.agg(F.count(d).alias("eligible"), _n(d > 0).alias("improvements"), _n(d < 0).alias("regressions"), _n(d == 0).alias("unchanged"))


def feature_counts(df: DataFrame, group: str, status: str, tags: str) -> DataFrame:
    """Counts by group, status and each of a row's features; a null group is all groups."""
    each = df.select(group, status, F.explode(F.array_distinct(tags)).alias("feature"))
    sets = [[F.col(group), F.col(status), F.col("feature")], [F.col(status), F.col("feature")]]
    return each.groupingSets(sets, group, status, "feature").agg(F.count("*").alias("n"))


def first_equal(candidates: DataFrame, item: str = "item", slot: str = "slot", result: str = "result_hash") -> DataFrame:
    """item, winner, tie, fallback: the first of the largest group of equal results, of tied ones the earliest; without any result
    the first slot. Groups are counted before an item's are compared."""
    groups = candidates.groupBy(item, result).agg(F.when(F.col(result).isNull(), F.lit(0)).otherwise(F.count("*")).alias("n"), F.min(slot).alias("first"))
    levels = groups.groupBy(item, "n").agg(F.min("first").alias("first"), F.count("*").alias("groups"))
    best = levels.groupBy(item).agg(F.max(F.struct("n", "first", "groups")).alias("top"))
    return best.select(item, F.col("top.first").alias("winner"), ((F.col("top.n") > 0) & (F.col("top.groups") > 1)).alias("tie"), (F.col("top.n") == 0).alias("fallback"))


def quota(df: DataFrame, group: str, key: str, n: int, seed: int = 0) -> DataFrame:
    """n rows of each group, drawn by a hash of the key and the seed."""
    w = Window.partitionBy(group).orderBy(F.md5(F.concat_ws(":", F.lit(str(seed)), F.col(key).cast("string"))), key)
    return df.withColumn("place", F.row_number().over(w)).where(F.col("place") <= n)


def rolling_budget(df: DataFrame, group: str, seconds: str, amount: str, width: int = 60) -> DataFrame:
    """df with spent (the group's amount in the `width` seconds up to the row's) and total (all up to and with it)."""
    w = Window.partitionBy(group).orderBy(seconds)
    return df.withColumn("spent", F.sum(amount).over(w.rangeBetween(1 - width, 0))).withColumn("total", F.sum(amount).over(w.rangeBetween(Window.unboundedPreceding, 0)))


def both_sides(a: DataFrame, b: DataFrame, key: str) -> DataFrame:
    """key, side: the keys of one side only, as missing (from b) and extra (in b only)."""
    x, y = a.select(key).distinct().withColumn("in_a", F.lit(True)), b.select(key).distinct().withColumn("in_b", F.lit(True))
    side = F.when(F.col("in_b").isNull(), "missing").when(F.col("in_a").isNull(), "extra")
    return x.join(y, key, "full").select(key, side.alias("side")).where("side is not null")
