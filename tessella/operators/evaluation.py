"""Steps of an evaluation as wholes: asserted joins, value indexes and retrieval, linking, revision, selection, offline evaluation."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .. import functions as T
from . import compare, vote


def joined_one_to_one(left: DataFrame, right: DataFrame, key: list[str], agree: list[str] | None = None) -> DataFrame:
    """left and right by key. Fails while it runs if a key repeats on a side, is missing on the right, or the columns of `agree`, which both have,
    differ; nothing is dropped in silence."""
    once = lambda df, side: df.withColumn(f"_{side}", F.count("*").over(Window.partitionBy(*key)))
    agree = agree or []
    right = once(right, "right").withColumnsRenamed({c: f"_right_{c}" for c in agree})
    both = once(left, "left").join(right, key, "left")
    fault = F.when(F.col("_right").isNull(), "missing").when((F.col("_left") > 1) | (F.col("_right") > 1), "repeated")
    for c in agree:
        fault = F.when(fault.isNull() & ~F.col(c).eqNullSafe(F.col(f"_right_{c}")), f"{c} differs").otherwise(fault)
    checked = both.where(F.when(fault.isNotNull(), F.raise_error(F.concat_ws(" ", F.lit("join:"), fault, *[F.col(k).cast("string") for k in key])).cast("boolean")).otherwise(True))
    return checked.drop("_left", "_right", *[f"_right_{c}" for c in agree])


def membership(a: DataFrame, b: DataFrame, key: str) -> DataFrame:
    """One row: how many ids only a has, only b has, both have, repeat on either side, and whether the two are the same set without repeats."""
    sides = a.groupBy(key).agg(F.count("*").alias("n_a")).join(b.groupBy(key).agg(F.count("*").alias("n_b")), key, "full")
    only_a, only_b = F.col("n_b").isNull(), F.col("n_a").isNull()
    again = (F.coalesce("n_a", F.lit(0)) > 1) | (F.coalesce("n_b", F.lit(0)) > 1)
    return sides.agg(
        F.count_if(only_a).alias("only_a"), F.count_if(only_b).alias("only_b"), F.count_if(~only_a & ~only_b).alias("shared"), F.count_if(again).alias("repeated"),
        (F.count_if(only_a | only_b | again) == 0).alias("equal"),
    )


def normalised(vectors: DataFrame, column: str = "embedding") -> DataFrame:
    """vectors divided by their length; rows that are null, empty or zero go."""
    v = F.col(column).cast("array<double>")
    size = F.sqrt(F.aggregate(v, F.lit(0.0), lambda s, x: s + x * x))
    return vectors.withColumn(column, F.when(size > 0, F.transform(v, lambda x: x / size))).where(F.col(column).isNotNull())


def merged_examples(retrieved: Column, original: Column, k: int) -> Column:
    """The first k of what was retrieved, then what was there, each once."""
    return F.slice(F.array_distinct(F.concat(retrieved, original)), 1, k)


def linked_union(links: DataFrame, linkers: int) -> DataFrame:
    """item, table_name, column_name that any linker found, from links (item, linker, ok, table_name, column_name; nulls: found none); items
    of which a linker failed or is missing have no link but one row with failed = true."""
    own = links.groupBy("item").agg((F.bool_and("ok") & (F.count_distinct("linker") == linkers)).alias("whole"))
    found = links.where("table_name is not null").select("item", "table_name", "column_name").distinct()
    good = found.join(own.where("whole"), "item", "left_semi").withColumn("failed", F.lit(False))
    return good.unionByName(own.where(~F.col("whole")).select("item", F.lit(True).alias("failed")), allowMissingColumns=True)


def linked_crops(links: DataFrame, linkers: int, columns: DataFrame, fks: DataFrame) -> DataFrame:
    """item, table_name, column_name: each item's catalog after linking, keys of its tables and both ends of edges between them included."""
    picked = linked_union(links, linkers).where(~F.col("failed")).select("item", "table_name", "column_name")
    tables = picked.select("item", "table_name").distinct()
    keys = columns.where("is_pk").join(tables, "table_name").select("item", "table_name", "column_name")
    ends = tables.join(fks, "table_name").join(tables.withColumnRenamed("table_name", "ref_table"), ["item", "ref_table"])
    whole = picked.unionByName(keys).union(ends.select("item", "table_name", "column_name")).union(ends.select("item", "ref_table", "ref_column")).distinct()
    return whole.join(columns.select("table_name", "column_name").distinct(), ["table_name", "column_name"], "left_semi").select("item", "table_name", "column_name")


def remapped(columns: DataFrame, picked: DataFrame, fks: DataFrame) -> tuple[DataFrame, DataFrame]:
    """A crop with ids from 0: columns (db, table_id, column_id) that are picked, with new_table and new_column, and the foreign keys (db, column_id,
    ref_id) both of whose ends are left, by new ids. Order is kept."""
    kept = columns.join(picked, ["db", "column_id"], "left_semi")
    own = Window.partitionBy("db")
    kept = kept.withColumn("new_table", F.dense_rank().over(own.orderBy("table_id")) - 1).withColumn("new_column", F.dense_rank().over(own.orderBy("column_id")) - 1)
    new = kept.select("db", "column_id", F.col("new_column").alias("new_id")).distinct()
    ref = new.select("db", F.col("column_id").alias("ref_id"), F.col("new_id").alias("new_ref"))
    return kept, fks.join(new, ["db", "column_id"]).join(ref, ["db", "ref_id"]).select("db", "new_id", "new_ref")


def native_links(matches: DataFrame, columns: DataFrame) -> DataFrame:
    """item, table_name, column_name (null: the table itself) from matches (item, channel, name, place) whose place is `question,schema`: tables by
    q_tab_match, columns by the others; column 0, the wildcard, is left out, and a column brings its table."""
    at = F.split_part("place", F.lit(","), F.lit(2)).cast("int")
    by_table = matches.where("name = 'q_tab_match'").select("item", at.alias("table_id"))
    by_column = matches.where("name in ('q_col_match', 'num_date_match', 'cell_match')").select("item", at.alias("column_id")).where("column_id <> 0").distinct()
    found = by_column.join(columns.select("column_id", "table_id", "table_name", F.trim("column_name").alias("column_name")), "column_id")
    names = columns.select("table_id", F.trim("table_name").alias("table_name")).distinct()
    tables = by_table.union(found.select("item", "table_id")).distinct().join(names, "table_id").select("item", "table_name", F.lit(None).cast("string").alias("column_name"))
    return tables.union(found.select("item", F.trim("table_name"), "column_name").distinct())


def revised(candidates: DataFrame, sql: str = "sql") -> DataFrame:
    """candidates (item, slot, sql) with revised and the checks that found something: each distinct text of an item goes through the chain once,
    and what becomes of it goes back to every slot that has it."""
    unique = candidates.select("item", sql).distinct()
    text = T.separate_names(T.quoted_year(F.col(sql)))
    found = [F.when(c, F.lit(name)) for name, c in T.checks(F.col(sql)).items()]
    chain = unique.select("item", sql, text.alias("revised"), F.array_compact(F.array(*found)).alias("checks"))
    return candidates.join(chain, ["item", sql], "left")


def selected(candidates: DataFrame, votes: DataFrame, k: int, threshold: float) -> DataFrame:
    """item, slot, branch from candidates (item, slot, result_hash) and votes (item, a, b, n_a, n_b, n_tie) between slots: no_valid with the
    first slot if no result is valid; single if there is one cluster; shortcut if the best of the shortlist of k has `threshold` of the valid slots or more; else
    pairwise, by win rate times share of the shortlist's scores."""
    best = vote.consistency(candidates).where(F.col("rank") <= k)
    first = Window.partitionBy("item")
    short = best.withColumn("n", F.count("*").over(first)).withColumn("top", F.max("score").over(first)).withColumn("weight", F.col("score") / F.sum("score").over(first))
    sides = votes.select("item", F.explode(F.array(
        F.struct(F.col("a").alias("slot"), F.col("b").alias("other"), "n_tie", F.col("n_a").alias("own"), F.col("n_b").alias("their")),
        F.struct(F.col("b").alias("slot"), F.col("a").alias("other"), "n_tie", F.col("n_b").alias("own"), F.col("n_a").alias("their")),
    )).alias("x")).select("item", "x.*")
    rivals = short.select("item", F.col("representative").alias("other"))
    wins = sides.join(rivals, ["item", "other"], "left_semi").groupBy("item", "slot").agg(F.sum(F.try_divide(F.col("own") + 0.5 * F.col("n_tie"), F.col("own") + F.col("their") + F.col("n_tie"))).alias("wins"))
    scored = short.join(wins, (short["item"] == wins["item"]) & (short["representative"] == wins["slot"]), "left").select(short["item"], "representative", "rank", "n", "top", (F.coalesce("wins", F.lit(0.0)) / F.col("n") * F.col("weight")).alias("points"))
    branch = F.when(F.col("n") == 1, "single").when(F.col("top") >= threshold, "shortcut").otherwise("pairwise")
    scored = scored.withColumn("branch", branch).withColumn("order", F.when(F.col("branch") == "pairwise", -F.round("points", 9)).otherwise(F.col("rank").cast("double")))
    chosen = scored.groupBy("item", "branch").agg(F.min_by("representative", F.struct("order", "rank")).alias("slot"))
    none = candidates.groupBy("item").agg(F.min("slot").alias("slot")).join(chosen, "item", "left_anti").withColumn("branch", F.lit("no_valid"))
    return chosen.unionByName(none)


def offline(spark: SparkSession, gold: list[tuple[str, str | None]], candidates: list[tuple[str, int, str | None]], run, success: tuple[str, ...]) -> DataFrame:
    """item, slot, state, comparable, bag_equal, set_equal, pool of candidates (item, slot, text) against the item's reference (item, text): a stated
    list of texts, which the driver has. Each distinct text runs once by `run` (text → state and rows); a missing text or reference, or one
    that fails, leaves equality unknown; pool is has_match if any of the item's is equal, unknown if none is but some are unknown, else no_match."""
    results: dict[str, tuple[str, DataFrame | None]] = {}

    def of(text: str | None) -> tuple[str, DataFrame | None]:
        if text is None or not text.strip():
            return "missing_sql", None
        if text not in results:
            results[text] = run(text)
        return results[text]

    wanted = dict(gold)
    pairs: dict[tuple[str | None, str | None], DataFrame] = {}
    rows = []
    for item, slot, text in candidates:
        state, own = of(text)
        gold_state, other = of(wanted.get(item))
        able = state in success and gold_state in success
        if able and (text, wanted[item]) not in pairs:
            bag, whole = compare.bag_equal(own, other), compare.set_equal(own, other)
            pairs[text, wanted[item]] = bag.select("comparable", F.col("equal").alias("bag_equal")).join(whole.select(F.col("equal").alias("set_equal")))
        rows.append((item, slot, state, text if able else None, wanted.get(item) if able else None))
    each = spark.createDataFrame(rows, "item string, slot int, state string, text string, reference string")
    if pairs:
        found = reduce(DataFrame.unionByName, [df.withColumns({"text": F.lit(a), "reference": F.lit(b)}) for (a, b), df in pairs.items()])
        each = each.join(found, ["text", "reference"], "left")
    else:
        each = each.withColumns({c: F.lit(None).cast("boolean") for c in ("comparable", "bag_equal", "set_equal")})
    pool = Window.partitionBy("item")
    label = F.when(F.max(F.coalesce("bag_equal", F.lit(False)).cast("int")).over(pool) == 1, "has_match").when(F.max(F.col("bag_equal").isNull().cast("int")).over(pool) == 1, "unknown").otherwise("no_match")
    return each.select("item", "slot", "state", F.coalesce("comparable", F.lit(False)).alias("comparable"), "bag_equal", "set_equal", label.alias("pool"))


def resumed(attempts: DataFrame, key: list[str]) -> DataFrame:
    """What a restart may take over, from attempts (key, attempt, ok): the last successful attempt of each key; keys without one may run again."""
    last = attempts.groupBy(*key).agg(F.max(F.when(F.col("ok"), F.col("attempt"))).alias("restored"), F.max("attempt").alias("last"))
    return last.withColumn("action", F.when(F.col("restored").isNotNull(), "restore").otherwise("retry"))


def fair_order(jobs: DataFrame, queue: str, order: str) -> DataFrame:
    """jobs with turn: one of each queue after another, in the queues' own order."""
    own = Window.partitionBy(queue).orderBy(order)
    return jobs.withColumn("turn", F.row_number().over(own))


def resolved_by_glob(asked: DataFrame, names: DataFrame) -> DataFrame:
    """asked (query) with a `*` resolved against names (name), both small: the first name in order that the pattern matches whole, without case."""
    found = asked.where(F.contains("query", F.lit("*"))).join(F.broadcast(names) if names.limit(10_001).count() <= 10_000 else names, F.rlike(F.lower("name"), T.glob(F.col("query"))), "left")
    return found.groupBy("query").agg(F.min("name").alias("name"), F.count("name").alias("n"))


