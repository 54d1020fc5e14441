"""Schema crops along foreign keys, name resolution, signatures and closures."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def fk_edges(fks: DataFrame, columns: DataFrame) -> DataFrame:
    """fks (table_name, column_name, ref_table, ref_column) with resolved: whether both ends exist."""
    own = columns.select(F.col("table_name"), F.col("column_name")).distinct()
    ref = own.select(F.col("table_name").alias("ref_table"), F.col("column_name").alias("ref_column"), F.lit(True).alias("has_ref"))
    own = own.withColumn("has_own", F.lit(True))
    both = fks.join(own, ["table_name", "column_name"], "left").join(ref, ["ref_table", "ref_column"], "left")
    return both.select("table_name", "column_name", "ref_table", "ref_column", (F.col("has_own").isNotNull() & F.col("has_ref").isNotNull()).alias("resolved"))


def crop_strict(columns: DataFrame, picked: DataFrame, fks: DataFrame) -> DataFrame:
    """Picked columns in their order, each with those references whose other end is picked too, as `table.column` joined by `; `."""
    kept = columns.join(picked, ["table_name", "column_name"], "left_semi")
    ends = picked.select(F.col("table_name").alias("ref_table"), F.col("column_name").alias("ref_column"))
    refs = fks.join(ends, ["ref_table", "ref_column"], "left_semi").groupBy("table_name", "column_name")
    refs = refs.agg(F.array_join(F.sort_array(F.collect_set(F.concat_ws(".", "ref_table", "ref_column"))), "; ").alias("ref_key"))
    return kept.join(refs, ["table_name", "column_name"], "left").select("table_name", "column_name", F.coalesce("ref_key", F.lit("")).alias("ref_key"))


def crop_closed(columns: DataFrame, picked: DataFrame, fks: DataFrame) -> DataFrame:
    """Picked columns, the primary keys of their tables, and both ends of each foreign key between such tables."""
    tables = picked.select("table_name").distinct()
    keys = columns.where("is_pk").join(tables, "table_name", "left_semi").select("table_name", "column_name")
    between = fks.join(tables, "table_name", "left_semi").join(tables.withColumnRenamed("table_name", "ref_table"), "ref_table", "left_semi")
    ends = between.select("table_name", "column_name").union(between.select("ref_table", "ref_column"))
    whole = picked.select("table_name", "column_name").union(keys).union(ends).distinct()
    return columns.join(whole, ["table_name", "column_name"], "left_semi").select("table_name", "column_name")


def signature_groups(columns: DataFrame) -> DataFrame:
    """Tables of the same column names, where there are several."""
    each = columns.groupBy("table_name").agg(F.array_join(F.sort_array(F.collect_list(F.lower("column_name"))), "||").alias("signature"))
    return each.groupBy("signature").agg(F.count("*").alias("n_tables"), F.array_join(F.sort_array(F.collect_list("table_name")), ",").alias("tables")).where("n_tables > 1")


def resolve(asked: DataFrame, names: DataFrame) -> DataFrame:
    """asked (query) resolved against names (name): exact, then without case, then trimmed without case; the first way that finds
    any decides, and several finds are `ambiguous`."""
    fold = lambda c: F.lower(F.trim(c))
    pairs = asked.join(names.withColumn("k", fold(F.col("name"))), fold(F.col("query")) == F.col("k"), "left")
    way = F.when(F.col("name").isNull(), 9).when(F.col("query") == F.col("name"), 1).when(F.lower("query") == F.lower("name"), 2).otherwise(3)
    ranked = pairs.withColumn("way", way).withColumn("best", F.min("way").over(Window.partitionBy("query"))).where("way = best")
    found = F.count("name")
    return ranked.groupBy("query", "way").agg(F.min("name").alias("first"), found.alias("n")).select("query", F.when(F.col("n") == 1, F.col("first")).alias("name"), F.when(F.col("n") == 0, "missing").when(F.col("n") > 1, "ambiguous").otherwise("resolved").alias("status"))
