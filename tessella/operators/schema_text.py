"""A catalog as text: one line a column, primary keys first, tables of the same columns told once, then foreign keys."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: What each level of shortening keeps, types that are told, and below the words of the text.
LEVELS = [
    {"description": True, "statistics": True, "examples": True, "nested": True},
    {"description": True, "statistics": False, "examples": False, "nested": True},
    {"description": True, "statistics": False, "examples": False, "nested": False},
    {"description": False, "statistics": False, "examples": False, "nested": False},
]
TYPES = ("bigquery", "snowflake", "sqlite")
UNUSEFUL = "Value Description: unuseful"


def useful(columns: DataFrame) -> DataFrame:
    """Columns that neither a flag nor their description calls of no use."""
    flag = F.coalesce(F.col("is_unuseful"), F.lit(False)) if "is_unuseful" in columns.columns else F.lit(False)
    said = F.exists(F.split(F.coalesce("description", F.lit("")), r"\|"), lambda x: F.trim(x) == UNUSEFUL)
    return columns.where(~flag & ~said)


def _line(keep: dict[str, bool]) -> Column:
    given = lambda c, text: F.when(F.lit(keep[c]) & text.isNotNull(), text)
    told = F.when(F.coalesce("description", F.lit("")) != "", F.col("description"))
    counts = F.concat(F.lit("Value Statistics: "), F.col("null_count").cast("string"), F.lit(" NULL values, "), F.col("distinct_count").cast("string"), F.lit(" distinct values, "), F.col("total_count").cast("string"), F.lit(" total values"))
    shown = F.when(F.size("value_examples") > 0, F.concat(F.lit("Value Examples: ['"), F.array_join("value_examples", "', '"), F.lit("']")))
    head = F.concat(F.lit("`"), F.col("column_name"), F.lit("`: "), F.col("data_type"))
    return F.concat(F.lit("("), F.concat_ws(" | ", head, F.when(F.col("is_pk"), F.lit("Primary Key")), given("description", told), given("statistics", counts), given("examples", shown)), F.lit(")"))


def profiles(columns: DataFrame, fks: DataFrame, level: int = 0, nested: DataFrame | None = None) -> DataFrame:
    """db_id, profile from columns (db_id, table_name, ordinal, column_name, data_type, is_pk, description, null_count,
    distinct_count, total_count, value_examples; db_type, if there is one, else SQLite's), foreign keys (db_id, table_name, column_name, ref_table,
    ref_column) and nested fields (db_id, table_name, name, data_type). Keys with a missing end aren't told. A database's catalog is one text
    and so one row."""
    kept = useful(columns)
    rows = kept.select("db_id", "table_name", "ordinal", F.lower("column_name").alias("low"), (~F.col("is_pk")).cast("int").alias("rest"), _line(LEVELS[level]).alias("line"))
    lines = F.transform(F.array_sort(F.collect_list(F.struct("rest", "ordinal", "line"))), lambda x: x["line"])
    body = F.concat(F.lit("[\n"), F.array_join(lines, ",\n"), F.lit("\n]\n"))
    per = rows.groupBy("db_id", "table_name").agg(body.alias("body"), F.array_join(F.sort_array(F.collect_list("low")), "||").alias("signature"))
    if nested is not None and LEVELS[level]["nested"]:
        field = F.concat(F.lit("  - "), F.col("name"), F.lit(": "), F.col("data_type"), F.lit("\n"))
        told = nested.groupBy("db_id", "table_name").agg(F.concat(F.lit("Nested Fields (accessible via UNNEST):\n"), F.array_join(F.sort_array(F.collect_list(field)), "")).alias("nested"))
        per = per.join(told, ["db_id", "table_name"], "left").withColumn("body", F.concat("body", F.coalesce("nested", F.lit("")))).drop("nested")
    alike = per.groupBy("db_id", "signature").agg(F.min("table_name").alias("first"), F.min_by("body", "table_name").alias("body"), F.sort_array(F.collect_list("table_name")).alias("names"))
    rest = F.slice("names", F.lit(2), F.size("names"))
    note = F.concat(
        F.lit("  [Note: The following "), F.size(rest).cast("string"), F.lit(" tables have IDENTICAL schema structure as `"), F.col("first"), F.lit("` above:\n  "),
        F.array_join(F.transform(rest, lambda x: F.concat(F.lit("`"), x, F.lit("`"))), ", "), F.lit("\n  You can query any of these tables using the same column structure.]\n\n"),
    )
    text = F.concat(F.lit("- Table: `"), F.col("first"), F.lit("`\n"), F.col("body"), F.when(F.size(rest) > 0, note).otherwise(F.lit("")))
    tables = alike.groupBy("db_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("first", text.alias("t")))), lambda x: x["t"]), "").alias("tables"))
    ends = kept.select("db_id", "table_name", "column_name").distinct()
    refs = ends.select("db_id", F.col("table_name").alias("ref_table"), F.col("column_name").alias("ref_column"))
    edges = fks.join(ends, ["db_id", "table_name", "column_name"], "left_semi").join(refs, ["db_id", "ref_table", "ref_column"], "left_semi")
    edge = F.concat(F.lit("`"), F.col("table_name"), F.lit("`.`"), F.col("column_name"), F.lit("` = `"), F.col("ref_table"), F.lit("`.`"), F.col("ref_column"), F.lit("`"))
    told = edges.groupBy("db_id").agg(F.concat(F.lit("Foreign Keys:\n"), F.array_join(F.sort_array(F.collect_set(edge)), "\n")).alias("keys"))
    typed = columns.groupBy("db_id").agg(F.max(F.col("db_type") if "db_type" in columns.columns else F.lit("sqlite")).alias("db_type"))
    kind = F.when(F.lower("db_type").isin(*TYPES), F.concat(F.lit("Database Type: "), F.upper("db_type"), F.lit("\n"))).otherwise(F.lit(""))
    head = F.concat(F.lit("Database ID: `"), F.col("db_id"), F.lit("`\n"), kind, F.lit("Schema:\n"))
    return tables.join(told, "db_id", "left").join(typed, "db_id").select("db_id", F.concat(head, F.col("tables"), F.coalesce("keys", F.lit(""))).alias("profile"))


def fitting(columns: DataFrame, fks: DataFrame, most: int, nested: DataFrame | None = None) -> DataFrame:
    """db_id, level, profile: the least shortened text of at most `most` tokens, estimated as a quarter of its characters; level
    is the number of levels and the text null if none fits."""
    found = None
    for level in range(len(LEVELS)):
        one = profiles(columns, fks, level, nested).withColumn("level", F.lit(level))
        found = one if found is None else found.unionByName(one)
    fits = F.floor(F.length(F.trim("profile")) / 4) <= most
    best = found.groupBy("db_id").agg(F.min_by(F.when(fits, F.struct("level", "profile")), F.when(fits, F.col("level"))).alias("b"))
    return best.select("db_id", F.coalesce("b.level", F.lit(len(LEVELS))).alias("level"), "b.profile")
