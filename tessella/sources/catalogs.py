"""Readers of catalogs, descriptions and reference answers. What a file must have is checked by the plan that reads it: a bad
record fails the query with a message that names it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import json_array, json_lines, metadata_csv, unique

#: Words for true and false, and where the SQL of a reference answer stands.
TRUE, FALSE = ["true", "1", "yes", "y"], ["false", "0", "no", "n"]
SECTIONS = [("column_name", "Expanded Column Name: "), ("column_description", "Column Description: "), ("value_description", "Value Description: ")]
SQL_FIELDS = ("SQL", "sql"), ("query", "sql"), ("sol_sql",)


def json_records(spark: SparkSession, path: str, schema: str, key: list[str] | None = None) -> DataFrame:
    """A JSON array, or one object a line: the first character says which."""
    first = spark.read.text(path).select(F.substring(F.regexp_replace("value", r"^[﻿\s]+", ""), 1, 1).alias("c")).where("c != ''").first()
    return (json_array if first and first.c == "[" else json_lines)(spark, path, schema, key)


def failing(test: Column, message: Column, value: Column) -> Column:
    """value, or an error of that message if the test holds."""
    return F.when(F.coalesce(test, F.lit(False)), F.raise_error(message)).otherwise(value)


def strict_metadata(spark: SparkSession, path: str) -> DataFrame:
    """table_name, column_name, column_type, primary_key, foreign_keys (pairs of table and column), description, from CSV files
    with original_column_name and data_format. Empty names and types, unknown words for true, keys that aren't pairs and
    columns that repeat without regard to case are errors."""
    rows = metadata_csv(spark, path)
    if missing := {"original_column_name", "data_format"} - set(rows.columns):
        raise ValueError(f"{path} has no {sorted(missing)}")
    cell = lambda c: F.trim(F.coalesce(F.col(c), F.lit(""))) if c in rows.columns else F.lit("")
    name, kind, flag, refs = cell("original_column_name"), cell("data_format"), F.lower(cell("primary_key")), cell("foreign_keys")
    pairs = F.from_json(refs, "array<array<string>>")
    wrong = (refs != "") & F.coalesce(~F.forall(pairs, lambda x: (F.size(x) == 2) & F.forall(x, lambda y: F.trim(y) != "")), F.lit(True))
    place = F.concat(F.col("table_name"), F.lit("."), name)
    said = F.array_join(F.array_compact(F.array(*[F.when(cell(c) != "", F.concat(F.lit(head), cell(c))) for c, head in SECTIONS])), " | ")
    out = rows.select(
        "table_name",
        failing(name == "", F.concat(F.lit("empty column name in "), F.col("table_name")), name).alias("column_name"),
        failing(kind == "", F.concat(F.lit("no data format of "), place), kind).alias("column_type"),
        failing(~flag.isin("", *TRUE, *FALSE), F.concat(F.lit("primary_key isn't a boolean of "), place), flag.isin(*TRUE)).alias("primary_key"),
        failing(wrong, F.concat(F.lit("foreign_keys aren't pairs of "), place), F.coalesce(pairs, F.array().cast("array<array<string>>"))).alias("foreign_keys"),
        said.alias("description"),
    )
    return unique(out.withColumn("folded", F.lower("column_name")), ["table_name", "folded"]).drop("folded")


def column_meanings(spark: SparkSession, path: str) -> DataFrame:
    """table_key, column_key (lower case), source_key, description, from a JSON object of database|table|column → text, or an
    object with column_meaning and fields_meaning, which follows with its keys sorted."""
    text = spark.read.text(path, wholetext=True).select(F.regexp_replace("value", "^﻿", "").alias("value"))
    each = text.select(F.explode(F.from_json("value", "map<string,string>")).alias("source_key", "raw"))
    parts = F.split("source_key", r"\|")
    more = F.to_json(F.try_parse_json(F.get_json_object("raw", "$.fields_meaning")))
    main = F.when(F.trim("raw").startswith("{"), F.trim(F.get_json_object("raw", "$.column_meaning"))).otherwise(F.trim("raw"))
    said = F.when(more.isNotNull() & ~more.isin("{}", "null", '""'), F.concat(main, F.lit("\nFields: "), more)).otherwise(main)
    short = F.concat(F.lit("not database|table|column: "), F.col("source_key"))
    out = each.select(
        failing(F.size(parts) < 3, short, F.lower(F.element_at(parts, -2))).alias("table_key"), F.lower(F.element_at(parts, -1)).alias("column_key"),
        "source_key", failing(main.isNull(), F.concat(F.lit("no meaning of "), F.col("source_key")), said).alias("description"),
    )
    return unique(out, ["table_key", "column_key"])


def _dotted(name: Column) -> Column:
    """A dotted name without blanks around its dots."""
    return F.regexp_replace(F.trim(name), r"\s*\.\s*", ".")


def examples(values: Column, most: int = 3, longest: int = 100) -> Column:
    """The first distinct values as text that aren't too long; a missing value is NULL."""
    said = F.transform(values, lambda x: F.coalesce(x, F.lit("NULL")))
    return F.slice(F.array_distinct(F.filter(said, lambda x: F.length(x) <= longest)), 1, most)


def cloud_tables(spark: SparkSession, path: str) -> DataFrame:
    """table_name, table_fullname, position, column_name, column_type, description, value_examples, nested, from JSON files of one
    table each. Nested columns that are columns too are left out; nested sample values are JSON as the file spells it."""
    schema = "table_name string, table_fullname string, column_names array<string>, column_types array<string>, description array<string>, sample_rows array<map<string,string>>, nested_column_names array<string>, nested_column_types array<string>"
    t = json_array(spark, path, schema).withColumn("names", F.transform("column_names", _dotted))

    def listed(names: Column, types: str, told: bool, nested: bool) -> Column:
        kind = lambda i: F.coalesce(F.trim(F.get(types, i)), F.lit("UNKNOWN"))
        say = lambda i: F.coalesce(F.get("description", i), F.lit("")) if told else F.lit("")
        seen = lambda x: F.transform(F.filter("sample_rows", lambda r: F.map_contains_key(r, x)), lambda r: F.element_at(r, x))
        row = lambda x, i: F.struct(i.alias("position"), x.alias("column_name"), kind(i).alias("column_type"), say(i).alias("description"), F.coalesce(examples(seen(x)), F.array().cast("array<string>")).alias("value_examples"), F.lit(nested).alias("nested"))
        return F.coalesce(F.transform(names, row), F.array().cast("array<struct<position:int,column_name:string,column_type:string,description:string,value_examples:array<string>,nested:boolean>>"))

    inner = F.filter(listed(F.transform("nested_column_names", _dotted), "nested_column_types", False, True), lambda x: ~F.array_contains(F.col("names"), x["column_name"]))
    whole = F.concat(listed(F.col("names"), "column_types", True, False), inner)
    return t.select(F.trim("table_name").alias("table_name"), _dotted(F.col("table_fullname")).alias("table_fullname"), F.explode(whole).alias("c")).select("table_name", "table_fullname", "c.*")


def references(bindings: DataFrame, records: DataFrame, fields: tuple[str, ...] = SQL_FIELDS[2]) -> DataFrame:
    """bindings (task_key, external_id, database_id) with status and sql of the one record (external_id, database_id, record: a map
    of fields to JSON or text) that answers each. Records that want a set-up or a clean-up are refused."""
    r = records.select("external_id", F.col("database_id").alias("found_id"), "record")
    counted = r.groupBy("external_id").agg(F.count("*").alias("n"), F.min_by(F.struct("found_id", "record"), "found_id").alias("r"))
    both = bindings.join(counted, "external_id", "left")
    given = [F.when(~F.coalesce(F.element_at("r.record", f), F.lit("")).isin("", "[]"), F.element_at("r.record", f)) for f in fields]
    listed = F.from_json(F.coalesce(*given), "array<string>")
    sql = F.when(F.coalesce(*given).startswith("["), F.when(F.size(listed) == 1, listed[0])).otherwise(F.coalesce(*given))
    needs = F.exists(F.map_entries("r.record"), lambda e: ~F.coalesce(e["value"], F.lit("")).isin("", "[]", "{}", "null", "false", "0") & F.replace(F.lower(e["key"]), F.lit("_"), F.lit("")).rlike("preprocess|cleanup|^presql$|^postsql$"))
    status = (
        F.when(F.col("n").isNull(), "missing_reference").when(F.col("n") > 1, "duplicate_reference").when(~F.col("database_id").eqNullSafe(F.col("r.found_id")), "reference_database_mismatch")
        .when(needs, "unsupported_reference_setup").when(F.coalesce(F.trim(sql), F.lit("")) == "", "invalid_reference_sql").otherwise("available")
    )
    return both.select("task_key", "external_id", status.alias("status"), F.when(status == "available", sql).alias("sql"))


def whole_text(spark: SparkSession, path: str) -> DataFrame:
    """path, text of each file."""
    return spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("path"), F.col("value").alias("text"))
