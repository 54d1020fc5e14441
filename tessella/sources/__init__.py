"""Readers with explicit schemas, and the driver's tables."""

from __future__ import annotations

import csv
import io
import re
import tempfile
import uuid
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def views(spark: SparkSession, sf_dir: str, text: str) -> None:
    """Temporary views of the tables that a query's text names."""
    for name in TABLES:
        if name in text:
            table(spark, sf_dir, name).createOrReplaceTempView(name)


def workspace(spark: SparkSession, tag: str) -> str:
    """A new path in the folder that driver and executors share; a local one is made for a local master only."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not found:
        if not re.match(r"local(\[|$)", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="tessella-"))
        found = spark.sparkContext.getCheckpointDir()
    return f"{found}/{tag}-{uuid.uuid4().hex}"


def decoded(raw: bytes) -> str:
    """Text of unknown encoding: by its mark, else UTF-8 if it is that, else the Western encoding of Windows."""
    for mark, name in ((b"\xff\xfe", "utf-16"), (b"\xfe\xff", "utf-16")):
        if raw.startswith(mark):
            return raw.decode(name, "replace")
    try:
        return raw.decode("utf-8-sig")
    except UnicodeDecodeError:
        return raw.decode("cp1252", "replace")


def described(spark: SparkSession, path: str, columns: tuple[str, ...] = ("original_column_name", "column_description")) -> DataFrame:
    """path and `columns` of the rows of CSV files whose encoding is found file by file, as each is a small description of one table;
    cells are trimmed, and a file without one of the columns has null there."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for name, raw in zip(batch["path"], batch["content"]):
                rows = [{(k or "").strip(): v for k, v in r.items()} for r in csv.DictReader(io.StringIO(decoded(raw), newline=""))]
                yield pd.DataFrame({"path": [name] * len(rows), **{c: [None if r.get(c) is None else r[c].strip() for r in rows] for c in columns}})

    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path).where("length > 0 and path not like '%/_SUCCESS'")
    return files.select("path", "content").mapInPandas(run, "path string, " + ", ".join(f"{c} string" for c in columns))


def json_array(spark: SparkSession, path: str, schema: str, key: list[str] | None = None) -> DataFrame:
    """A file that holds one JSON array of objects; malformed input fails, as do repeated keys."""
    return unique(spark.read.schema(schema).option("multiLine", True).option("mode", "FAILFAST").json(path), key)


def json_lines(spark: SparkSession, path: str, schema: str, key: list[str] | None = None) -> DataFrame:
    """One JSON object a line."""
    return unique(spark.read.schema(schema).option("mode", "FAILFAST").json(path), key)


def metadata_csv(spark: SparkSession, path: str) -> DataFrame:
    """Column descriptions from CSV files with a header, named by file: table_name and the header's columns, trimmed."""
    from pyspark.sql import functions as F

    rows = spark.read.option("header", True).option("multiLine", True).option("escape", "\"").csv(path).select("*", F.col("_metadata.file_name").alias("file_name"))
    cells = [F.trim(F.col(f"`{c}`")).alias(c.strip().lstrip("﻿")) for c in rows.columns if c != "file_name"]
    return rows.select(F.regexp_replace("file_name", r"\.csv$", "").alias("table_name"), *cells)


def unique(df: DataFrame, key: list[str] | None) -> DataFrame:
    """df, if no key repeats."""
    if key and not df.groupBy(*key).count().where("count > 1").isEmpty():
        raise ValueError(f"{key} repeats")
    return df
