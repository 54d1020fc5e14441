"""Sinks: writes that refuse to overwrite, keyed appends and sealed packages."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def exclusive(df: DataFrame, path: str, kind: str = "json") -> None:
    """Write, or fail if there is something already."""
    df.write.mode("errorifexists").format(kind).save(path)


def append_new(df: DataFrame, path: str, key: list[str]) -> None:
    """Append the rows whose key isn't there yet (insert or ignore)."""
    spark = df.sparkSession
    try:
        there = spark.read.parquet(path).select(*key)
    except Exception as e:  # nothing written yet
        if "PATH_NOT_FOUND" not in str(e):
            raise
        there = None
    new = df.dropDuplicates(key)
    (new if there is None else new.join(there, key, "left_anti")).write.mode("append").parquet(path)


def checksummed(df: DataFrame) -> DataFrame:
    """df with record_checksum: the SHA-256 of the row as JSON."""
    return df.withColumn("record_checksum", F.sha2(F.to_json(F.struct(*sorted(df.columns)), {"ignoreNullFields": "false"}), 256))


def verified(df: DataFrame) -> DataFrame:
    """Rows whose checksum doesn't hold."""
    own = df.drop("record_checksum")
    return df.where(F.col("record_checksum") != F.sha2(F.to_json(F.struct(*sorted(own.columns)), {"ignoreNullFields": "false"}), 256))


def seal(df: DataFrame) -> DataFrame:
    """path, length, sha256 of files read as binaryFile: the manifest of a package."""
    return df.select("path", "length", F.sha2("content", 256).alias("sha256"))


def upsert(df: DataFrame, path: str, version: int) -> None:
    """Append a version of rows; `current` reads the last version of each key."""
    df.withColumn("_version", F.lit(version)).write.mode("append").parquet(path)


def current(df: DataFrame, key: list[str]) -> DataFrame:
    """The last version of each key, by aggregation."""
    rest = [c for c in df.columns if c not in (*key, "_version")]
    return df.groupBy(*key).agg(F.max_by(F.struct(*rest), "_version").alias("r")).select(*key, "r.*")


def without_known(df: DataFrame, cache: DataFrame, key: str) -> DataFrame:
    """Rows whose key a cache doesn't hold: what is still to be computed."""
    return df.join(cache.select(key).distinct(), key, "left_anti")


def cached_result(spark, folder: str, scope: str, sql: str) -> DataFrame:
    """A query's rows, from the folder's copy under its scope and text if there is one, else run once and kept. A copy that
    didn't end has no mark of success and is written anew."""
    import hashlib
    import json

    path = f"{folder}/{hashlib.sha256(json.dumps([scope, sql]).encode()).hexdigest()}"
    done = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/_SUCCESS")
    if not done.getFileSystem(spark._jsc.hadoopConfiguration()).exists(done):
        spark.sql(sql).write.mode("overwrite").parquet(path)
    return spark.read.parquet(path)


def export_texts(df: DataFrame, path: str, item: str, text: str) -> None:
    """A folder of each item with its text."""
    df.select(F.col(item), F.col(text).cast("string").alias("value")).write.mode("errorifexists").partitionBy(item).text(path)


def markdown(df: DataFrame, digits: int = 2, most: int = 1000) -> str:
    """A small report as a Markdown table; more rows than `most` are refused."""
    rows = df.limit(most + 1).collect()
    if len(rows) > most:
        raise ValueError(f"over {most} rows")
    said = lambda x: "" if x is None else f"{x:.{digits}f}" if isinstance(x, float) else str(x).replace("|", "\\|")
    lines = [df.columns, ["---"] * len(df.columns), *[[said(x) for x in r] for r in rows]]
    return "\n".join("| " + " | ".join(x) + " |" for x in lines)
