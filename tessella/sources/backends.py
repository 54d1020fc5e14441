"""Where a query runs: Spark's own views, a SQLite file, or a connector that the cluster has."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from .sqlite import Sqlite


def reader(spark: SparkSession, backend: dict, sql: str, timeout: int = 600) -> DataFrame:
    """The rows of one query on a backend: {"kind": "spark" | "sqlite" | "postgres" | "bigquery" | "snowflake", ...}. The last
    three hand the text to connectors, whose JARs the session must have; what else a backend holds are their options."""
    kind, rest = backend.get("kind", "spark"), {k: v for k, v in backend.items() if k != "kind"}
    if kind == "spark":
        return spark.sql(sql)
    if kind == "sqlite":
        spark.dataSource.register(Sqlite)
        return spark.read.format("sqlite").options(**rest, query=sql).load()
    if kind == "postgres":
        start = "set default_transaction_read_only = on; set search_path = pg_catalog, public"
        return spark.read.format("jdbc").options(**rest, query=sql, queryTimeout=timeout, sessionInitStatement=start).load()
    if kind in ("bigquery", "snowflake"):
        return spark.read.format(kind).options(**rest, query=sql).load()
    raise ValueError(f"unknown backend {kind}")
