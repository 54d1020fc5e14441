"""One read-only query with a time limit: what became of it, and its rows as a table that isn't run again."""

from __future__ import annotations

import threading
import time
import uuid
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources import backends
from . import lineage

#: States whose rows can be compared.
COMPARABLE = ("success", "empty_result", "all_null_result")


@dataclass
class Result:
    """state: success, empty_result, all_null_result, timeout or execution_error."""

    state: str
    seconds: float
    rows: DataFrame | None = None
    error: str | None = None


def execute(spark: SparkSession, sql: str, folder: str, backend: dict | None = None, timeout: float = 600) -> Result:
    """Run one query within `timeout` seconds and keep its rows as Parquet in `folder`, which driver and executors share. Text
    that isn't one query that only reads is refused before anything runs. When time is up, the query's jobs are cancelled."""
    began, group = time.monotonic(), f"query-{uuid.uuid4().hex}"
    spent = lambda: time.monotonic() - began
    where = {"kind": "spark", **(backend or {})}
    if where["kind"] == "spark" and not lineage.read_only(spark, sql):
        return Result("execution_error", spent(), error="not one query that only reads")
    late = threading.Event()
    sc = spark.sparkContext

    def stop() -> None:
        late.set()
        sc.cancelJobGroup(group)

    timer = threading.Timer(timeout, stop)
    timer.daemon = True
    sc.setJobGroup(group, sql[:100], interruptOnCancel=True)
    timer.start()
    try:
        df = backends.reader(spark, where, sql, int(timeout))
        if where["kind"] == "spark" and not lineage.changes_nothing(df):
            return Result("execution_error", spent(), error="not one query that only reads")
        names = [f"c{i}" for i in range(len(df.columns))]  # names may repeat
        path = f"{folder}/{group}"
        df.toDF(*names).write.parquet(path)
        rows = spark.read.schema(df.toDF(*names).schema).parquet(path)
        some = F.greatest(*[F.col(c).isNotNull().cast("int") for c in names * 2])  # greatest wants two
        found = rows.agg(F.count("*").alias("n"), F.max(some).alias("some")).first()
        if late.is_set():
            return Result("timeout", spent(), error=f"over {timeout} s")
        state = "empty_result" if not found.n else "success" if found.some else "all_null_result"
        return Result(state, spent(), rows)
    except Exception as e:
        return Result("timeout" if late.is_set() else "execution_error", spent(), error=str(e).split("\n")[0])
    finally:
        timer.cancel()
        sc.setLocalProperty("spark.jobGroup.id", None)
        sc.setLocalProperty("spark.job.description", None)
        sc.setLocalProperty("spark.job.interruptOnCancel", None)
