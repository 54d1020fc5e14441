"""Reading tables, the shared scratch folder and Arrow batches."""

from __future__ import annotations

import re
import tempfile
import threading
import uuid
from collections.abc import Iterator
from weakref import WeakKeyDictionary

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows taken out of an Arrow batch at a time, so that few texts are Python objects at once.
ROWS = 256
#: Public setting: shuffle files of a query are removed when it ends.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    """A table of the test data, by a path that only Spark opens."""
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir, which driver and executors share. Where it is unset, a local one is made for a local
    master; on a cluster executors couldn't see that, so it must be set there."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not found:
        if not re.match(r"local(\[|$)", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="tessella-"))
        found = spark.sparkContext.getCheckpointDir()
    return found


def scratch(spark: SparkSession, tag: str) -> str:
    """A new path in the shared folder."""
    return f"{shared_dir(spark)}/{tag}-{uuid.uuid4().hex}"


#: Where what stored() gave lies; writes under way by session, and what the setting was before them.
_PATHS: WeakKeyDictionary[DataFrame, str] = WeakKeyDictionary()
_WRITES: WeakKeyDictionary[SparkSession, list] = WeakKeyDictionary()
_LOCK = threading.Lock()


def stored(df: DataFrame, tag: str) -> DataFrame:
    """df written to the shared folder and read again: its lineage ends there and lost executors don't lose it.
    The shuffle files of the query that wrote it go at once, as nothing reads them again; the session's setting for that is put back
    when its last such write is over, whichever thread makes it."""
    spark, path = df.sparkSession, scratch(df.sparkSession, tag)
    with _LOCK:
        under_way = _WRITES.setdefault(spark, [0, spark.conf.get(CLEANUP, "false")])
        under_way[0] += 1
        spark.conf.set(CLEANUP, "true")
    try:
        df.write.parquet(path)
    finally:
        with _LOCK:
            under_way[0] -= 1
            if not under_way[0]:
                spark.conf.set(CLEANUP, _WRITES.pop(spark)[1])
    out = spark.read.schema(df.schema).parquet(path)
    _PATHS[out] = path
    return out


def forget(*frames: DataFrame) -> None:
    """Delete what stored() wrote for these, which nothing reads again."""
    for df in frames:
        if path := _PATHS.pop(df, None):
            where = df.sparkSession._jvm.org.apache.hadoop.fs.Path(path)
            where.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).delete(where, True)


#: What is broadcast at most: rows, and characters of what they hold.
BROADCAST, CHARS = 1 << 20, 1 << 26


def bounded(df: DataFrame, chars: Column | None = None) -> DataFrame:
    """df to be broadcast if its rows, which are counted, and the characters in them are few; else as it is, to be joined by shuffle."""
    if df.limit(BROADCAST + 1).count() > BROADCAST:
        return df
    small = chars is None or (df.agg(F.sum(chars)).first()[0] or 0) <= CHARS
    return F.broadcast(df) if small else df


def raw_text(name: str = "text") -> Column:
    """A text column as UTF-8 bytes; null is empty."""
    return F.coalesce(F.col(name).cast("string").cast("binary"), F.lit(b"")).alias("raw")


def sliced(batches: Iterator[pa.RecordBatch], rows: int = ROWS) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for at in range(0, batch.num_rows, rows):
            yield batch.slice(at, rows)
