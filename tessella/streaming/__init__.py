"""Streams of events: windows with late data, de-duplication, and the same over what has arrived."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def windowed(events: DataFrame, late: str = "10 minutes", width: str = "1 hour") -> DataFrame:
    """event_type, start, n, value of each window; on a stream, windows close when the watermark has passed them."""
    rows = events.withColumn("ts", F.col("ts").cast("timestamp"))
    if rows.isStreaming:
        rows = rows.withWatermark("ts", late)
    by = rows.groupBy(F.window("ts", width).alias("w"), "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("value"))
    return by.select("event_type", F.col("w.start").alias("start"), "n", "value")


def first_seen(events: DataFrame, key: list[str], late: str = "10 minutes") -> DataFrame:
    """One row of each key; on a stream, of those within the watermark."""
    if events.isStreaming:
        return events.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late).dropDuplicatesWithinWatermark(key)
    return events.dropDuplicates(key)


def stream(spark: SparkSession, folder: str, schema: str) -> DataFrame:
    """New files of a folder, each once: an incremental read of an append-only log."""
    return spark.readStream.schema(schema).parquet(folder)


TERMINAL = "key string, state string, at timestamp, status string"


def terminal_states(events: DataFrame, key: str, state: str, at: str, final: list[str]) -> DataFrame:
    """key, state, at, status of each key's terminal events: the first is `accepted`, its repetitions `repeated`, another state
    after it `conflict`, since what is terminal doesn't change. What a key's state holds is one word, whatever the stream's length."""
    import pandas as pd
    from pyspark.sql.streaming.state import GroupStateTimeout

    rows = events.select(F.col(key).cast("string").alias("key"), F.col(state).alias("state"), F.col(at).cast("timestamp").alias("at")).where(F.col("state").isin(final))

    def run(name, batches, kept):
        held = kept.get[0] if kept.exists else None
        for batch in batches:
            batch = batch.sort_values(["at", "state"])
            said = []
            for s in batch["state"]:
                said.append("accepted" if held is None else "repeated" if s == held else "conflict")
                held = held or s
            yield pd.DataFrame({"key": batch["key"], "state": batch["state"], "at": batch["at"], "status": said})
        if held is not None:
            kept.update((held,))

    return rows.groupBy("key").applyInPandasWithState(run, TERMINAL, "held string", "append", GroupStateTimeout.NoTimeout)


def admission(events: DataFrame, failed: str = "error", width: str = "60 seconds", slide: str = "10 seconds", most: int = 3, late: str = "10 minutes") -> DataFrame:
    """start, completed, failures, admit of each sliding window: whether so few failed that new work may start."""
    rows = events.withColumn("ts", F.col("ts").cast("timestamp"))
    if rows.isStreaming:
        rows = rows.withWatermark("ts", late)
    by = rows.groupBy(F.window("ts", width, slide).alias("w")).agg(F.count("*").alias("completed"), F.count_if(F.col("event_type") == failed).alias("failures"))
    return by.select(F.col("w.start").alias("start"), "completed", "failures", (F.col("failures") < most).alias("admit"))


def resumed(events: DataFrame, done: DataFrame, key: list[str], fingerprint: str) -> DataFrame:
    """Events with reused: whether a finished attempt of the key had the same fingerprint, so that its result stands."""
    had = done.select(*key, fingerprint).distinct().withColumn("reused", F.lit(True))
    return events.join(had, [*key, fingerprint], "left").withColumn("reused", F.coalesce("reused", F.lit(False)))
