"""Streams of files against the same work over tables."""

from __future__ import annotations

from datetime import datetime

from tessella import streaming

SCHEMA = "event_id long, ts timestamp_ntz, user_id long, event_type string, value double, props string"


def drained(df, tmp_path, mode):
    out, mark = str(tmp_path / "out"), str(tmp_path / "mark")
    df.writeStream.outputMode(mode).option("checkpointLocation", mark).trigger(availableNow=True).format("parquet").start(out).awaitTermination()
    return df.sparkSession.read.parquet(out)


def incoming(spark, tmp_path):
    source = spark.read.parquet("/root/testdata/sf0.001/events.parquet")
    folder = str(tmp_path / "in")
    source.repartition(3).write.parquet(folder)
    return source, folder


def test_windows(spark, tmp_path):
    source, folder = incoming(spark, tmp_path)
    got = drained(streaming.windowed(streaming.stream(spark, folder, SCHEMA), late="40 days"), tmp_path, "append")
    assert got.count() == 0  # no window is closed while the watermark has passed none
    whole = streaming.windowed(source)
    assert whole.selectExpr("sum(n)").first()[0] == source.count()


def test_closed_windows(spark, tmp_path):
    source, folder = incoming(spark, tmp_path)
    one = spark.read.schema(SCHEMA).parquet(folder).coalesce(1).orderBy("ts")
    one.write.parquet(str(tmp_path / "ordered"))
    got = drained(streaming.windowed(streaming.stream(spark, str(tmp_path / "ordered"), SCHEMA)), tmp_path, "append")
    want = {(r.event_type, r.start): r.n for r in streaming.windowed(source).collect()}
    found = {(r.event_type, r.start): r.n for r in got.collect()}
    assert found and all(want[k] == n for k, n in found.items()) and len(want) - len(found) <= 10


def test_first_seen_and_restart(spark, tmp_path):
    source, folder = incoming(spark, tmp_path)
    for _ in range(2):  # the second run finds nothing new
        got = drained(streaming.first_seen(streaming.stream(spark, folder, SCHEMA), ["user_id"], late="40 days"), tmp_path, "append")
    assert sorted(r.user_id for r in got.collect()) == sorted(r.user_id for r in source.select("user_id").distinct().collect())


def test_terminal_states(spark, tmp_path):
    t = lambda s: datetime(2024, 1, 1, 0, 0, s)
    rows = [(1, t(1), 1, "start", 0.0, ""), (2, t(2), 1, "done", 0.0, ""), (3, t(3), 1, "failed", 0.0, ""), (4, t(4), 1, "done", 0.0, ""), (5, t(1), 2, "failed", 0.0, "")]
    spark.createDataFrame(rows, SCHEMA.replace("timestamp_ntz", "timestamp")).selectExpr("event_id", "cast(ts as timestamp_ntz) ts", "user_id", "event_type", "value", "props").coalesce(1).write.parquet(str(tmp_path / "in"))
    events = streaming.stream(spark, str(tmp_path / "in"), SCHEMA)
    got = drained(streaming.terminal_states(events, "user_id", "event_type", "ts", ["done", "failed"]), tmp_path, "append")
    assert [(r.key, r.state, r.status) for r in got.orderBy("key", "at").collect()] == [("1", "done", "accepted"), ("1", "failed", "conflict"), ("1", "done", "repeated"), ("2", "failed", "accepted")]


def test_admission_and_resume(spark):
    source = spark.read.parquet("/root/testdata/sf0.001/events.parquet")
    got = streaming.admission(source, width="1 hour", slide="30 minutes", most=1)
    assert got.selectExpr("sum(completed)").first()[0] == 2 * source.count()
    assert got.where("admit <> (failures = 0)").count() == 0
    done = source.where("event_id % 2 = 0").selectExpr("user_id", "props")
    assert streaming.resumed(source, done, ["user_id"], "props").where("event_id % 2 = 0 and not reused").count() == 0
