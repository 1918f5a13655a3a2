"""Streams run to their end give what the batch gives."""

from pyspark.sql import functions as F

from quillon.streaming import events

SCHEMA = "event_id long, ts timestamp_ntz, user_id long, event_type string, value double, props string"


def test_stream_equals_batch(spark, tmp_path):
    batch = spark.read.parquet("/root/testdata/sf0.001/events.parquet")
    batch.select("event_id", batch.ts.cast("timestamp_ntz").alias("ts"), "user_id", "event_type", "value", "props").repartition(3).write.parquet(str(tmp_path / "in"))
    for name, f in {"tumbling": events.tumbling, "sliding": events.sliding}.items():
        got = events.run_to_end(f(events.read(spark, str(tmp_path / "in"), SCHEMA)), name)
        key = lambda r: (r.start, r.event_type, r.n)
        assert sorted(map(key, got.collect())) == sorted(map(key, f(batch.withColumn("ts", batch.ts.cast("timestamp"))).collect()))
    got = events.run_to_end(events.running_histogram(events.read(spark, str(tmp_path / "in"), SCHEMA)), "histogram", "update")
    want = {(r.user_id, r.event_type): r["count"] for r in batch.groupBy("user_id", "event_type").count().collect()}
    last = {}
    for r in got.collect():
        last[r.user_id, r.event_type] = max(r.n, last.get((r.user_id, r.event_type), 0))
    assert last == want


def test_sessions_duplicates_and_latest(spark, tmp_path):
    batch = spark.read.parquet("/root/testdata/sf0.001/events.parquet").withColumn("ts", F.col("ts").cast("timestamp_ntz"))
    batch.union(batch.limit(50)).select("event_id", "ts", "user_id", "event_type", "value", "props").coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = lambda: events.read(spark, str(tmp_path / "in"), SCHEMA)
    whole = spark.read.parquet(str(tmp_path / "in")).withColumn("ts", F.col("ts").cast("timestamp"))
    assert events.run_to_end(events.distinct(stream(), ["event_id"]), "once", "append").count() == batch.count() == events.distinct(whole, ["event_id"]).count()
    key = lambda r: (r.user_id, r.start, r.n)
    assert sorted(map(key, events.run_to_end(events.sessions(stream()), "sessions").collect())) == sorted(map(key, events.sessions(whole).collect()))
    got = events.run_to_end(events.latest_by_key(stream(), ["user_id"], ["ts", "event_id"]), "latest")
    assert {(r.user_id, r.event_id) for r in got.collect()} == {(r.user_id, r.event_id) for r in events.latest_by_key(whole, ["user_id"], ["ts", "event_id"]).collect()}
