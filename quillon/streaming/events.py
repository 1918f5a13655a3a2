"""Event streams: windows with watermarks, duplicates, latest rows and a stateful sketch."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

LATE = "10 minutes"


def read(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """A file stream; ts becomes an instant so that watermarks apply."""
    rows = spark.readStream.schema(schema).parquet(path)
    return rows.withColumn("ts", F.col("ts").cast("timestamp"))


def tumbling(events: DataFrame, size: str = "1 hour", late: str = LATE) -> DataFrame:
    return _windows(events, F.window("ts", size), late)


def sliding(events: DataFrame, size: str = "1 hour", slide: str = "15 minutes", late: str = LATE) -> DataFrame:
    return _windows(events, F.window("ts", size, slide), late)


def _windows(events: DataFrame, window, late: str) -> DataFrame:
    """Counts and sums by window and type; on a batch the watermark means nothing."""
    rows = events.withWatermark("ts", late) if events.isStreaming else events
    found = rows.groupBy(window.alias("w"), "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("total"))
    return found.select(F.col("w.start").alias("start"), F.col("w.end").alias("end"), "event_type", "n", "total")


def sessions(events: DataFrame, gap: str = "30 minutes", late: str = LATE) -> DataFrame:
    rows = events.withWatermark("ts", late) if events.isStreaming else events
    found = rows.groupBy(F.session_window("ts", gap).alias("w"), "user_id").agg(F.count("*").alias("n"))
    return found.select(F.col("w.start").alias("start"), F.col("w.end").alias("end"), "user_id", "n")


def distinct(events: DataFrame, key: list[str], late: str = LATE) -> DataFrame:
    """The first of each key, within the watermark on a stream."""
    return events.withWatermark("ts", late).dropDuplicatesWithinWatermark(key) if events.isStreaming else events.dropDuplicates(key)


def latest_by_key(events: DataFrame, key: list[str], order: list[str]) -> DataFrame:
    """Latest row of each key; on a stream to be written in update or complete mode."""
    return events.groupBy(*key).agg(F.max_by(F.struct(*events.columns), F.struct(*order)).alias("r")).select("r.*")


def running_histogram(events: DataFrame) -> DataFrame:
    """Per user the counts of event types so far, kept as state: user_id, event_type, n after each batch."""

    def update(key, frames: Iterator[pd.DataFrame], state):
        counts = dict(zip(*state.get, strict=True)) if state.exists else {}
        for f in frames:
            for name, n in f["event_type"].value_counts().items():
                counts[name] = counts.get(name, 0) + int(n)
        names = sorted(counts)
        state.update((names, [counts[x] for x in names]))
        yield pd.DataFrame({"user_id": [key[0]] * len(names), "event_type": names, "n": [counts[x] for x in names]})

    return events.groupBy("user_id").applyInPandasWithState(update, "user_id long, event_type string, n long", "names array<string>, counts array<long>", "update", "NoTimeout")


def run_to_end(stream: DataFrame, name: str, mode: str = "complete") -> DataFrame:
    """Runs a stream over what is there and returns the memory table: for tests and small results."""
    query = stream.writeStream.outputMode(mode).format("memory").queryName(name).trigger(availableNow=True).start()
    query.awaitTermination()
    return stream.sparkSession.table(name)
