"""Sequence analytics over ordered chains of versions."""

from __future__ import annotations

import heapq
from collections.abc import Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T


def chain(df: DataFrame, by: Sequence[str], order: Sequence[str], key: str) -> DataFrame:
    """Consecutive pairs: src, dst of each row and the next of its chain."""
    nxt = F.lead(key).over(W.partitionBy(*by).orderBy(*order))
    return df.select(*by, F.col(key).alias("src"), nxt.alias("dst")).where("dst is not null")


def steps(df: DataFrame, by: Sequence[str], order: Sequence[str], value: str) -> DataFrame:
    """df with previous, delta and pct of a value along its chain."""
    w = W.partitionBy(*by).orderBy(*order)
    prev = F.lag(value).over(w)
    df = df.withColumn("previous", prev)
    return df.withColumns({"delta": F.col(value) - F.col("previous"), "pct": F.when(F.col("previous") != 0, (F.col(value) - F.col("previous")) / F.col("previous") * 100)})


def extreme_steps(df: DataFrame, by: Sequence[str], order: Sequence[str], value: str, key: str) -> DataFrame:
    """For each chain its steps, and the key and change of its largest fall and of its largest rise (the first of equals)."""
    rows = steps(df, by, order, value).where("delta is not null")
    place = F.struct(*order)
    first = lambda sign: F.min_by(F.struct(F.col(key).alias("key"), "delta"), F.struct(sign * F.col("delta"), place))
    ends = rows.groupBy(*by).agg(F.count("*").alias("steps"), first(1).alias("_fall"), first(-1).alias("_rise"))
    return ends.select(*by, "steps", F.col("_fall.key").alias("fall_key"), F.col("_fall.delta").alias("fall"), F.col("_rise.key").alias("rise_key"), F.col("_rise.delta").alias("rise"))


def longest_run(df: DataFrame, by: Sequence[str], order: Sequence[str], goes_on: Column) -> DataFrame:
    """For each chain the longest run of steps where goes_on (over previous, delta) holds: its length and first step;
    a null breaks it and the first of equals wins."""
    w = W.partitionBy(*by).orderBy(*order)
    rows = df.withColumns({"_ok": F.coalesce(goes_on, F.lit(False)), "_at": F.row_number().over(w)})
    rows = rows.withColumn("_island", F.sum(F.when(F.col("_ok"), 0).otherwise(1)).over(w.rowsBetween(W.unboundedPreceding, 0)))
    runs = rows.where("_ok").groupBy(*by, "_island").agg(F.count("*").alias("_n"), F.min("_at").alias("_from"))
    best = runs.groupBy(*by).agg(F.max(F.struct(F.col("_n").alias("n"), (-F.col("_from")).alias("start"))).alias("_b"))
    return best.select(*by, F.col("_b.n").alias("length"), (-F.col("_b.start")).alias("start"))


def recovery(df: DataFrame, by: Sequence[str], order: Sequence[str], value: str, key: str) -> DataFrame:
    """For each rise of value: after how many rows it first falls below the level before the rise (null: never).

    Rows in order pass a heap of the rises that wait, the highest level first: a row settles those above it. A chain
    costs its length times the logarithm of the waiting rises, and no pairs are made.
    """
    w = W.partitionBy(*by).orderBy(*order)
    rows = df.where(F.col(value).isNotNull()).select(*by, key, F.col(value).cast("double").alias("_v"), F.row_number().over(w).alias("_at"), F.lag(value).over(w).cast("double").alias("_level"))
    kept = rows.select(*by, key).schema
    rows = rows.repartition(*by).sortWithinPartitions(*by, "_at")

    def run(batches):
        chain, waiting = None, []
        for batch in batches:
            names, out = [*by, key], []
            columns = [batch.column(c).to_pylist() for c in (*names, "_v", "_at", "_level")]
            for *own, v, at, level in zip(*columns, strict=True):
                if own[:-1] != chain:
                    out += [(*x, None) for _, _, x in waiting]
                    chain, waiting = own[:-1], []
                while waiting and -waiting[0][0] > v:
                    _, then, x = heapq.heappop(waiting)
                    out.append((*x, at - then))
                if level is not None and v > level:
                    heapq.heappush(waiting, (-level, at, tuple(own)))
            yield _table(names, out, batch)
        if chain is not None:
            yield _table([*by, key], [(*x, None) for _, _, x in waiting], batch)

    def _table(names, out, batch):
        columns = list(zip(*out, strict=True)) or [()] * (len(names) + 1)
        kinds = [batch.schema.field(c).type for c in names] + [pa.int64()]
        return pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(columns, kinds, strict=True)], names=[*names, "distance"])

    return rows.mapInArrow(run, T.StructType([*kept.fields, T.StructField("distance", T.LongType())]))


def cumulative_change(df: DataFrame, by: Sequence[str], order: Sequence[str], value: str) -> DataFrame:
    """First and last recorded value of each chain and their difference."""
    have = df.where(F.col(value).isNotNull())
    ends = have.groupBy(*by).agg(F.min_by(value, F.struct(*order)).alias("first_value"), F.max_by(value, F.struct(*order)).alias("last_value"), F.count("*").alias("covered"))
    return ends.withColumn("change", F.col("last_value") - F.col("first_value"))


def forward_fill(df: DataFrame, by: Sequence[str], order: Sequence[str], heading: Column, name: str = "heading") -> DataFrame:
    """The last heading at or before each row."""
    w = W.partitionBy(*by).orderBy(*order).rowsBetween(W.unboundedPreceding, 0)
    return df.withColumn(name, F.last(heading, ignorenulls=True).over(w))


def window_slice(df: DataFrame, by: Sequence[str], order: Sequence[str], start: int, end: int) -> DataFrame:
    """Rows start to end (from 1) of each chain, with their position."""
    at = F.row_number().over(W.partitionBy(*by).orderBy(*order))
    return df.withColumn("position", at).where(F.col("position").between(start, end))
