"""Evaluation statistics and distribution summaries."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def confusion(df: DataFrame, truth: str, guess: str, labels: Sequence) -> DataFrame:
    """Counts of every pair of labels, zeros included."""
    spark = df.sparkSession
    grid = spark.createDataFrame([(a, b) for a in labels for b in labels], f"truth {df.schema[truth].dataType.simpleString()}, guess {df.schema[guess].dataType.simpleString()}")
    n = df.groupBy(F.col(truth).alias("truth"), F.col(guess).alias("guess")).agg(F.count("*").alias("n"))
    return grid.join(n, ["truth", "guess"], "left").select("truth", "guess", F.coalesce("n", F.lit(0)).alias("n"))


def precision_recall(df: DataFrame, truth: str, guess: str, labels: Sequence) -> DataFrame:
    """label, precision, recall; null where nothing was guessed or true."""
    n = df.groupBy(F.col(truth).alias("t"), F.col(guess).alias("g")).agg(F.count("*").alias("n"))  # no more rows than pairs of labels
    rows = n.select(F.explode(F.array(*map(F.lit, labels))).alias("label"), "t", "g", "n").groupBy("label")
    count = lambda c: F.coalesce(F.sum(F.when(c, F.col("n"))), F.lit(0))
    t, g = F.col("t") == F.col("label"), F.col("g") == F.col("label")
    sums = rows.agg(count(t & g).alias("b"), count(t).alias("t"), count(g).alias("g"))
    return sums.select("label", F.try_divide("b", "g").alias("precision"), F.try_divide("b", "t").alias("recall"))


def nearest_rank(df: DataFrame, by: Sequence[str], value: str, share: float = 0.95) -> DataFrame:
    """median and the value at place round(share * (n - 1)), half to even, in sorted order."""
    ranked = df.where(F.col(value).isNotNull()).withColumn("_at", F.row_number().over(W.partitionBy(*by).orderBy(value)) - 1)
    n = df.groupBy(*by).agg(F.count(value).alias("_n"), F.median(value).alias("median"))
    place = F.bround(F.lit(share) * (F.col("_n") - 1)).cast("long")
    return ranked.join(n, list(by)).where(F.col("_at") == place).select(*by, "median", F.col(value).alias("p95"), F.col("_n").alias("n"))


def mass(df: DataFrame, weight: str, tops: Sequence[int] = (1, 10, 100)) -> DataFrame:
    """Share of all weight that the heaviest rows hold: a top-k each, never a full ranking in one task."""
    total = df.agg(F.sum(weight).alias("total"))
    out = None
    for k in tops:
        top = df.select(weight).orderBy(F.desc(weight)).limit(k).agg(F.sum(weight).alias("top"))
        row = top.crossJoin(F.broadcast(total)).select(F.lit(k).alias("k"), F.try_divide("top", "total").alias("share"))
        out = row if out is None else out.unionByName(row)
    return out


def percent_mass(df: DataFrame, weight: str, parts: Sequence[int] = (100, 10)) -> DataFrame:
    """part, share: what the heaviest 1/part of the rows (one at least) hold of all weight. Weights are whole numbers and are
    counted first: the one sorted task holds distinct weights, at most the square root of twice their sum."""
    kinds = df.groupBy(F.col(weight).alias("_w")).agg(F.count("*").alias("_n"))
    w = W.orderBy(F.desc("_w")).rowsBetween(W.unboundedPreceding, -1)
    rows = kinds.withColumn("_before", F.coalesce(F.sum("_n").over(w), F.lit(0)))
    facts = kinds.agg(F.sum("_n").alias("rows"), F.sum(F.col("_n") * F.col("_w")).alias("total"))
    tops = facts.select("total", F.explode(F.array(*(F.struct(F.lit(p).alias("part"), F.greatest(F.lit(1), F.floor(F.col("rows") / p)).alias("top")) for p in parts))).alias("t")).select("total", "t.*")
    taken = F.greatest(F.lit(0), F.least(F.col("_n"), F.col("top") - F.col("_before"))) * F.col("_w")
    return rows.crossJoin(F.broadcast(tops)).groupBy("part").agg((F.sum(taken) / F.max("total")).alias("share"))


def spread(df: DataFrame, by: Sequence[str], value: str) -> DataFrame:
    """by, n, least, median, most of the recorded values."""
    return df.groupBy(*by).agg(F.count(value).alias("n"), F.min(value).alias("least"), F.median(value).alias("median"), F.max(value).alias("most"))


def discovery_curve(df: DataFrame, item: str, order: str, budgets: Sequence[int]) -> DataFrame:
    """How many distinct items have appeared in the first `budget` places, and the share of all rows that have these
    items: first places and weights of items, then conditional sums."""
    first = df.groupBy(item).agg(F.min(order).alias("_first"), F.count("*").alias("_weight"))
    sums = [x for b in budgets for x in (F.count_if(F.col("_first") < b).alias(f"n{b}"), F.sum(F.when(F.col("_first") < b, F.col("_weight")).otherwise(0)).alias(f"w{b}"))]
    counts = first.agg(*sums, F.sum("_weight").alias("_all"))
    rows = (F.struct(F.lit(b).alias("budget"), F.col(f"n{b}").alias("distinct_items"), F.try_divide(F.col(f"w{b}").cast("double"), F.col("_all")).alias("weight_share")) for b in budgets)
    return counts.select(F.explode(F.array(*rows)).alias("r")).select("r.*")


def funnel(df: DataFrame, stages: Sequence[tuple[str, str]]) -> DataFrame:
    """Rows by the first stage (name, condition) that holds, in order; `other` for none."""
    stage = F
    for name, what in stages:
        stage = stage.when(F.expr(what), name)
    return df.groupBy(stage.otherwise("other").alias("stage")).agg(F.count("*").alias("n"))


def tag_breakdown(df: DataFrame, tags: str) -> DataFrame:
    """Counts of the tags of an array column, most frequent first."""
    return df.select(F.explode(tags).alias("tag")).groupBy("tag").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "tag")


def table_digest(df: DataFrame) -> DataFrame:
    """Row count and a digest that does not depend on the order of rows: the sum of 48 bits of each row's hash, so that no
    task needs all rows. A row is its columns as text, joined by |, with ~ for nulls."""
    text = F.concat_ws("|", *(F.coalesce(F.col(f"`{c}`").cast("string"), F.lit("~")) for c in df.columns))
    bits = F.conv(F.substring(F.sha2(text, 256), 1, 12), 16, 10).cast("decimal(38,0)")
    return df.agg(F.count("*").alias("rows"), F.coalesce(F.sum(bits).cast("string"), F.lit("0")).alias("digest"))
