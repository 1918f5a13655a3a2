"""Transitions along edges: metric changes, deltas, rankings and comparisons."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def percent(before, after):
    """Relative change in percent of the earlier value; null if that is 0."""
    return F.when(before != 0, (after - before) / before * 100)


# The relation that plans follow by default, and orders of rankings.
SUCCESSOR = "historical_successor"
ORDERS = ("largest_decrease", "largest_increase", "largest_absolute_change")
ENDPOINT_FIELDS = {"version_id": "version_id", "label": "version_label", "external_key": "external_version_key", "historical_time": "historical_time"}


def list_transitions(edges: DataFrame, versions: DataFrame, relation: str = SUCCESSOR, metrics: DataFrame | None = None, metric: str | None = None) -> DataFrame:
    """Edges (src, dst, relation, perhaps edge_id) of one relation between versions, with the identity of parent and
    child; with a metric only those of which both ends have it, before and after and the changes."""
    if "edge_id" not in edges.columns:
        edges = edges.withColumn("edge_id", F.substring(F.sha2(F.to_json(F.array(F.col("src").cast("string"), F.col("dst").cast("string"), F.col("relation"))), 256), 1, 32))
    out = edges.where(F.col("relation") == relation).select("edge_id", F.col("relation").alias("relation_type"), F.col("src").alias("parent_version_id"), F.col("dst").alias("child_version_id"))
    for end in ("parent", "child"):
        out = out.join(versions.select(*(F.col(c).alias(f"{end}_{name}") for name, c in ENDPOINT_FIELDS.items())), f"{end}_version_id")
    if metric is not None:
        have = metrics.select("version_id", F.col(f"`{metric}`").alias("value")).where("value is not null")
        out = out.withColumn("metric", F.lit(metric))
        for end, name in (("parent", "metric_before"), ("child", "metric_after")):
            out = out.join(have.select(F.col("version_id").alias(f"{end}_version_id"), F.col("value").alias(name)), f"{end}_version_id")
        out = out.withColumns({"absolute_change": F.col("metric_after") - F.col("metric_before"), "percentage_change": percent(F.col("metric_before"), F.col("metric_after"))})
    ends = [f"{end}_{name}" for end in ("parent", "child") for name in ENDPOINT_FIELDS]
    return out.select("edge_id", "relation_type", *ends, *(c for c in out.columns if c not in ("edge_id", "relation_type", *ends)))


def compute_delta(df: DataFrame, metrics: DataFrame, metric: str, before_field: str = "parent_version_id", after_field: str = "child_version_id", version: str = "version_id") -> DataFrame:
    """df with <metric>_before, _after, _delta and _pct_change; null where an end lacks the metric."""
    have = metrics.select(F.col(version).alias("_version"), (F.col(f"`{metric}`") if metric in metrics.columns else F.lit(None).cast("double")).alias("_value"))
    a, b = f"{metric}_before", f"{metric}_after"
    for end, name in ((before_field, a), (after_field, b)):
        df = df.join(have.withColumnsRenamed({"_version": "_end", "_value": name}), F.col(end) == F.col("_end"), "left").drop("_end")
    a, b = F.col(f"`{a}`"), F.col(f"`{b}`")
    return df.withColumns({f"{metric}_delta": b - a, f"{metric}_pct_change": percent(a, b)})


def rank_transitions(rows: DataFrame, order: str = "largest_decrease", limit: int = 10) -> DataFrame:
    """The first transitions (with a metric) by change or by size of change, ties by parent; no sign is filtered."""
    change = F.col("absolute_change")
    key = dict(zip(ORDERS, (change, -change, -F.abs(change)), strict=True))[order]
    return rows.orderBy(key, F.col("parent_version_id").cast("string"), F.col("child_version_id").cast("string")).limit(limit)


def improvements(rows: DataFrame, better: dict[str, str]) -> DataFrame:
    """rows of transitions (metric, absolute_change) with improved: whether the metric moved to its better side (lower or
    higher); null for a metric whose better side is not given: it is never guessed."""
    falls = F.col("absolute_change") < 0
    rises = F.col("absolute_change") > 0
    side = F.create_map(*(F.lit(x) for pair in better.items() for x in pair)) if better else F.create_map().cast("map<string,string>")
    return rows.withColumn("improved", F.when(side[F.col("metric")] == "lower", falls).when(side[F.col("metric")] == "higher", rises))


def compare_versions(long: DataFrame, a, b, names: Sequence[str] | None = None, version: str = "version_id") -> DataFrame:
    """Full outer comparison of two versions' metrics (version, name, value)."""
    if names is not None:
        long = long.where(F.col("name").isin(list(names)))
    left = long.where(F.col(version) == a).select("name", F.col("value").alias("value_a"))
    right = long.where(F.col(version) == b).select("name", F.col("value").alias("value_b"))
    out = left.join(right, "name", "full_outer")
    return out.withColumns({"delta": F.col("value_b") - F.col("value_a"), "pct_change": percent(F.col("value_a"), F.col("value_b"))})


def shared_metrics(long: DataFrame, a, b, version: str = "version_id") -> DataFrame:
    """Metrics (version, name, value, unit) of both versions; the unit stays only where it is the same."""
    left = long.where(F.col(version) == a).select("name", F.col("value").alias("value_a"), F.col("unit").alias("_unit_a"))
    right = long.where(F.col(version) == b).select("name", F.col("value").alias("value_b"), F.col("unit").alias("_unit_b"))
    out = left.join(right, "name").withColumn("unit", F.when(F.col("_unit_a") == F.col("_unit_b"), F.col("_unit_a")))
    return out.drop("_unit_a", "_unit_b")


def endpoints(edges: DataFrame, versions: DataFrame, fields: Sequence[str], version: str = "version_id") -> DataFrame:
    """Edges joined to both endpoint records: src_<field> and dst_<field>."""
    for end in ("src", "dst"):
        edges = edges.join(versions.select(F.col(version).alias(end), *(F.col(f).alias(f"{end}_{f}") for f in fields)), end)
    return edges
