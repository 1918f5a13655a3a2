"""Record primitives: projection, filters, sort, limit, grouping, metric maps and extremes with ties."""

from __future__ import annotations

import math
from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Comparators and aggregates of plans.
COMPARATORS = {
    "<": lambda a, b: a < b,
    "<=": lambda a, b: a <= b,
    ">": lambda a, b: a > b,
    ">=": lambda a, b: a >= b,
    "==": lambda a, b: a == b,
    "!=": lambda a, b: a != b,
}
AGGREGATES = ("sum", "mean", "count", "min", "max")


class PlanError(ValueError):
    """A plan that cannot be run as written (status INVALID_PLAN)."""


def field(name: str) -> Column:
    """A column by its name, which may hold dots."""
    return F.col("`" + name.replace("`", "``") + "`")


def is_numeric(kind: T.DataType) -> bool:
    """Booleans are not numbers."""
    return isinstance(kind, T.NumericType)


def condition(df: DataFrame, metric: str, operator: str, value) -> Column:
    """One comparison; types must agree, nothing is coerced."""
    if operator not in COMPARATORS:
        raise PlanError(f"unknown comparator {operator!r}")
    number = isinstance(value, (int, float)) and not isinstance(value, bool)
    if number and not math.isfinite(value):
        raise PlanError("a bound must be finite")
    if metric not in df.columns:  # no row has it, so no row can meet it
        return F.lit(False)
    kind = df.schema[metric].dataType
    if operator not in ("==", "!=") and number != is_numeric(kind):
        raise PlanError(f"{metric} and {value!r} have no order")
    if number != is_numeric(kind):  # values of two kinds are never equal
        return field(metric).isNotNull() & F.lit(operator == "!=")
    return COMPARATORS[operator](field(metric), F.lit(value))


def filter_rows(df: DataFrame, conditions: Sequence[tuple]) -> DataFrame:
    """Rows that meet all conditions; a null meets none."""
    return df.where(reduce(lambda a, b: a & b, (condition(df, *c) for c in conditions), F.lit(True)))


def filter_versions(df: DataFrame, conditions: Sequence[tuple]) -> tuple[DataFrame, DataFrame]:
    """filter_rows, and one row with how many of all rows lack a metric of the conditions."""
    lacks = reduce(lambda a, b: a | b, (field(c[0]).isNull() if c[0] in df.columns else F.lit(True) for c in conditions), F.lit(False))
    return filter_rows(df, conditions), df.agg(F.count_if(lacks).alias("missing"), F.count("*").alias("total"))


def sort_rows(df: DataFrame, by: str, order: str = "asc", tie: str = "version_id") -> DataFrame:
    """Nulls last either way; ties by the tie column as text, ascending either way. A column that no row has sorts nothing."""
    if order not in ("asc", "desc"):
        raise PlanError(f"unknown order {order!r}")
    keys = []
    if by in df.columns:
        keys.append(field(by).asc_nulls_last() if order == "asc" else field(by).desc_nulls_last())
    if tie in df.columns:
        keys.append(field(tie).cast("string").asc())
    return df.orderBy(*keys) if keys else df


def limit_rows(df: DataFrame, k: int) -> DataFrame:
    if isinstance(k, bool) or not isinstance(k, int) or k < 0:
        raise PlanError("limit takes a whole number of 0 or more")
    return df.limit(k)


def group_by(df: DataFrame, key: str, agg: str = "count", metric: str | None = None) -> DataFrame:
    """group, count and, for another aggregate than count, a column of its name. key may end in :year or :year_month; a
    null key, or one that no row has, is a group of its own."""
    if agg not in AGGREGATES:
        raise PlanError(f"unknown aggregate {agg!r}")
    if agg != "count" and not metric:
        raise PlanError(f"{agg} needs a metric")
    name, _, suffix = key.partition(":")
    lengths = {"": 0, "year": 4, "year_month": 7}
    if suffix not in lengths:
        raise PlanError(f"unknown part {suffix!r} of a key")
    column = field(name) if name in df.columns else F.lit(None).cast("string")
    if suffix and name in df.columns:
        text = F.date_format(column, "yyyy-MM-dd") if isinstance(df.schema[name].dataType, (T.TimestampType, T.TimestampNTZType, T.DateType)) else column.cast("string")
        column = F.substring(text, 1, lengths[suffix])
    values = [F.count("*").alias("count")]
    if agg != "count":
        known = field(metric) if metric in df.columns else F.lit(None).cast("double")
        values.append(getattr(F, "avg" if agg == "mean" else agg)(known).alias(agg))
    return df.groupBy(column.alias("group")).agg(*values)


def unified_metrics(structural: DataFrame, benchmark: DataFrame, version: str = "version_id") -> DataFrame:
    """Long metrics (version, name, value): the benchmark's value stands before a structural one of the same name."""
    both = structural.withColumn("_tier", F.lit(1)).unionByName(benchmark.withColumn("_tier", F.lit(0)))
    return both.groupBy(version, "name").agg(F.min_by("value", "_tier").alias("value"))


def wide_metrics(long: DataFrame, names: Sequence[str], version: str = "version_id") -> DataFrame:
    """Pivot of long metrics; a metric that was not recorded is null."""
    return long.groupBy(version).pivot("name", list(names)).agg(F.max("value"))


# Identity fields of a version record.
VERSION_FIELDS = ("version_id", "logical_circuit_id", "external_version_key", "version_label", "sequence_no", "historical_time", "record_status")


def list_versions(versions: DataFrame, metrics: DataFrame, record_status: str | None = None, version: str = "version_id") -> DataFrame:
    """Identity fields and all metrics."""
    if record_status is not None:
        versions = versions.where(F.col("record_status") == record_status)
    return versions.join(metrics, version, "left")


def version_order() -> list[Column]:
    """The order of version scans: by sequence number, those without one last; then by time, those without one first; then by id."""
    return [F.col("sequence_no").asc_nulls_last(), F.col("historical_time").asc_nulls_first(), F.col("version_id").cast("string")]


def best_with_ties(df: DataFrame, metric: str, lowest: bool = True, by: Sequence[str] = ()) -> DataFrame:
    """All rows that have the extreme of a metric: an aggregate joined back, so no group is gathered."""
    best = (F.min if lowest else F.max)(metric).alias("_best")
    if not by:
        return df.join(F.broadcast(df.agg(best)), F.col(metric) == F.col("_best")).drop("_best")
    extremes = df.groupBy(*by).agg(best).withColumnsRenamed({c: f"_{c}" for c in by})
    same = reduce(lambda a, b: a & b, (F.col(c).eqNullSafe(F.col(f"_{c}")) for c in by))
    return df.join(extremes, same & (F.col(metric) == F.col("_best"))).drop("_best", *(f"_{c}" for c in by))


def common_optimum(df: DataFrame, metrics: Sequence[str], by: Sequence[str]) -> DataFrame:
    """For each group, how many rows are best in every metric, and whether the objectives conflict."""
    best = df.groupBy(*by).agg(*(F.min(m).alias(f"_{m}") for m in metrics))
    rows = df.join(best, list(by)).select(*by, reduce(lambda a, b: a & b, (F.col(m) == F.col(f"_{m}") for m in metrics)).alias("_all"))
    return rows.groupBy(*by).agg(F.count_if("_all").alias("common"), (F.count_if("_all") == 0).alias("conflict"))


def coverage(df: DataFrame, metrics: Sequence[str]) -> DataFrame:
    """For each metric the rows that have it and the rows that lack it, in one pass."""
    counts = df.agg(*(F.count(m).alias(m) for m in metrics), F.count("*").alias("_n"))
    return counts.select(F.explode(F.array(*(F.struct(F.lit(m).alias("metric"), F.col(m).alias("with_metric"), (F.col("_n") - F.col(m)).alias("missing")) for m in metrics))).alias("r")).select("r.*")


def even_spread(df: DataFrame, count: int, order: Sequence, keep: Sequence[str]) -> DataFrame:
    """count rows at even distances of the sorted table, first and last among them: ranks by range partitions."""
    ranked = ranks(df, order, keep)
    n = F.lit(count)
    total = ranked.agg(F.count("*").alias("_n"))
    wanted = total.select("_n", F.explode(F.sequence(F.lit(0), n - 1)).alias("_i")).select(F.round(F.col("_i") * (F.col("_n") - 1) / F.greatest(n - 1, F.lit(1))).cast("long").alias("rank")).distinct()
    return ranked.join(F.broadcast(wanted), "rank")


def ranks(df: DataFrame, order: Sequence, keep: Sequence[str]) -> DataFrame:
    """Rows with their place from 0 in a total order, without gathering them in one task.

    The rows are range-partitioned and written; the partitions' sizes are prefix-summed and added to the places
    within each partition.
    """
    from quillon.session import cut

    n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = df.select(*keep).repartitionByRange(n, *order).sortWithinPartitions(*order)
    rows = cut(rows.select(*keep, F.spark_partition_id().alias("_part"), F.monotonically_increasing_id().alias("_at")))
    sizes = rows.groupBy("_part").agg(F.count("*").alias("_size"), F.min("_at").alias("_first"))
    before = sizes.select("_part", "_first", (F.sum("_size").over(W.orderBy("_part")) - F.col("_size")).alias("_before"))
    return rows.join(F.broadcast(before), "_part").select(*keep, (F.col("_before") + F.col("_at") - F.col("_first")).alias("rank"))
