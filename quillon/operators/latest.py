"""Latest-wins views of append-only facts, idempotent writes and snapshot differences."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def latest_row(df: DataFrame, key: Sequence[str], order: Sequence[str]) -> DataFrame:
    """The row with the largest order of each key: a partial aggregate, not a window, so hot keys are combined early."""
    whole = F.struct(*df.columns)
    return df.groupBy(*key).agg(F.max_by(whole, F.struct(*order)).alias("_row")).select("_row.*")


def latest_set(df: DataFrame, key: Sequence[str], order: Sequence[str]) -> DataFrame:
    """All rows of each key that have the largest order (a snapshot's rows, not one of them)."""
    newest = df.groupBy(*key).agg(F.max(F.struct(*order)).alias("_newest"))
    newest = newest.select(*(F.col(k).alias(f"_{k}") for k in key), *(F.col(f"_newest.{o}").alias(f"_new_{o}") for o in order))
    same = [F.col(k).eqNullSafe(F.col(f"_{k}")) for k in key] + [F.col(o).eqNullSafe(F.col(f"_new_{o}")) for o in order]
    return df.join(newest, reduce(lambda a, b: a & b, same)).select(df.columns)


def insert_missing(old: DataFrame, new: DataFrame, key: Sequence[str]) -> DataFrame:
    """old and those rows of new (one of each key) whose key old lacks."""
    return old.unionByName(new.dropDuplicates(list(key)).join(old, list(key), "left_anti"))


def upsert(old: DataFrame, new: DataFrame, key: Sequence[str]) -> DataFrame:
    """new's row where it has the key, else old's."""
    return old.join(new, list(key), "left_anti").unionByName(new)


def status_conflicts(old: DataFrame, new: DataFrame, key: Sequence[str], allowed: Sequence[tuple[str, str]]) -> DataFrame:
    """Rows of new (key, status) whose change from old's status is none of the allowed ones; staying is allowed."""
    had = old.select(*key, F.col("status").alias("_had"))
    step = F.struct(F.col("_had").alias("a"), F.col("status").alias("b"))
    fine = reduce(lambda p, q: p | q, (step == F.struct(F.lit(a).alias("a"), F.lit(b).alias("b")) for a, b in allowed), F.col("_had").eqNullSafe(F.col("status")))
    return new.join(had, list(key)).where(~fine).drop("_had")


def write_once_conflicts(old: DataFrame, new: DataFrame, key: Sequence[str], field: str) -> DataFrame:
    """Rows of new that would change a value already set."""
    had = old.select(*key, F.col(field).alias("_had")).where("_had is not null")
    return new.join(had, list(key)).where(~F.col(field).eqNullSafe(F.col("_had"))).drop("_had")


def snapshot_diff(old: DataFrame, new: DataFrame, key: Sequence[str], fields: Sequence[str]) -> DataFrame:
    """For each key: only_old, only_new, changed or same, and the names of changed fields."""
    a = old.select(*key, *(F.col(f).alias(f"_old_{f}") for f in fields), F.lit(True).alias("_in_old"))
    b = new.select(*key, *(F.col(f).alias(f"_new_{f}") for f in fields), F.lit(True).alias("_in_new"))
    both = a.join(b, list(key), "full_outer")
    changed = F.array_compact(F.array(*(F.when(~F.col(f"_old_{f}").eqNullSafe(F.col(f"_new_{f}")), F.lit(f)) for f in fields)))
    state = F.when(F.col("_in_new").isNull(), "only_old").when(F.col("_in_old").isNull(), "only_new").when(F.size(changed) > 0, "changed").otherwise("same")
    return both.select(*key, state.alias("state"), F.when(state == "changed", F.array_join(changed, ",")).otherwise("").alias("fields"))


def next_attempt(attempts: DataFrame, key: Sequence[str]) -> DataFrame:
    """For each key the next attempt number and the latest successful one."""
    return attempts.groupBy(*key).agg((F.max("attempt") + 1).alias("next_attempt"), F.max(F.when(F.col("status") == "SUCCESS", F.col("attempt"))).alias("reusable"))
