"""Histories of submissions and contributors, extraction states, and summaries of runs."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quillon.operators.resolve import tiered


def classify(df: DataFrame, classes: Sequence[tuple[str, Column]], otherwise: str, name: str = "class") -> DataFrame:
    """df with the first class whose condition holds."""
    out = reduce(lambda w, c: w.when(F.coalesce(c[1], F.lit(False)), c[0]), classes, F)
    return df.withColumn(name, out.otherwise(otherwise))


def contributor_rollup(submissions: DataFrame) -> DataFrame:
    """For each contributor: roles, versions, scores, first and last time. Columns: contributor, role, version_id,
    score, at."""
    return submissions.groupBy("contributor").agg(
        F.count_if(F.col("role") == "SUBMITTER").alias("submitted"),
        F.count_if(F.col("role") == "COAUTHOR").alias("coauthored"),
        F.count("version_id").alias("with_version"),
        F.count("score").alias("scored"),
        F.min("at").alias("first_at"),
        F.max("at").alias("last_at"),
    )


def first_of(df: DataFrame, by: Sequence[str], value: str, k: int) -> DataFrame:
    """by, first: the k smallest values of each group in order; no more than k rows of a group are ever held."""
    place = F.row_number().over(W.partitionBy(*by).orderBy(value))
    rows = df.withColumn("_place", place).where(F.col("_place") <= k)
    return rows.groupBy(*by).agg(F.transform(F.array_sort(F.collect_list(F.struct("_place", value))), lambda x: x[value]).alias("first"))


def differ_only_in(df: DataFrame, metrics: Sequence[str], aspect: str, key: str) -> DataFrame:
    """Groups of rows with equal metrics and several values of one aspect: metrics, members, values, first member."""
    groups = df.groupBy(*metrics).agg(F.count("*").alias("members"), F.count_distinct(aspect).alias("values"), F.min(key).alias("first_member"))
    return groups.where("values > 1")


def by_parameter(rows: DataFrame, parameter: str, change: str) -> DataFrame:
    """For each parameter value of transitions (a branch, a tool, its version): how many, how many fell and the mean change."""
    return rows.groupBy(parameter).agg(F.count("*").alias("n"), F.count_if(F.col(change) < 0).alias("fell"), F.avg(change).alias("mean_change"))


def overview(before: DataFrame, after: DataFrame, key: str, fields: Sequence[str]) -> DataFrame:
    """before's rows with after's fields of the same key beside them and the changes; null where after lacks the key."""
    later = after.select(F.col(key).alias("_key"), *(F.col(f).alias(f"{f}_after") for f in fields))
    rows = before.join(later, F.col(key) == F.col("_key"), "left").drop("_key")
    return rows.withColumnsRenamed({f: f"{f}_before" for f in fields}).withColumns({f"{f}_change": F.col(f"{f}_after") - F.col(f"{f}_before") for f in fields})


def merge_roles(parts: Sequence[DataFrame], key: Sequence[str]) -> DataFrame:
    """Union of tables (key, role): one row for each key with its distinct roles in order."""
    both = reduce(lambda a, b: a.unionByName(b), parts)
    return both.groupBy(*key).agg(F.array_join(F.array_sort(F.collect_set("role")), ",").alias("roles"))


def resolve_contributor(identities: DataFrame, reference: str) -> DataFrame:
    """Identities by the first rule that has any: id, handle, handle in any case, account, alias in any case.

    Columns: identity, handle, account, alias. Several rows are an ambiguity for the caller to report."""
    bare = reference.lstrip("@")
    rules = [F.col("identity") == reference, F.col("handle") == bare, F.lower("handle") == bare.lower(), F.col("account") == reference, F.lower("alias") == bare.lower()]
    return tiered(identities, rules).select("identity", "tier").distinct()


def mail_aliases(df: DataFrame, mail: str) -> DataFrame:
    """account number and login of private mail addresses <number>+<login>@users.noreply.<host>; only one-to-one pairs."""
    p = r"^(\d+)\+([A-Za-z0-9-]+)@users\.noreply\."
    found = df.where(F.col(mail).rlike(p)).select(F.regexp_extract(mail, p, 1).alias("account"), F.lower(F.regexp_extract(mail, p, 2)).alias("login")).distinct()
    a = found.groupBy("account").agg(F.count("*").alias("_n"), F.min("login").alias("login")).where("_n = 1")
    b = found.groupBy("login").agg(F.count("*").alias("_m")).where("_m = 1")
    return a.join(b, "login").select("account", "login")


def extraction_states(versions: DataFrame, done: DataFrame, failed: DataFrame, key: str, bytes_limit: int, operations_limit: int) -> DataFrame:
    """What a resumable extraction does with each version (key, bytes, operations): done, failed_before, too_large,
    too_long, no_artifact or todo."""
    rows = versions.join(done.select(key, F.lit(True).alias("_done")).distinct(), key, "left").join(failed.select(key, F.lit(True).alias("_failed")).distinct(), key, "left")
    rules = [("done", F.col("_done")), ("failed_before", F.col("_failed")), ("no_artifact", F.col("bytes").isNull()), ("too_large", F.col("bytes") > bytes_limit), ("too_long", F.col("operations") > operations_limit)]
    return classify(rows, rules, "todo", "state").drop("_done", "_failed")


def outcome_totals(df: DataFrame, state: str, states: Sequence[str]) -> DataFrame:
    """One row with the count of each state and of all rows."""
    return df.agg(*(F.count_if(F.col(state) == s).alias(s) for s in states), F.count("*").alias("total"))


def merge_facts(df: DataFrame, by: Sequence[str]) -> DataFrame:
    """Facts (by, name, value, source): equal values of a name are one row with all their sources."""
    return df.groupBy(*by, "name", "value").agg(F.array_join(F.array_sort(F.collect_set("source")), ",").alias("sources"))


def identical_metrics(df: DataFrame, metrics: Sequence[str], key: str, fingerprint: str) -> DataFrame:
    """Groups of rows with all metrics equal: size, distinct fingerprints and smallest member."""
    groups = df.groupBy(*metrics).agg(F.count("*").alias("members"), F.count_distinct(fingerprint).alias("fingerprints"), F.min(key).alias("first_member"))
    return groups.where("members > 1")


def summary(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """field, n, total, least, most: one pass over all fields."""
    sums = df.agg(*(f(c).alias(f"{n}_{c}") for c in columns for n, f in (("n", F.count), ("t", F.sum), ("l", F.min), ("m", F.max))))
    return sums.select(F.explode(F.array(*(F.struct(F.lit(c).alias("field"), F.col(f"n_{c}").alias("n"), F.col(f"t_{c}").cast("double").alias("total"), F.col(f"l_{c}").cast("double").alias("least"), F.col(f"m_{c}").cast("double").alias("most")) for c in columns))).alias("r")).select("r.*")


def trade_off(changes: Sequence[Column]) -> Column:
    """improved, worse, mixed, same or unknown for changes of several objectives (lower is better)."""
    low, high = F.least(*changes), F.greatest(*changes)
    unknown = reduce(lambda a, b: a | b, (c.isNull() for c in changes))
    return F.when(unknown, "unknown").when((low < 0) & (high > 0), "mixed").when(low < 0, "improved").when(high > 0, "worse").otherwise("same")


def best_so_far(df: DataFrame, by: Sequence[str], order: Sequence[str], value: str) -> DataFrame:
    """df with the least value up to each row, and whether the row sets a new one."""
    w = W.partitionBy(*by).orderBy(*order)
    before = F.min(value).over(w.rowsBetween(W.unboundedPreceding, -1))
    return df.withColumn("_before", before).withColumns({"best": F.least(F.col(value), F.col("_before")), "record": F.col("_before").isNull() | (F.col(value) < F.col("_before"))}).drop("_before")


def newest(df: DataFrame, at: str, key: str, limit: int) -> DataFrame:
    """The newest rows, nulls last: a top-k."""
    return df.orderBy(F.col(at).desc_nulls_last(), F.col(key)).limit(limit)


def lexicographic(df: DataFrame, objectives: Sequence[str], key: str, limit: int) -> DataFrame:
    """The first rows by several objectives in turn."""
    return df.orderBy(*(F.col(o).asc_nulls_last() for o in objectives), key).limit(limit)


def reproducible(facts: DataFrame, key: str, needed: Sequence[str]) -> DataFrame:
    """Keys that have every needed kind of fact (key, kind): an intersection by one aggregate."""
    have = facts.where(F.col("kind").isin(list(needed))).groupBy(key).agg(F.count_distinct("kind").alias("_n"))
    return have.where(F.col("_n") == len(needed)).select(key)


def better_and_later(df: DataFrame, reference: Column, at: str, objectives: Sequence[str]) -> DataFrame:
    """Rows later than the one reference row and better in every objective."""
    one = df.where(reference).limit(1).select(F.col(at).alias("_at"), *(F.col(o).alias(f"_{o}") for o in objectives))
    ok = reduce(lambda a, b: a & b, (F.col(o) < F.col(f"_{o}") for o in objectives), F.col(at) > F.col("_at"))
    return df.join(F.broadcast(one), ok).drop("_at", *(f"_{o}" for o in objectives))
