"""Record validation: issue lists, duplicates and constraint counts."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

UUID = "^[0-9a-f]{8}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{12}$"
SHA = "^[0-9a-f]{40}$"
ISO_Z = r"^\d{4}-\d{2}-\d{2}T\d{2}:\d{2}:\d{2}(\.\d+)?Z$"


# Statuses of an official evaluation, its metrics, and the codes of what a record can get wrong.
STATUSES, PROMOTIONS = ("accepted", "rejected", "failed", "cancelled"), ("promoted", "failed")
METRICS = ("qubits", "toffoli")
CODES = ("not_an_object", "bad_submission_uuid", "benchmark_mismatch", "unknown_platform_status", "unknown_promotion_status", "bad_official_metrics", "unexpected_metric_keys", "partial_metric_triple", "bad_metric_value", "score_mismatch", "bad_timestamp", "bad_commit_sha", "duplicate_submission_uuid")


class JsonFields:
    """Typed access to the fields of a column of JSON text by path: types are those of the text."""

    def __init__(self, raw: str):
        self.whole = F.try_parse_json(raw)
        self.is_object = F.coalesce(F.startswith(F.schema_of_variant(self.whole), F.lit("OBJECT")), F.lit(False))

    def part(self, path: str, kind: str = "variant") -> Column:
        return F.try_variant_get(self.whole, path, kind)

    def kind(self, path: str) -> Column:
        return F.coalesce(F.schema_of_variant(self.part(path)), F.lit("VOID"))

    def here(self, path: str) -> Column:
        return self.kind(path) != "VOID"

    def text(self, path: str) -> Column:
        return F.when(self.kind(path) == "STRING", self.part(path, "string"))

    def matches(self, path: str, pattern: str) -> Column:
        return F.coalesce(self.text(path).rlike(pattern), F.lit(False))


def _records_issues(records: DataFrame, fields: JsonFields, rules: dict[str, Column]) -> DataFrame:
    """Issues of JSON records: not_an_object, those of the rules, and duplicate_submission_uuid for every row of an id that
    occurs twice."""
    own = [(code, fields.is_object & bad) for code, bad in rules.items()]
    rows = with_issues(records, [("not_an_object", ~fields.is_object), *own]).withColumn("_id", F.when(fields.is_object, fields.text("$.id")))
    twice = rows.where("_id is not null").groupBy("_id").agg(F.count("*").alias("_n")).where("_n > 1")
    rows = rows.join(twice, "_id", "left")
    return rows.withColumn("issues", F.when(F.col("_n").isNotNull(), F.array_append("issues", F.lit("duplicate_submission_uuid"))).otherwise(F.col("issues"))).drop("_id", "_n")


# An account's handle, and what a contributor record can get wrong besides.
HANDLE = "^[A-Za-z0-9]([A-Za-z0-9-]*[A-Za-z0-9])?$"
CONTRIBUTOR_CODES = ("missing_solver_account_id", "bad_solver_username", "bad_coauthors")


def contributor_issues(records: DataFrame) -> DataFrame:
    """records (raw: one JSON record each) with the codes of what is wrong with their contributor fields."""
    x = JsonFields("raw")
    names = x.kind("$.coauthors")
    empty = F.coalesce(F.size(x.part("$.coauthors", "array<string>")) == 0, F.lit(False))
    listed = (names == "VOID") | (names == "ARRAY<STRING>") | ((names == "ARRAY<VOID>") & empty)
    wrong = (~F.coalesce(F.trim(x.text("$.solverAccountId")) != "", F.lit(False)), ~x.matches("$.solverUsername", HANDLE), ~listed)
    return _records_issues(records, x, {"bad_submission_uuid": ~x.matches("$.id", UUID)} | dict(zip(CONTRIBUTOR_CODES, wrong, strict=True)))


def evaluation_issues(records: DataFrame, benchmark: str | None = None) -> DataFrame:
    """records (raw: one JSON record each) with the codes of what is wrong with them; every occurrence of an id that
    occurs twice is wrong. Types are those of the JSON text: a number in quotes is no number."""
    x = JsonFields("raw")
    part, kind, text, here, matches = x.part, x.kind, x.text, x.here, x.matches
    among = lambda path, values: F.coalesce(text(path).isin(*values), F.lit(False))
    time_ok = lambda path: F.coalesce(F.try_to_timestamp(text(path)).isNotNull(), F.lit(False))
    triple = [f"$.officialMetrics.{m}" for m in METRICS] + ["$.officialScore"]
    any_of, all_of = reduce(lambda a, b: a | b, map(here, triple)), reduce(lambda a, b: a & b, map(here, triple))
    number = [part(path, "decimal(38,0)") for path in triple]
    whole = reduce(lambda a, b: a & b, (kind(path).rlike(r"^(BIGINT|DECIMAL\(\d+,0\))$") & (n >= 0) for path, n in zip(triple, number, strict=True)))
    metrics_object = F.startswith(kind("$.officialMetrics"), F.lit("OBJECT"))
    keys = F.json_object_keys(F.to_json(part("$.officialMetrics")))
    rules = {
        "bad_submission_uuid": ~matches("$.id", UUID),
        "benchmark_mismatch": ~F.coalesce(text("$.benchmarkId") == F.lit(benchmark), F.lit(False)) if benchmark else F.lit(False),
        "unknown_platform_status": ~among("$.status", STATUSES),
        "unknown_promotion_status": here("$.promotionStatus") & ~among("$.promotionStatus", PROMOTIONS),
        "bad_official_metrics": here("$.officialMetrics") & ~metrics_object,
        "unexpected_metric_keys": metrics_object & (F.size(F.array_except(keys, F.array(*map(F.lit, METRICS)))) > 0),
        "partial_metric_triple": any_of & ~all_of,
        "bad_metric_value": all_of & ~F.coalesce(whole, F.lit(False)),
        "score_mismatch": all_of & F.coalesce(whole & (number[0].cast("decimal(19,0)") * number[1].cast("decimal(19,0)") != number[2]), F.lit(False)),
        "bad_timestamp": ~time_ok("$.createdAt") | ~time_ok("$.updatedAt") | (here("$.promotionFinishedAt") & ~time_ok("$.promotionFinishedAt")),
        "bad_commit_sha": reduce(lambda a, b: a | b, (here(f"$.{c}") & ~matches(f"$.{c}", SHA) for c in ("submissionCommitSha", "promotedSourceRef"))),
    }
    return _records_issues(records, x, rules)


def identical_once(df: DataFrame, key: Sequence[str], order: str) -> tuple[DataFrame, DataFrame]:
    """The first row of each key whose rows are all the same but for their order, and every row of the other keys."""
    facts = F.xxhash64(*(c for c in df.columns if c != order))
    groups = df.groupBy(*key).agg(F.min(order).alias("_first"), F.min(facts).alias("_low"), F.max(facts).alias("_high"))
    rows = df.join(groups, list(key))
    same = F.col("_low") == F.col("_high")
    return rows.where(same & (F.col(order) == F.col("_first"))).select(df.columns), rows.where(~same).select(df.columns)


def with_issues(df: DataFrame, rules: Sequence[tuple[str, Column]], name: str = "issues") -> DataFrame:
    """df with an array of the names of the rules that a row breaks, in order; an unknown outcome breaks nothing."""
    return df.withColumn(name, F.array_compact(F.array(*(F.when(F.coalesce(bad, F.lit(False)), F.lit(code)) for code, bad in rules))))


def duplicate_keys(df: DataFrame, key: Sequence[str]) -> DataFrame:
    """Every occurrence of a key that occurs more than once, found by counts and a semi-join."""
    several = df.groupBy(*key).agg(F.count("*").alias("_n")).where("_n > 1").drop("_n")
    return df.join(several, list(key), "left_semi")


def split_valid(df: DataFrame, name: str = "issues") -> tuple[DataFrame, DataFrame]:
    """Valid rows, and the quarantine."""
    return df.where(F.size(name) == 0).drop(name), df.where(F.size(name) > 0)


def issue_counts(df: DataFrame, name: str = "issues") -> DataFrame:
    return df.select(F.explode(name).alias("issue")).groupBy("issue").agg(F.count("*").alias("n"))


def violations(df: DataFrame, checks: Sequence[tuple[str, Column]]) -> DataFrame:
    """How many rows break each check, in one pass: check, violations."""
    counts = df.agg(*(F.count_if(~F.coalesce(ok, F.lit(True))).alias(name) for name, ok in checks))
    return counts.select(F.explode(F.array(*(F.struct(F.lit(n).alias("check"), F.col(n).alias("violations")) for n, _ in checks))).alias("r")).select("r.*")


def score_mismatch(score: Column, a: Column, b: Column) -> Column:
    """score differs from a * b, in exact wide integers."""
    wide = lambda c: c.cast("decimal(19,0)")
    return score.isNotNull() & a.isNotNull() & b.isNotNull() & (score.cast("decimal(38,0)") != wide(a) * wide(b))


def presence(raw: Column, key: str) -> Column:
    """absent, null, empty or value of a top-level key of raw JSON text."""
    value = F.get_json_object(raw, f"$.{key}")
    has = F.array_contains(F.json_object_keys(raw), key)
    return F.when(~F.coalesce(has, F.lit(False)), "absent").when(value.isNull(), "null").when(value == "", "empty").otherwise("value")
