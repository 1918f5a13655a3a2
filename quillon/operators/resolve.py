"""Entity resolution and search by tiers."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def tiered(df: DataFrame, tiers: Sequence[Column]) -> DataFrame:
    """Rows of the first tier that has any, with that tier (from 1): a small aggregate joined back."""
    tier = F.coalesce(*(F.when(F.coalesce(c, F.lit(False)), F.lit(i + 1)) for i, c in enumerate(tiers)))
    rows = df.withColumn("tier", tier).where("tier is not null")
    return rows.join(F.broadcast(rows.agg(F.min("tier").alias("_first"))), F.col("tier") == F.col("_first")).drop("_first")


def resolve(df: DataFrame, reference: str, columns: Sequence[str]) -> DataFrame:
    """Exact match of a reference in the first of the columns that has one."""
    return tiered(df, [F.col(c).cast("string") == reference for c in columns])


def first(df: DataFrame, reference: str, columns: Sequence[str]) -> DataFrame:
    """At most one row, of those that resolve() finds the one with the smallest first column: one pass without a join."""
    tier = F.coalesce(*(F.when(F.col(c).cast("string") == reference, F.lit(i + 1)) for i, c in enumerate(columns)))
    return df.withColumn("_tier", tier).where("_tier is not null").orderBy("_tier", columns[0]).limit(1).drop("_tier")


def search(df: DataFrame, text: str, key: str, external: str, label: str, limit: int) -> DataFrame:
    """Ranked search: exact id, exact external key, exact label, part of the external key (3 characters or more), all but
    the id in any case; ties by external key, label and id; with the flag `truncated` on every row when more than limit
    rows match."""
    low = text.lower()
    same = lambda c: F.lower(F.col(c)) == low
    part = F.lit(len(text) >= 3) & F.contains(F.lower(F.col(external)), F.lit(low))
    tier = F.when(F.col(key).cast("string") == text, 1).when(same(external), 2).when(same(label), 3).when(part, 4)
    hits = df.withColumn("tier", tier).where("tier is not null")
    flag = hits.agg((F.count("*") > limit).alias("truncated"))
    return hits.orderBy("tier", F.coalesce(external, label, F.col(key).cast("string")), key).limit(limit).crossJoin(F.broadcast(flag))


def namespaces(references: DataFrame, spaces: dict[str, DataFrame], prefix: int = 4, hexadecimal: Sequence[str] | None = None, cue: str | None = None) -> DataFrame:
    """Resolves references (ref) against several namespaces (name, entity): exact names first, then name prefixes of
    at least `prefix` characters. RESOLVED if all hits are one entity, AMBIGUOUS if several, else UNKNOWN.

    With `hexadecimal` only these namespaces take prefixes, of hex digits with a letter among them; digits alone count as
    a prefix where the references' column `cue` says that an identifier is meant.

    Names are cut to the lengths of the references that share their first characters and meet these by equality; names
    that begin alike become one row with their least and greatest entity first, so no reference meets its names one by one.
    """
    may = F.length("ref") >= prefix
    if hexadecimal is not None:
        letter = F.col("ref").rlike("[a-f]") if cue is None else F.col("ref").rlike("[a-f]") | F.coalesce(F.col(cue), F.lit(False))
        may = may & F.col("ref").rlike("^[0-9a-f-]+$") & letter
    refs = references.groupBy("ref").agg(F.max(F.coalesce(may, F.lit(False))).alias("_may"))
    begun = refs.where("_may")
    lengths = begun.groupBy(F.substring("ref", 1, prefix).alias("_head")).agg(F.collect_set(F.length("ref")).alias("_lengths"))
    hits = None
    for name, df in spaces.items():
        known = df.select(F.col("name").cast("string").alias("ref"), F.col("entity").cast("string").alias("entity"))
        tiers = [(1, known, refs)]
        if hexadecimal is None or name in hexadecimal:
            heads = known.withColumn("_head", F.substring("ref", 1, prefix)).join(lengths, "_head")
            short = heads.select("ref", "entity", F.explode("_lengths").alias("_length")).where(F.col("_length") < F.length("ref"))
            tiers.append((2, short.select(F.expr("substring(ref, 1, _length)").alias("ref"), "entity"), begun))
        for tier, rows, wanted in tiers:
            ends = rows.groupBy("ref").agg(F.min("entity").alias("_least"), F.max("entity").alias("_most"))
            rows = ends.join(wanted.select("ref"), "ref", "left_semi").select("*", F.lit(tier).alias("tier"), F.lit(name).alias("space"))
            hits = rows if hits is None else hits.unionByName(rows)
    found = hits.groupBy("ref", "tier").agg(F.min("_least").alias("_least"), F.max("_most").alias("_most"), F.array_join(F.array_sort(F.collect_set("space")), ",").alias("spaces"))
    found = found.groupBy("ref").agg(F.min_by(F.struct("tier", "_least", "_most", "spaces"), "tier").alias("_first")).select("ref", "_first.*")
    out = refs.select("ref").join(found, "ref", "left")
    status = F.when(F.col("_least") == F.col("_most"), "RESOLVED").when(F.col("_least") < F.col("_most"), "AMBIGUOUS").otherwise("UNKNOWN")
    return out.select("ref", status.alias("status"), F.when(status == "RESOLVED", F.col("_least")).alias("entity"), F.coalesce("tier", F.lit(0)).alias("tier"), F.coalesce("spaces", F.lit("")).alias("spaces"))


def prefix_join(short: DataFrame, long: DataFrame, length: int) -> DataFrame:
    """Prefixes (prefix) joined to full names (name) that begin with them; only prefixes with exactly one name stay."""
    heads = long.select(F.substring("name", 1, length).alias("prefix"), "name")
    one = heads.groupBy("prefix").agg(F.count("*").alias("_n"), F.min("name").alias("name")).where("_n = 1").drop("_n")
    return short.join(one, "prefix")


def one_to_one_conflicts(df: DataFrame, a: str, b: str) -> DataFrame:
    """Values of a with several b."""
    return df.groupBy(a).agg(F.count_distinct(b).alias("values")).where("values > 1")
