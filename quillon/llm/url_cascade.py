"""URL verdicts from a Bloom filter cascade, with DataFrame functions only.

The listed keys are a table of hosts. The key universe is every
distinct host of the corpus. Level 1 encodes the listed hosts of the universe, level 2 those others that level 1
wrongly has, level 3 the listed ones that level 2 wrongly has, and so on until a level is wrong about no host.
A host of the universe is listed exactly if the first level that lacks it is an even one (or, if none lacks it, if the
number of levels is odd). Pages test their host against the levels' bits: no join. Only building the levels looks the
universe up in the key table.

A level's bits are a scalar subquery of at most MOST_BITS bits; a larger list goes through an exact semi-join.

Edge cases: a null url or one without "://" has an empty host and path; an empty host is a key like others; null keys
list nothing; keys in capitals are lower-cased; repeated keys count once; keys of no page are left out of the levels;
no listed keys give no levels, and nothing is listed; repeated rows are judged one by one; an empty table gives an
empty result; other columns of either table, whatever their names, do not matter.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillon.llm.store import cut

HASHES, BITS_PER_KEY = 4, 10
MOST_BITS = 1 << 26
#: Host and path prefix, and verdict.
RULES = (("org/", "allow"), ("example.org/es/", "block"), ("example.org/en/1", "block"), ("com/fr/", "allow"), ("com/de/", "block"))
#: Without a key table, hosts of the corpus with one of these words between dots and hyphens are the keys.
UNWANTED = ("adult", "ads", "bets", "casino", "pills", "spam")
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def host_and_path(url: Column) -> tuple[Column, Column]:
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise("")
    rest = F.coalesce(rest, F.lit(""))
    return F.translate(F.regexp_extract(rest, "^[^/?#]*", 0), UPPER, LOWER), F.regexp_extract(rest, "^[^/?#]*([^?#]*)", 1)


def rule_for(host: Column, path: Column, rules=RULES) -> tuple[Column, Column]:
    """The longest rule that fits, and its verdict; else nulls."""
    rule, verdict = F, F
    for text, what in sorted(rules, key=lambda x: (-len(x[0]), x[0])):
        name, _, rest = text.partition("/")
        fits = ((host == name) | F.endswith(host, F.lit(f".{name}"))) & F.startswith(path, F.lit(f"/{rest}"))
        rule, verdict = rule.when(fits, text), verdict.when(fits, what)
    return rule, verdict


def _bits(key: Column, level: int, m: int) -> list[Column]:
    return [F.pmod(F.xxhash64(key, F.lit(level), F.lit(j)), F.lit(m)) for j in range(HASHES)]


def _has(key: Column, level: int, m: int, words: DataFrame) -> Column:
    array = words.scalar()
    out = F.lit(True)
    for bit in _bits(key, level, m):
        word = F.get(array, F.floor(bit / 64).cast("int"))
        out = out & (F.call_function("shiftright", word, (bit % 64).cast("int")).bitwiseAND(F.lit(1).cast("long")) == 1)
    return out


def _filter(keys: DataFrame, level: int, m: int) -> DataFrame:
    """One row: the bits of a level, as an array of longs."""
    bits = keys.select(F.explode(F.array(*_bits(F.col("key"), level, m))).alias("bit"))
    bits = bits.groupBy(F.floor(F.col("bit") / 64).alias("id")).agg(F.bit_or(F.call_function("shiftleft", F.lit(1).cast("long"), (F.col("bit") % 64).cast("int"))).alias("bits"))
    words = keys.sparkSession.range(m // 64).join(bits, "id", "left").select("id", F.coalesce("bits", F.lit(0).cast("long")).alias("bits"))
    return cut(words.agg(F.transform(F.array_sort(F.collect_list(F.struct("id", "bits"))), lambda x: x["bits"]).alias("words")))


def cascade(universe: DataFrame) -> list[tuple[int, int, DataFrame]] | None:
    """Levels (number, bits, words) from a written table (key, listed) of distinct keys; None if a level would be above MOST_BITS."""
    inside, outside = universe.where("listed").select("key"), universe.where("not listed").select("key")
    levels: list[tuple[int, int, DataFrame]] = []
    while n := inside.count():
        level = len(levels) + 1
        m = 64 << max(0, math.ceil(math.log2(n * BITS_PER_KEY / 64)))
        if m > MOST_BITS:
            return None
        words = _filter(inside, level, m)
        levels.append((level, m, words))
        inside, outside = cut(outside.where(_has(F.col("key"), level, m, words))), inside
    return levels


def listed(key: Column, levels: list[tuple[int, int, DataFrame]]) -> Column:
    out = F.lit(len(levels) % 2 == 1)
    for level, m, words in reversed(levels):
        out = F.when(~_has(key, level, m, words), F.lit(level % 2 == 0)).otherwise(out)
    return out


def unwanted_hosts(hosts: DataFrame, words=UNWANTED) -> DataFrame:
    """A key table (key) of those hosts (key) that have one of the words between dots and hyphens."""
    return hosts.where(F.arrays_overlap(F.split("key", "[.-]"), F.array(*map(F.lit, words)))).select("key")


def universe_of(hosts: DataFrame, keys: DataFrame) -> DataFrame:
    """key, listed of every distinct host (key) of the corpus."""
    wanted = keys.select(F.translate(F.col("key").cast("string"), UPPER, LOWER).alias("key"), F.lit(True).alias("listed")).where("key is not null").distinct()
    return hosts.join(wanted, "key", "left").select("key", F.coalesce("listed", F.lit(False)).alias("listed"))


def judge(pages: DataFrame, rules=RULES, keys: DataFrame | None = None) -> DataFrame:
    """page_id, host, path, rule, verdict of every row; keys is a table of listed hosts (key)."""
    host, path = host_and_path(F.col("url"))
    rows = pages.select("page_id", host.alias("host"), path.alias("path"))
    hosts = cut(rows.select(F.col("host").alias("key")).distinct())
    universe = cut(universe_of(hosts, unwanted_hosts(hosts) if keys is None else keys))
    levels = cascade(universe)
    if levels is None:
        bad = universe.where("listed").select(F.col("key").alias("_key"))
        rows = rows.join(bad, F.col("host") == F.col("_key"), "left").withColumn("_listed", F.col("_key").isNotNull()).drop("_key")
    else:
        rows = rows.withColumn("_listed", listed(F.col("host"), levels))
    rule, verdict = rule_for(F.col("host"), F.col("path"), rules)
    return rows.select("page_id", "host", "path", rule.alias("rule"), F.coalesce(verdict, F.when(F.col("_listed"), "block").otherwise("allow")).alias("verdict"))


def oracle_sql() -> str:
    words = ", ".join(f"'{w}'" for w in UNWANTED)
    cases = {k: " ".join(f"WHEN (host = '{t.partition('/')[0]}' OR ends_with(host, '.{t.partition('/')[0]}')) AND starts_with(path, '/{t.partition('/')[2]}') THEN '{k and v or t}'" for t, v in sorted(RULES, key=lambda x: (-len(x[0]), x[0]))) for k in (0, 1)}
    return f"""
WITH rests AS (SELECT page_id, CASE WHEN position('://' IN url) > 0 THEN substr(url, position('://' IN url) + 3) ELSE '' END AS rest FROM pages),
parts AS (SELECT page_id, translate(regexp_extract(coalesce(rest, ''), '^[^/?#]*'), '{UPPER}', '{LOWER}') AS host, regexp_extract(coalesce(rest, ''), '^[^/?#]*([^?#]*)', 1) AS path FROM rests)
SELECT page_id, host, path, CASE {cases[0]} END AS rule,
  coalesce(CASE {cases[1]} END, CASE WHEN list_has_any(regexp_split_to_array(host, '[.-]'), [{words}]) THEN 'block' ELSE 'allow' END) AS verdict
FROM parts"""
