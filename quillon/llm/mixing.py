"""Mixing sources to target weights, with DataFrame functions only.

Every document has a hash-random key. All documents are range-sorted by source and key, so that a hot source is cut
into many ranges; the ranges' totals are prefix-summed within each source, then each range on its own. Sources are
ranked and their targets found by the same range-sorted prefix sums, so that no task holds all sources either.
A source's target is cut exactly: whole epochs first, then documents in key order up to the rest, the last in part.

Edge cases: a null text has size 0 and takes nothing; a null source is a source, the last one; repeated rows count
each (rows of one doc_id, or without one, that have equal sizes are dealt over ranges by their place in the input, as
they can stand in any order); sources of size 0 have target 0; an empty table gives an empty result; other columns,
whatever their names, do not matter. The result is the same in every run.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quillon.llm.store import cut, fresh, small

WEIGHTS = (3.0, 1.0, 2.0)
SHARE, MOST = 1.5, 2.0
#: Documents for each range of the sort, about, and the most ranges (a range is sorted with spills).
RANGE_ROWS, MOST_RANGES = 1 << 14, 1 << 15


def ranged(df: DataFrame, order: list[Column], rows: int) -> DataFrame:
    """df in order over about as many ranges as `rows` rows need, as a written table with a column `range`."""
    parts = max(min(MOST_RANGES, -(-rows // RANGE_ROWS)), int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    return cut(df.repartitionByRange(parts, *order).withColumn("range", F.spark_partition_id()))


def before(df: DataFrame, order: list[Column], group: list[str], **sums: Column) -> DataFrame:
    """df (from ranged()) with the sum over all rows of its group that come earlier, for each of `sums`."""
    totals = df.groupBy(*group, "range").agg(*(F.sum(x).alias(f"_{name}") for name, x in sums.items()))
    earlier = W.partitionBy(*group).orderBy("range").rowsBetween(W.unboundedPreceding, -1)
    totals = totals.select(*(F.col(c).alias(f"_{c}") for c in [*group, "range"]), *(F.coalesce(F.sum(f"_{name}").over(earlier), F.lit(0)).alias(f"_{name}") for name in sums))
    same = [F.col(c).eqNullSafe(F.col(f"_{c}")) for c in [*group, "range"]]
    inside = W.partitionBy(*group, "range").orderBy(*order).rowsBetween(W.unboundedPreceding, -1)
    out = df.join(small(cut(totals)), same, "left")
    return out.withColumns({name: F.col(f"_{name}") + F.coalesce(F.sum(x).over(inside), F.lit(0)) for name, x in sums.items()}).drop(*(f"_{c}" for c in [*group, "range", *sums]))


def targets(sizes: DataFrame) -> DataFrame:
    """source, source_size, target from (source, total): one row for each source.

    The targets min(MOST * total, level * weight) share SHARE of all words: capped sources are those with the least
    MOST * total / weight, and the level follows from the first one that needs no cap.
    """
    sizes = cut(sizes)
    n, total = sizes.agg(F.count("*"), F.coalesce(F.sum("total"), F.lit(0))).first()
    by_name = [F.col("source").isNull(), F.col("source")]
    rank = before(ranged(sizes, by_name, n), by_name, [], place=F.lit(1)).drop("range")
    weight = F.get(F.array(*map(F.lit, WEIGHTS)), F.pmod("place", F.lit(len(WEIGHTS))).cast("int"))
    rank = rank.select("source", "total", weight.alias("weight"), (F.col("total") * MOST).alias("cap"))
    by_ratio = [F.col("cap") / F.col("weight"), *by_name]
    rank = cut(before(ranged(rank, by_ratio, n), by_ratio, [], capped=F.col("cap"), weighed=F.col("weight")))
    all_weights = rank.agg(F.coalesce(F.sum("weight"), F.lit(1.0))).first()[0]
    level = (F.lit(SHARE) * F.lit(float(total)) - F.col("capped")) / (F.lit(all_weights) - F.col("weighed"))
    open_ = rank.withColumn("level", level).where(F.col("level") * F.col("weight") <= F.col("cap"))
    water = open_.agg(F.min_by("level", F.struct(by_ratio[0].alias("ratio"), by_name[0].alias("none"), "source"))).first()[0]
    target = F.col("cap") if water is None else F.least(F.col("cap"), F.lit(water) * F.col("weight"))
    return rank.select("source", F.col("total").alias("source_size"), target.alias("target"))


def _size() -> Column:
    return F.coalesce(F.regexp_count("text", F.lit("[^\\x20\\x09-\\x0D]+")), F.lit(0)).cast("long")


def _key(seed: int) -> Column:
    return F.sha2(F.concat_ws(":", F.lit(str(seed)), F.coalesce(F.col("doc_id").cast("string"), F.lit("-"))), 256)


def _placed(docs: DataFrame, seed: int) -> DataFrame:
    """source, key, doc_id, size of every row with the words of its source before it, the source's size and target, the
    whole epochs of it and the words that are left for one more."""
    rows = cut(docs.select("doc_id", F.col("source").cast("string").alias("source"), _size().alias("size"), _key(seed).alias("key"), F.monotonically_increasing_id().alias("at")))
    aim = small(cut(targets(rows.groupBy("source").agg(F.sum("size").alias("total"))).withColumnRenamed("source", "_source")))
    order = [F.col(c) for c in ("source", "key", "doc_id", "size", "at")]
    rows = before(ranged(rows, order, rows.count()), order[1:], ["source"], before=F.col("size"))
    rows = rows.join(aim, F.col("source").eqNullSafe(F.col("_source")), "left").drop("_source")
    whole = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0).cast("long")
    return rows.withColumn("whole", whole).withColumn("rest", F.floor(F.col("target")).cast("long") - F.col("whole") * F.col("source_size"))


def mix(docs: DataFrame, seed: int = 1) -> DataFrame:
    """doc_id, size, source_size, target, taken of every row, and the source."""
    taken = F.col("whole") * F.col("size") + F.greatest(F.lit(0), F.least(F.col("size"), F.col("rest") - F.col("before")))
    return _placed(docs, seed).select("doc_id", "size", "source_size", "target", taken.cast("long").alias("taken"), "source")


def mixed(docs: DataFrame, seed: int = 1) -> DataFrame:
    """docs with size, source_size, target and taken (new names if docs has them): its texts pass no shuffle.

    Of each source only the row is sought in which the last epoch ends: keys before it are taken, keys behind it not.
    Rows that have that row's key, doc_id and size share its words evenly, to less than one word each."""
    rows = cut(_placed(docs, seed).select("source", "key", "doc_id", "size", "before", "source_size", "target", "whole", "rest"))
    place = F.struct("key", "doc_id", "size")
    ends = rows.where("before < rest and rest <= before + size").groupBy("source").agg(F.min_by(place, F.col("before")).alias("end"))
    ends = small(cut(ends.withColumnRenamed("source", "_source")))
    tied = rows.join(ends, F.col("source").eqNullSafe(F.col("_source")) & place.eqNullSafe(F.col("end"))).groupBy("source").agg(F.min("end").alias("end"), F.min("before").alias("before"), F.min("rest").alias("rest"), F.min("size").alias("size"), F.count("*").alias("n"))
    share = F.floor(F.least(F.col("n") * F.col("size"), F.col("rest") - F.col("before")) / F.col("n")).cast("long")
    tied = small(cut(tied.select(F.col("source").alias("_tied"), "end", share.alias("share"))))
    facts = rows.groupBy(F.col("source").alias("_source")).agg(*(F.min(c).alias(c) for c in ("source_size", "target", "whole")))
    facts = facts.join(tied, F.col("_source").eqNullSafe(F.col("_tied")), "left").drop("_tied")
    facts = small(cut(facts.select(F.struct("*").alias("facts"), F.col("_source").alias("_key"))))
    own = docs.select(F.struct(*docs.columns).alias("row"), _size().alias("own_size"), _key(seed).alias("own_key"))  # words are counted once
    out = own.join(facts, F.col("row.source").cast("string").eqNullSafe(F.col("_key")), "left")
    here = F.struct(F.col("own_key").alias("key"), F.col("row.doc_id").alias("doc_id"), F.col("own_size").alias("size"))
    part = F.when(here < F.col("facts.end"), F.col("own_size")).when(here == F.col("facts.end"), F.col("facts.share")).otherwise(0)
    taken = F.col("facts.whole") * F.col("own_size") + F.coalesce(part, F.lit(0))
    new = {"size": F.col("own_size"), "source_size": F.col("facts.source_size"), "target": F.col("facts.target"), "taken": taken.cast("long")}
    return out.select("row.*", *(x.alias(fresh(docs, name)) for name, x in new.items()))
