"""Multi-objective operators: Pareto fronts and dominance. Lower is better."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quillon.operators import records
from quillon.session import cut


#: Parts whose own fronts are taken first.
SALTS = 64
#: Base of the digits of places in which dominators are counted, a power of two.
FAN = 16


def front_2d(df: DataFrame, x: str, y: str, by: Sequence[str] = ()) -> DataFrame:
    """Rows that no other row of their group dominates; equal points stay together.

    Reduced first to the least y of each x, then a running minimum over x: a row stays if it has its x's least y and
    no smaller x reaches it. No pair of rows is compared. Fronts of hash parts come before the front of a whole group,
    so that one large group is not one task's sort.
    """
    least = df.groupBy(*by, x).agg(F.min(y).alias("_least")).withColumn("_salt", F.pmod(F.xxhash64(x), F.lit(SALTS)))
    for part in ([*by, "_salt"], list(by) or [F.lit(0)]):
        w = W.partitionBy(*part).orderBy(x).rowsBetween(W.unboundedPreceding, -1)
        least = least.withColumn("_before", F.min("_least").over(w)).where("_before is null or _least < _before").drop("_before")
    best = least.drop("_salt").withColumnsRenamed({c: f"_{c}" for c in (*by, x)})
    same = reduce(lambda a, b: a & b, (F.col(c).eqNullSafe(F.col(f"_{c}")) for c in (*by, x)))
    return df.join(best, same & (F.col(y) == F.col("_least"))).select(df.columns)


def population_fronts(df: DataFrame, x: str, y: str, populations: Sequence[tuple[str, Column]]) -> DataFrame:
    """The front of each named population (name, condition): a row is in each population whose condition it meets."""
    names = F.array_compact(F.array(*(F.when(F.coalesce(inside, F.lit(False)), F.lit(name)) for name, inside in populations)))
    return front_2d(df.withColumn("population", F.explode(names)), x, y, ["population"])


def _dominates(a: str, b: str, metrics: Sequence[str]):
    worse = reduce(lambda p, q: p & q, (F.col(f"{a}.{m}") <= F.col(f"{b}.{m}") for m in metrics))
    better = reduce(lambda p, q: p | q, (F.col(f"{a}.{m}") < F.col(f"{b}.{m}") for m in metrics))
    return worse & better


def front(df: DataFrame, metrics: Sequence[str], by: Sequence[str] = ()) -> DataFrame:
    """n-dimensional front: fronts of hash parts of each group first, then the front of what they keep.

    A part compares its distinct points with one another, and the end those that are on a part's front: it costs the
    square of these, which are few where points are not all on the front. front_2d compares no pairs."""
    points = df.select(*by, *metrics).distinct().withColumn("_salt", F.pmod(F.xxhash64(*metrics), F.lit(SALTS)))
    for part in ([*by, "_salt"], list(by)):
        a, b = points.alias("a"), points.alias("b")
        same = reduce(lambda p, q: p & q, (F.col(f"a.{c}").eqNullSafe(F.col(f"b.{c}")) for c in part), F.lit(True))
        points = cut(b.join(a, same & _dominates("a", "b", metrics), "left_anti"))
    best = points.drop("_salt").withColumnsRenamed({c: f"_{c}" for c in (*by, *metrics)})
    same = reduce(lambda p, q: p & q, (F.col(c).eqNullSafe(F.col(f"_{c}")) for c in (*by, *metrics)))
    return df.join(best, same, "left_semi")


def dominated_by(df: DataFrame, key: str, metrics: Sequence[str], by: Sequence[str] = ()) -> DataFrame:
    """For each row how many of its group dominate it and the smallest key of those. No pair of rows is compared.

    Equal points become one, with their number of keys and the least of them. In the order by all metrics (and by each
    further metric but the last, then by that place) what dominates a point comes before it. Two places differ first at
    one digit to the base FAN: at every level of digits the points of a block meet in the order of the last metric, and
    each sums what came before it with a smaller digit. n points of a group are n rows a level; with more than two
    metrics the binary digits of each of those in between multiply that.
    """
    group, at = [f"_by{i}" for i in range(len(by))], [f"_m{i}" for i in range(len(metrics))]
    rows = df.select(F.col(key).alias("_key"), *(F.col(c).alias(n) for c, n in zip([*by, *metrics], group + at, strict=True)))
    known = reduce(lambda p, q: p & q, (F.col(c).isNotNull() for c in group + at))
    points = rows.where(known).groupBy(*group, *at).agg(F.count("_key").alias("_n"), F.min("_key").alias("_least"))
    between = range(1, len(at) - 1)
    for i in (0, *between):
        points = records.ranks(points, [*group, at[i], "_r0"] if i else group + at, points.columns).withColumnRenamed("rank", f"_r{i}")
    # a group has the same stretch of places in all orders
    ends = points.groupBy(*group).agg(F.min("_r0").alias("_from"), (F.max("_r0") - F.min("_r0")).alias("_last"))
    points = (points.join(ends, group) if group else points.crossJoin(ends)).withColumns({f"_r{i}": F.col(f"_r{i}") - F.col("_from") for i in (0, *between)})
    levels = lambda bits: F.explode(F.expr(f"filter(sequence(0, {62 // bits}), l -> shiftright(_last, {bits} * l) > 0)"))
    cell, source, target = [*group], F.lit(True), F.lit(True)
    for i in between:
        points = points.withColumn(f"_l{i}", levels(1)).withColumn(f"_b{i}", F.expr(f"shiftright(_r{i}, _l{i} + 1)")).withColumn(f"_bit{i}", F.expr(f"shiftright(_r{i}, _l{i}) & 1"))
        source, target = source & (F.col(f"_bit{i}") == 0), target & (F.col(f"_bit{i}") == 1)
        points, cell = points.where(source | target), [*cell, f"_l{i}", f"_b{i}"]
    bits = FAN.bit_length() - 1
    points = points.withColumn("_l0", levels(bits)).withColumn("_b0", F.expr(f"shiftright(_r0, {bits} * (_l0 + 1))")).withColumn("_digit", F.expr(f"cast(shiftright(_r0, {bits} * _l0) & {FAN - 1} as int)"))
    before = W.partitionBy(*cell, "_l0", "_b0").orderBy(at[-1], "_r0").rowsBetween(W.unboundedPreceding, -1)
    least = lambda c, f: F.array(*(f(F.when(source & (F.col("_digit") < d), F.col(c))).over(before) for d in range(1, FAN)))
    found = points.withColumns({"_ns": least("_n", F.sum), "_leasts": least("_least", F.min)}).where(target & (F.col("_digit") > 0))
    found = found.select(*group, *at, F.col("_ns")[F.col("_digit") - 1].alias("_n"), F.col("_leasts")[F.col("_digit") - 1].alias("_least"))
    found = found.groupBy(*group, *at).agg(F.sum("_n").alias("_n"), F.min("_least").alias("_least"))
    return rows.join(found, group + at, "left").groupBy(F.col("_key").alias(key)).agg(F.coalesce(F.sum("_n"), F.lit(0)).alias("dominators"), F.min("_least").alias("first_dominator"))
