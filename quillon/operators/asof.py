"""As-of and range joins."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def asof_join(left: DataFrame, right: DataFrame, by: Sequence[str], order: Sequence[str], take: Sequence[str]) -> DataFrame:
    """left with the `take` columns of the last right row at or before it in (by, order).

    One union and one running window: rows meet once by sort order, no pairs are made. At equal order the right row
    counts as before.
    """
    a = left.withColumns({"_side": F.lit(1), "_took": F.lit(None).cast(right.select(F.struct(*take).alias("s")).schema["s"].dataType)})
    b = right.select(*by, *order, F.struct(*take).alias("_took")).withColumn("_side", F.lit(0))
    w = W.partitionBy(*by).orderBy(*order, "_side").rowsBetween(W.unboundedPreceding, 0)
    both = a.unionByName(b, allowMissingColumns=True).withColumn("_last", F.last("_took", ignorenulls=True).over(w))
    return both.where("_side = 1").select(*left.columns, *(F.col(f"_last.{c}").alias(f"asof_{c}") for c in take))


def band_join(left: DataFrame, right: DataFrame, by: Sequence[str], at: str, tolerance: int) -> DataFrame:
    """Pairs with |left.at - right.at| <= tolerance: an equi-join on bins of tolerance + 1, each right row in three bins.

    The right side's columns come as right_<name>.
    """
    size = tolerance + 1
    a = left.withColumn("_bin", F.floor(F.col(at) / size))
    b = right.select(*by, *(F.col(c).alias(f"right_{c}") for c in right.columns if c not in by))
    b = b.withColumn("_bin", F.explode(F.array(*(F.floor(F.col(f"right_{at}") / size) + d for d in (-1, 0, 1)))))
    return a.join(b, [*by, "_bin"]).where(F.abs(F.col(at) - F.col(f"right_{at}")) <= tolerance).drop("_bin")
