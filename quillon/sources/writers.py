"""Sinks: validated batches, content-addressed artifacts, reports."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillon.session import cut


class Rejected(ValueError):
    """A batch that breaks a rule; nothing of it was written."""


def write_batch(df: DataFrame, path: str, key: list[str], mode: str = "errorifexists", store: DataFrame | None = None) -> None:
    """Writes all or nothing: a repeated or null key, or one that the store has with other values, rejects the batch, and
    Spark's committer publishes whole jobs. The batch is computed once."""
    df = cut(df)
    bad = df.groupBy(*key).agg(F.count("*").alias("n")).where(" or ".join(["n > 1", *(f"{k} is null" for k in key)]))
    if bad.limit(1).count():
        raise Rejected(f"keys {key} are not unique")
    if store is not None:
        fields = [c for c in df.columns if c not in key and c in store.columns]
        known = store.select(*key, F.xxhash64(*fields).alias("_known")) if fields else store.select(*key, F.lit(0).alias("_known"))
        other = df.join(known, key).where(F.xxhash64(*fields) != F.col("_known")) if fields else df.limit(0)
        if other.limit(1).count():
            raise Rejected(f"the store has other values for some of the keys {key}")
        df = df.join(known, key, "left_anti")
    df.write.mode(mode).parquet(path)


def content_addressed(files: DataFrame) -> DataFrame:
    """sha256, content, length of distinct contents."""
    return files.select(F.sha2("content", 256).alias("sha256"), "content", F.octet_length("content").alias("length")).dropDuplicates(["sha256"])


def put_contents(files: DataFrame, path: str) -> DataFrame:
    """Adds those contents (content) to the store at path that it lacks; the added sha256 and length."""
    spark, new = files.sparkSession, content_addressed(files)
    try:
        new = new.join(spark.read.parquet(path).select("sha256"), "sha256", "left_anti")
    except AnalysisException as e:
        if "PATH_NOT_FOUND" not in str(e):
            raise
    new = cut(new)
    new.write.mode("append").parquet(path)
    return new.select("sha256", "length")


def damaged_contents(spark: SparkSession, path: str) -> DataFrame:
    """sha256 of stored contents that no longer have it."""
    return spark.read.parquet(path).where(F.sha2("content", 256) != F.col("sha256")).select("sha256")


def version_records(versions: DataFrame, path: str) -> None:
    """One JSON line for each version record, in files of their circuits' folders; empty fields are left out."""
    text = F.to_json(F.struct(*versions.columns))
    versions.select(F.col("logical_circuit_id"), text.alias("value")).write.mode("overwrite").partitionBy("logical_circuit_id").text(path)


def report(df: DataFrame, path: str, kind: str = "json") -> None:
    """JSON lines or CSV with a header, one row each."""
    writer = df.write.mode("overwrite")
    writer.option("header", True).csv(path) if kind == "csv" else writer.json(path)
