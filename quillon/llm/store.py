"""Shared folder, size checks and other helpers of the operators."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows that may be broadcast; above that a shuffled join does the same work.
BROADCAST_ROWS = 1_000_000
#: Bytes that a broadcast table may hold.
BROADCAST_BYTES = 32 << 20
#: Bytes of an Arrow batch on its way to Python, unless the session asks for fewer.
BATCH_BYTES = 8 << 20
#: Setting that has Spark delete a query's shuffle files at its end.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
#: Bits of the most hash ranges, and of those that one step tells apart: rows of a slice are packed for each range, and
#: with more ranges these rows would be tiny. A second step splits such a range.
MOST_BITS, STEP_BITS = 24, 16
#: Temporary folders of local sessions, by application.
LOCAL: dict[str, str] = {}


def shared_dir(spark: SparkSession) -> str:
    """The folder that spark.checkpoint.dir names; a temporary one only where it is unset, as in tests."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        context = spark.sparkContext._jsc.sc().getCheckpointDir()
        if context.isDefined():
            found = context.get()
        elif spark.sparkContext.master.startswith("local[") or spark.sparkContext.master == "local":
            found = LOCAL.setdefault(spark.sparkContext.applicationId, "") or tempfile.mkdtemp(prefix="quillon-")
            LOCAL[spark.sparkContext.applicationId] = found
        else:
            raise ValueError("spark.checkpoint.dir must name a folder that the whole cluster shares")
    return found


def cut(df: DataFrame) -> DataFrame:
    """Writes df as a table in the shared folder and reads it: lost executors cost no earlier stage.

    The write's shuffle files go when it is done, as nothing reads them any more."""
    spark = df.sparkSession
    path = f"{shared_dir(spark).rstrip('/')}/quillon/{uuid.uuid4().hex}"
    before = spark.conf.get(CLEANUP, None)
    spark.conf.set(CLEANUP, "true")
    try:
        df.write.parquet(path)
    finally:
        spark.conf.unset(CLEANUP) if before is None else spark.conf.set(CLEANUP, before)
    out = spark.read.schema(df.schema).parquet(path)
    out.__dict__["written"] = path
    return out


def discard(*tables: DataFrame) -> None:
    """Deletes written tables that nothing will read again."""
    for df in tables:
        path = df.sparkSession._jvm.org.apache.hadoop.fs.Path(df.__dict__["written"])
        path.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).delete(path, True)


def fresh(df: DataFrame, name: str) -> str:
    """A column name like `name` that df does not have, whatever the capitals."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def small(df: DataFrame, rows: int = BROADCAST_ROWS, most: int = BROADCAST_BYTES) -> DataFrame:
    """df with a broadcast hint if it has at most so many rows and bytes, else df. df should be a written table."""
    sizes = [F.coalesce(F.octet_length(c), F.lit(0)) if kind in ("string", "binary") else F.lit(8) for c, kind in df.dtypes]
    n, size = df.agg(F.count("*"), F.coalesce(F.sum(sum(sizes, F.lit(0)).cast("long")), F.lit(0))).first()
    return F.broadcast(df) if n <= rows and size <= most else df


def bounded_batches(spark: SparkSession) -> None:
    """Has Arrow batches to Python end at BATCH_BYTES: a worker holds one batch, and documents can be long.

    A session setting; a lower one stays, and one without bound (0 or less) does not."""
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    if not 0 < size_of(spark.conf.get(key)) <= BATCH_BYTES:
        spark.conf.set(key, str(BATCH_BYTES))


def size_of(text: str) -> int:
    """Bytes of a size such as 8388608, 64b, 8k, 16mb or -1."""
    number, unit = re.fullmatch(r"\s*(-?\d+)\s*([kmgtp]?)(?:i?b)?\s*", text.lower()).groups()
    return int(number) << 10 * " kmgtp".index(unit or " ")


def input_bytes(df: DataFrame) -> int:
    """Catalyst's size estimate, 0 if it has none."""
    n = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    return n if n < 1 << 60 else 0


def range_bits(df: DataFrame, bytes_each: int) -> int:
    """Bits of a hash that tell ranges apart, so that each stands for about bytes_each of the input, and there are no fewer
    than shuffle partitions; at MOST_BITS a range of 16 MB stands for 280 TB of input."""
    n = max(input_bytes(df) // bytes_each, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), 1)
    return min(MOST_BITS, (int(n) - 1).bit_length())


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
