"""Session helpers: the shared folder and lineage cuts of iterative operators."""

from __future__ import annotations

import atexit
import re
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_LOCAL: dict[str, str] = {}


def shared_dir(spark: SparkSession) -> str:
    """The folder of spark.checkpoint.dir; a temporary one only for local sessions that leave it unset."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not re.match(r"local(\[|$)", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir must name a folder that the whole cluster shares")
        if spark.sparkContext.applicationId not in _LOCAL:
            _LOCAL[spark.sparkContext.applicationId] = tempfile.mkdtemp(prefix="quillon-")
            atexit.register(shutil.rmtree, _LOCAL[spark.sparkContext.applicationId], ignore_errors=True)
        found = _LOCAL[spark.sparkContext.applicationId]
    return found


def cut(df: DataFrame) -> DataFrame:
    """df written to the shared folder and read again: an iterative plan stays short, and lost executors cost one step."""
    path = f"{shared_dir(df.sparkSession).rstrip('/')}/quillon/{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
