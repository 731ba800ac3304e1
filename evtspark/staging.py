"""Steps that are computed once: written as Parquet in the folder that all executors share, and read back."""

from __future__ import annotations

import tempfile
import uuid
from functools import lru_cache

from pyspark.sql import DataFrame, SparkSession


@lru_cache(maxsize=1)
def _own_dir() -> str:
    return tempfile.mkdtemp(prefix="spark-shared-")


def workspace(spark: SparkSession, kind: str = "streams") -> str:
    """A new folder under the shared checkpoint folder. A local session that names none gets one of its own; on a cluster that is refused."""
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not base and not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    return f"{(base or _own_dir()).rstrip('/')}/{kind}/{uuid.uuid4().hex}"


def stage(df: DataFrame) -> DataFrame:
    """The rows of ``df`` with their lineage cut; they survive the loss of executors."""
    path = workspace(df.sparkSession, "steps")
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
