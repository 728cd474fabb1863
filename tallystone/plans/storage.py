"""Intermediate tables on shared storage."""

from __future__ import annotations

import tempfile
import time
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

_own: str | None = None


def folder(spark: SparkSession) -> str:
    """A new folder below spark.checkpoint.dir (in local mode a temporary one where that is unset); it goes when the application ends."""
    global _own
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        _own = _own or tempfile.mkdtemp(prefix="tallystone-")
        root = f"file://{_own}"
    path = f"{root}/tallystone/{uuid.uuid4().hex}"
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(at)
    return path


def write(df: DataFrame, path: str, *by: str) -> None:
    """Writes df as parquet. What was shuffled for it, and for what was written before, goes now and not when the driver happens to collect its garbage."""
    df.sparkSession._jvm.System.gc()
    df.write.mode("overwrite").option("compression", "zstd").partitionBy(*by).parquet(path)
    time.sleep(0.1)  # until the listeners of the job have let go of its plan
    df.sparkSession._jvm.System.gc()


def drop(spark: SparkSession, *paths: str) -> None:
    """Removes tables that nobody reads any more."""
    for path in paths:
        at = spark._jvm.org.apache.hadoop.fs.Path(path)
        at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)


def saver(spark: SparkSession) -> Callable[[DataFrame, str], DataFrame]:
    """save(df, name): writes df to a new folder and reads it back. save.drop(names): removes some that nobody reads any more."""
    path = folder(spark)

    def save(df: DataFrame, name: str) -> DataFrame:
        write(df, f"{path}/{name}")
        return spark.read.schema(df.schema).parquet(f"{path}/{name}")

    save.drop = lambda *names: drop(spark, *(f"{path}/{n}" for n in names))
    return save
