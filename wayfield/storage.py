"""Intermediate tables in the folder all executors share; they cut lineage and survive lost executors."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """A folder of this application in ``spark.checkpoint.dir``; where that is unset in a temporary folder, in local runs only: on a cluster executors don't share one."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        base = "file://" + tempfile.mkdtemp(prefix="spark-shared-")
        spark.conf.set("spark.checkpoint.dir", base)
    return f"{base.rstrip('/')}/wayfield-{spark.sparkContext.applicationId}"


def saved(df: DataFrame, label: str = "t") -> DataFrame:
    path = f"{shared_folder(df.sparkSession)}/{label}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def _path(spark: SparkSession, path: str):
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark._jsc.hadoopConfiguration()), at


def kept(spark: SparkSession, path: str, build: Callable[[], DataFrame]) -> DataFrame:
    """The table at ``path``, built if it isn't there whole."""
    fs, at = _path(spark, f"{path}/_SUCCESS")
    if not fs.exists(at):
        build().write.mode("overwrite").parquet(path)
    return spark.read.parquet(path)


def clear(spark: SparkSession) -> None:
    """Removes the tables that this application has left in the shared folder; call it once results are written."""
    fs, at = _path(spark, shared_folder(spark))
    fs.delete(at, True)
