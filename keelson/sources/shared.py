"""The folder that driver and executors share."""

from __future__ import annotations

import os
import tempfile
import uuid
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    there = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not there:
        master = spark.sparkContext.master
        if not master.startswith("local") or master.startswith("local-cluster"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="keelson-"))
        there = spark.sparkContext.getCheckpointDir()
    return there


def stored(df: DataFrame, name: str) -> DataFrame:
    """Written once and read again, so that later steps do not depend on what executors hold."""
    spark = df.sparkSession
    path = f"{shared_dir(spark).rstrip('/')}/keelson-{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._stored_at = path
    return out


def discard(df: DataFrame) -> None:
    """Deletes what stored wrote, once nothing reads it any more."""
    remove(df.sparkSession, df._stored_at)


def remove(spark: SparkSession, place: str) -> None:
    """Deletes a file or folder, wherever it is."""
    path = spark._jvm.org.apache.hadoop.fs.Path(place)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def workers_find_package(spark: SparkSession | None = None) -> None:
    """Python workers look for the package where the driver found it."""
    spark = spark or SparkSession.active()
    there, root = spark.sparkContext.environment, str(Path(__file__).resolve().parents[2])
    if root not in there.get("PYTHONPATH", "").split(os.pathsep):
        there["PYTHONPATH"] = os.pathsep.join(filter(None, [root, there.get("PYTHONPATH", "")]))
