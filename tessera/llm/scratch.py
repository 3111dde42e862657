"""Durable intermediate tables.

A step whose result is read more than once, or that a later step must be able to re-read after losing executors, is
written as Parquet below the shared folder the cluster names in ``spark.checkpoint.dir``. Nothing is kept on an
executor's own disk. A folder of this process is used only where that setting is missing and driver and executors are one
process, as in tests; on a cluster without the setting, an error is raised.
"""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def folder(spark: SparkSession) -> str:
    """The shared folder of this application's intermediate tables."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that all machines share")
        base = "file://" + tempfile.mkdtemp(prefix="scratch-")
        spark.conf.set("spark.checkpoint.dir", base)
    return f"{base.rstrip('/')}/scratch/{spark.sparkContext.applicationId}"


def path(spark: SparkSession, name: str) -> str:
    return f"{folder(spark)}/{name}-{uuid.uuid4().hex}"


def store(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: its lineage then ends at files every executor sees."""
    spark = df.sparkSession
    at = path(spark, name)
    df.write.parquet(at)
    return spark.read.schema(df.schema).parquet(at)


def drop(spark: SparkSession) -> None:
    """Delete every intermediate table of this application; results not yet read become unreadable."""
    at = spark._jvm.org.apache.hadoop.fs.Path(folder(spark))
    at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)
