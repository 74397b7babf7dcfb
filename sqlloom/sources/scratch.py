"""Intermediate tables in the folder that all executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """``spark.checkpoint.dir`` of the session; only where that is unset in local mode, as in tests, a temporary folder, set for the session."""
    folder = spark.conf.get("spark.checkpoint.dir", "") or spark.sparkContext.getCheckpointDir() or ""
    if not folder:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir is not set: a folder that all executors share is needed")
        folder = "file://" + tempfile.mkdtemp(prefix="sqlloom-")
        spark.conf.set("spark.checkpoint.dir", folder)
    return folder.rstrip("/")


def written(df: DataFrame, *parts: str) -> DataFrame:
    """The rows, written once to a table in the shared folder and read from there: cuts the lineage and survives lost executors.

    ``parts``: columns whose values get a directory each, so that readers of one value read that alone.
    The tables go when the driver's JVM ends.
    """
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/sqlloom-{uuid.uuid4().hex}"
    (df.write.partitionBy(*parts) if parts else df.write).parquet(path)
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(at)
    return spark.read.schema(df.schema).parquet(path)
