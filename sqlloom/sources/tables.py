"""Tables of a data folder."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def spread(df: DataFrame, *keys: str) -> DataFrame:
    """The rows in at least as many partitions as the cluster has cores.

    For steps with much computing on little data: compressed text of a few MB fills one
    partition, which one core would work on alone. Inputs of enough partitions stay as they are.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    if df.rdd.getNumPartitions() >= cores:
        return df
    n = 2 * cores
    return df.repartition(n, *map(F.col, keys)) if keys else df.repartition(n)
