"""Structured Streaming over arriving submissions; new, without a counterpart in the reference."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.query import StreamingQuery

from sqlloom.functions import text as T
from sqlloom.operators.rules import cost

SCHEMA = "submission_id long, application_no string, cost_raw string, sql string, plan_text string, include_ai boolean, submitted_at timestamp, received_at timestamp"


def read(spark: SparkSession, folder: str) -> DataFrame:
    return spark.readStream.schema(SCHEMA).parquet(folder)


def screened(stream: DataFrame, threshold: int = 100_000, late: str = "30 days") -> DataFrame:
    """Verdicts that need no parsing; a submission delivered twice within the watermark counts once."""
    c = cost(F.col("cost_raw"))
    hint = T.parallel_hint(F.col("sql"))
    rows = stream.withWatermark("received_at", late).dropDuplicatesWithinWatermark(["submission_id"])
    return rows.select("submission_id", "received_at", c.alias("cost"), hint.alias("hint"), F.when((c >= threshold) | hint.isNotNull(), "BLOCK").otherwise("PASS").alias("status"), T.fingerprint(T.deidentify(T.strip_comments(F.col("sql")))).alias("fingerprint"))


def start(df: DataFrame, output: str, checkpoint: str, once: bool = True) -> StreamingQuery:
    w = df.writeStream.format("parquet").option("path", output).option("checkpointLocation", checkpoint).outputMode("append")
    return (w.trigger(availableNow=True) if once else w).start()
