"""Archive records of analysed statements: de-identified, fingerprinted, partitioned by month."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sqlloom.functions import text as T
from sqlloom.operators.masking import mask_udf
from sqlloom.sources.once import once

MARKER = "[UNAVAILABLE]"


def records(texts: DataFrame, statements: DataFrame, compliance: DataFrame, scores: DataFrame) -> DataFrame:
    """One record a submission: no application number, no literals, no way back to them.

    ``texts``: submission_id, submitted_at and sql; a key counts once, with its earliest time.
    Submissions without a verdict have no record.
    """
    safe = F.coalesce(T.deidentify(T.strip_comments(F.col("m.masked_sql"))), F.lit(MARKER))
    one = once(texts.select("submission_id", "submitted_at", "sql"), "submission_id")
    base = one.select("submission_id", F.lit(1).alias("schema_version"), mask_udf("sql").alias("m"), "submitted_at").select("submission_id", "schema_version", "submitted_at", safe.alias("sql"))
    base = base.withColumn("fingerprint", T.fingerprint(F.col("sql")))
    stmts = statements.groupBy("submission_id").agg(
        F.count("*").alias("n_statements"), F.array_sort(F.collect_list(F.struct("idx", "statement_type", "parse_status", "tables", "flags", "has_where"))).alias("statements")
    )
    verdict = compliance.select("submission_id", F.struct(F.col("status"), "block_count", "notice_count").alias("compliance"))
    score = scores.select("submission_id", F.struct("score", "level", "base_index").alias("improvement"))
    month = F.date_format(F.from_utc_timestamp("submitted_at", "Asia/Taipei"), "yyyy-MM")
    out = base.join(stmts, "submission_id", "left").join(verdict, "submission_id").join(score, "submission_id", "left")
    return out.withColumn("month", F.coalesce(month, F.lit("unknown"))).drop("submitted_at")


def append(df: DataFrame, path: str) -> None:
    """Adds records to the archive; the commit protocol keeps concurrent writers apart."""
    df.write.mode("append").partitionBy("month").json(path)
