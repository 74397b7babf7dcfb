"""The registered queries of this subpackage."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sqlloom.llm import bpe, lookalike, mixture, mojibake, personal, repeats, residue
from sqlloom.sources.once import once
from sqlloom.sources.scratch import written
from sqlloom.sources.tables import spread, table


def _forms(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame]:
    left = spread(table(spark, folder, "submissions").select("submission_id", "sql"))
    right = spread(table(spark, folder, "sql_extracts").select("extract_id", "sql"))
    counts = lookalike.trigram_counts(left.select("sql").union(right.select("sql")))
    return lookalike.one_form(left, "submission_id", "sql", counts), lookalike.one_form(right, "extract_id", "sql", counts)


def p2_found(spark: SparkSession, folder: str) -> DataFrame:
    pairs = lookalike.same_looking(*_forms(spark, folder))
    return pairs.select(F.col("left_key").alias("submission_id"), F.col("right_key").alias("extract_id"))


def p2_forms(spark: SparkSession, folder: str) -> DataFrame:
    left, right = _forms(spark, folder)
    named = [once(df.select(F.lit(n).alias("table_name"), F.col("key").alias("row_id"), F.col("form").alias("sql_form")), "row_id") for n, df in (("submissions", left), ("sql_extracts", right))]
    return named[0].union(named[1])


def p2_classes(spark: SparkSession, folder: str) -> DataFrame:
    return lookalike.same_looking_classes(*_forms(spark, folder))


def p3_found(spark: SparkSession, folder: str) -> DataFrame:
    rows = spread(table(spark, folder, "submissions").select("submission_id", "sql"))
    return repeats.members(rows, "submission_id", "sql").withColumnRenamed("member_id", "submission_id")


def p3_statements(spark: SparkSession, folder: str) -> DataFrame:
    rows = spread(table(spark, folder, "submissions").select("submission_id", "sql"))
    return repeats.collapsed(rows, "submission_id", "sql")


def _garbled(spark: SparkSession, folder: str) -> DataFrame:
    parts = [("sql_extracts", "extract_id", "sql"), ("plan_extracts", "plan_id", "plan_text")]
    rows = [(n, key, text, spread(table(spark, folder, n).select(key, text))) for n, key, text in parts]
    counts = written(mojibake.piece_counts(rows[0][3].select("sql").union(rows[1][3].select("plan_text"))))
    model = mojibake.train(mojibake.most_frequent(counts))
    sound = mojibake.sound_pieces(counts, model)
    found = [mojibake.garbled_rows(df, key, text, model, sound).withColumn("table_name", F.lit(n)) for n, key, text, df in rows]
    return found[0].union(found[1]).withColumnRenamed("key", "row_id")


def p4_found(spark: SparkSession, folder: str) -> DataFrame:
    return _garbled(spark, folder).select("table_name", "row_id").dropDuplicates()


def p4_restored(spark: SparkSession, folder: str) -> DataFrame:
    return _garbled(spark, folder).dropDuplicates(["table_name", "row_id"])


_PRIVATE = (("sql", False), ("plan_text", True))


def _personal(spark: SparkSession, folder: str) -> DataFrame:
    names = table(spark, folder, "name_parts")
    rows = spread(table(spark, folder, "submissions").select("submission_id", "sql", "plan_text"))
    return personal.judged(written(personal.collect(rows, "submission_id", _PRIVATE)), names)


def p5_found(spark: SparkSession, folder: str) -> DataFrame:
    return _personal(spark, folder).select(F.col("key").alias("submission_id"), F.col("field").alias("field_name"), "kind").dropDuplicates()


def p5_redacted(spark: SparkSession, folder: str) -> DataFrame:
    rows = spread(table(spark, folder, "submissions").select("submission_id", "sql", "plan_text"))
    return personal.redacted(rows, "submission_id", _PRIVATE, _personal(spark, folder))


def p6_ids(spark: SparkSession, folder: str) -> DataFrame:
    rows = spread(table(spark, folder, "documents").select("doc_id", "text"))
    return bpe.token_ids(rows, "doc_id", "text", bpe.load())


def _mixed(spark: SparkSession, folder: str) -> DataFrame:
    rows = spread(table(spark, folder, "documents").select("doc_id", "source", "text"))
    docs = written(bpe.token_counts(rows, ["doc_id", "source"], "text", bpe.load()))
    return mixture.mixed(docs, table(spark, folder, "mix_targets"))


def p7_uses(spark: SparkSession, folder: str) -> DataFrame:
    return _mixed(spark, folder)


def p7_shares(spark: SparkSession, folder: str) -> DataFrame:
    return mixture.shares(_mixed(spark, folder), table(spark, folder, "mix_targets"))


def _residue(spark: SparkSession, folder: str) -> DataFrame:
    rows = spread(table(spark, folder, "documents").select("doc_id", "text"))
    matcher = residue.Matcher(residue.frequencies(rows, "text"))
    return residue.residue(rows, "doc_id", "text", matcher)


def p8_found(spark: SparkSession, folder: str) -> DataFrame:
    return _residue(spark, folder).select("doc_id").dropDuplicates()


def p8_kept(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "documents").join(_residue(spark, folder).select("doc_id"), "doc_id", "left_anti")


QUERIES = {f.__name__: f for f in (p2_found, p2_forms, p2_classes, p3_found, p3_statements, p4_found, p4_restored, p5_found, p5_redacted, p6_ids, p7_uses, p7_shares, p8_found, p8_kept)}
ORACLE: dict[str, str] = {}
