"""Gates before a model call and checks of replies, over a table of replies."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sqlloom.config import GATE_FLAGS, Settings
from sqlloom.functions import text as T

# Phrases that no advice may hold.
FORBIDDEN = (
    "Full Table Scan", "full table scan", "全表掃描", "全資料表掃描", "索引失效", "已使用索引", "未使用索引", "已避免全表掃描", "使用了索引", "沒有使用索引", "改善後 COST", "改善後COST",
    "Execution Plan", "執行計畫顯示", "已驗證", "已測試", "實測", "高風險", "嚴重問題", "錯誤寫法",
)
# Words replaced in advice, in this order.
VOCABULARY = (("數據庫", "資料庫"), ("数据库", "資料庫"), ("字段", "欄位"), ("优化SQL", "改善 SQL"), ("優化SQL", "改善 SQL"), ("优化", "改善"), ("優化", "改善"), ("数据", "資料"), ("候選SQL", "建議寫法"), ("候選 SQL", "建議寫法"))

_NUMBER = r"^(?:\d{1,2}|100)$"


def gate(settings: Settings = Settings()) -> Column:
    """Why no full rewrite is asked for a statement: the first reason that holds, or null. Needs ``n_statements``."""
    flags = F.array_intersect("flags", F.array(*map(F.lit, GATE_FLAGS)))
    tokens = T.token_estimate(F.col("raw_sql"))
    return (
        F.when(F.col("n_statements") > 1, "multi_statement").when(F.col("statement_type") != "SELECT", "not_select").when(F.col("parse_status") != "ok", "parse_failed")
        .when(F.size(flags) > 0, F.concat(F.lit("complexity:"), F.array_min(flags))).when(tokens * 1.2 + 900 > settings.max_output_tokens, "too_long_for_rewrite")
    )


def representative(statements: DataFrame, found: DataFrame) -> DataFrame:
    """The statement a reply is about: most telling first (blocked, then most findings), the earliest among equals; whole-request findings don't count."""
    counts = found.where("statement_index >= 0").groupBy("submission_id", F.col("statement_index").alias("idx")).agg(F.max(F.col("status") == "BLOCK").alias("blocked"), F.count("*").alias("n"))
    rows = statements.select("submission_id", "idx").join(counts, ["submission_id", "idx"], "left").na.fill({"blocked": False, "n": 0})
    best = F.min_by("idx", F.struct(~F.col("blocked"), -F.col("n"), "idx"))
    return rows.groupBy("submission_id").agg(best.alias("idx"))


def whole_json(c: Column) -> Column:
    """A JSON text as a variant; null unless it is one value to its end. The parser alone stops behind the first value, so it reads the text as the one item of a list."""
    items = F.try_variant_get(F.try_parse_json(F.concat(F.lit("["), c, F.lit("]"))), "$", "array<variant>")
    return F.when(F.size(items) == 1, F.try_parse_json(c))


def replies(df: DataFrame) -> DataFrame:
    """Replies with their verdict: ``submission_id, status, failure, summary, confidence, n_advice, outcome, h``.

    Failures in this order: no_reply, truncated, bad_json, no_summary, wrong_language (20 characters
    and more without a Chinese one), bad_confidence, bad_advice (no list, or an item without title,
    explanation or confidence), too_much_advice, no_suggestion, bad_outcome. Numbers have to be
    whole and from 0 to 100; true, text and decimals are no numbers. A missing advice list is empty.
    Of several replies to a submission the first good one counts, else the last; ``h`` is the hash
    that finds it again.
    """
    j = F.col("reply_json")
    parsed = whole_json(j)
    raw = lambda path: F.get_json_object(j, path)
    kind = lambda path: F.schema_of_variant(F.try_variant_get(parsed, path, "variant"))
    summary, confidence = raw("$.summary"), raw("$.assessment_confidence_score")
    has = kind("$.advice")
    items = F.from_json(raw("$.advice"), "array<struct<title:string, explanation:string, confidence_score:string>>")
    types = F.transform(F.try_variant_get(parsed, "$.advice", "array<variant>"), F.schema_of_variant)
    number = F.greatest(F.coalesce(F.size(types), F.lit(0)), F.lit(0))
    well = F.forall(types, lambda t: t.rlike(r"\btitle: STRING") & t.rlike(r"\bexplanation: STRING") & t.rlike(r"\bconfidence_score: BIGINT")) & F.forall(items, lambda i: i["confidence_score"].rlike(_NUMBER))
    outcome = raw("$.suggested_sql.rewrite_outcome")
    failure = (
        F.when(j.isNull() | (F.trim(j) == ""), "no_reply").when(F.col("finish_reason") == "length", "truncated").when(parsed.isNull() | ~j.rlike(r"^\s*\{"), "bad_json")
        .when(summary.isNull() | (kind("$.summary") != "STRING"), "no_summary").when((F.length(summary) >= 20) & ~summary.rlike("[\\x{4E00}-\\x{9FFF}]"), "wrong_language")
        .when(confidence.isNull() | ~kind("$.assessment_confidence_score").isin("BIGINT") | ~confidence.rlike(_NUMBER), "bad_confidence")
        .when(has.isNotNull() & ~F.coalesce(has.startswith("ARRAY"), F.lit(False)), "bad_advice").when(number > 3, "too_much_advice").when((number > 0) & ~F.coalesce(well, F.lit(False)), "bad_advice")
        .when(~F.coalesce((kind("$.suggested_sql.available") == "BOOLEAN") & (kind("$.suggested_sql.reason") == "STRING"), F.lit(False)), "no_suggestion")
        .when(outcome.isNotNull() & ~outcome.isin("not_needed", "advice_only"), "bad_outcome")
    )
    rows = df.select("submission_id", "replied_at", F.xxhash64("finish_reason", "reply_json").alias("h"), failure.alias("failure"), summary.alias("summary"), F.when(confidence.rlike(_NUMBER), confidence.try_cast("int")).alias("confidence"), number.alias("n_advice"), outcome.alias("outcome"))
    at = F.unix_micros(F.col("replied_at").cast("timestamp"))
    order = F.struct(F.col("failure").isNotNull(), F.when(F.col("failure").isNull(), at).otherwise(-at), "h")
    best = rows.groupBy("submission_id").agg(F.min_by(F.struct("failure", "summary", "confidence", "n_advice", "outcome", "h"), order).alias("r"))
    return best.select("submission_id", F.when(F.col("r.failure").isNull(), "ok").otherwise("unavailable").alias("status"), "r.*")


def advice(df: DataFrame) -> DataFrame:
    """Advice items of replies, at most three a reply: ``submission_id, pos, title, explanation, example, confidence, dropped``.

    Words of the wrong vocabulary are replaced in order; an item with a forbidden phrase is marked ``dropped``.
    """
    item = "array<struct<title:string, explanation:string, example:string, confidence_score:string>>"
    rows = df.where(whole_json(F.col("reply_json")).isNotNull()).dropDuplicates(["submission_id", "reply_json"]).select("submission_id", F.posexplode(F.from_json(F.get_json_object("reply_json", "$.advice"), item)).alias("pos", "a")).where("pos < 3")

    def plain(c: Column) -> Column:
        for old, new in VOCABULARY:
            c = F.replace(c, F.lit(old), F.lit(new))
        return c

    title, explanation = plain(F.col("a.title")), plain(F.col("a.explanation"))
    text = F.concat_ws(" ", title, explanation)
    dropped = F.lit(False)
    for phrase in FORBIDDEN:
        dropped = dropped | text.contains(phrase)
    return rows.select("submission_id", "pos", title.alias("title"), explanation.alias("explanation"), F.col("a.example").alias("example"), F.when(F.col("a.confidence_score").rlike(_NUMBER), F.col("a.confidence_score").cast("int")).alias("confidence"), dropped.alias("dropped"))


def calibrated(confidence: Column, unparsed: Column, rejected: Column, dropped: Column, corrected: Column, gated: Column) -> Column:
    """The confidence under its caps: 59 for unparsed, rejected or dropped, 79 for corrected, gated or advice only."""
    return F.least(confidence, F.when(unparsed | rejected | dropped, 59).when(corrected | gated, 79).otherwise(100))


def potential(outcomes: DataFrame, found: DataFrame) -> DataFrame:
    """Improvement potential of answered submissions, with the number of proofs.

    A proved full rewrite and every proved advice item is a proof: high from two, medium with one;
    without, low if a finding blocks or is about the writing or there is any advice, notice_only if
    there are other notices, else null.
    """
    proofs = F.size(F.filter("advice", lambda a: F.coalesce(a["verification"].isin("verified", "corrected"), F.lit(False)))) + (F.col("outcome") == "provided").cast("int")
    rules = found.groupBy("submission_id").agg(F.max((F.col("status") == "BLOCK") | (F.col("status") == "NOTICE") & F.col("rule_id").isin("R004", "R005", "R006")).alias("hard"), F.max(F.col("status") == "NOTICE").alias("noticed"))
    rows = outcomes.select("submission_id", proofs.alias("proofs"), F.size("advice").alias("n_advice")).join(rules, "submission_id", "left")
    level = F.when(F.col("proofs") >= 2, "high").when(F.col("proofs") == 1, "medium").when(F.coalesce("hard", F.lit(False)) | (F.col("n_advice") > 0), "low").when(F.col("noticed"), "notice_only")
    return rows.select("submission_id", level.alias("potential"), "proofs")
