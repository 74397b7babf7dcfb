"""Columns that a page would show: ordered tests over results, as codes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sqlloom.functions import text as T
from sqlloom.operators.diff import best_line

# Words of advice that is about reading comfort only, and words that make it about work saved.
READABILITY = r"(?i)(?:可讀性|更?簡潔|較?簡潔|容易閱讀|較易閱讀|易於閱讀|便於閱讀|方便閱讀|容易維護|較易維護|易於維護|便於維護|方便維護|格式更一致)"
PERFORMANCE = r"(?i)(?:效能|COST|函數|搜尋|查找|查詢範圍|縮小範圍|萬用字元|索引|重複|讀取|處理|轉換|資料量|JOIN|子查詢)"


def is_performance_advice(title: Column, explanation: Column, before: Column, example: Column) -> Column:
    """Not an OR turned into IN, and not about reading comfort alone."""
    clean_up = F.coalesce(before.rlike(r"(?i)\bOR\b") & example.rlike(r"(?i)\bIN\s*\("), F.lit(False))
    text = F.concat_ws(" ", title, explanation)
    return ~clean_up & ~(text.rlike(READABILITY) & ~text.rlike(PERFORMANCE))


def compliance_summary(blocks: Column, suggestions: Column) -> Column:
    """what the rule rows add up to."""
    return (
        F.when((blocks > 0) & (suggestions > 0), F.concat(F.lit("blocks:"), blocks, F.lit(" suggestions:"), suggestions)).when(blocks > 0, F.concat(F.lit("blocks:"), blocks))
        .when(suggestions > 0, F.concat(F.lit("suggestions:"), suggestions)).otherwise("all_pass")
    )


def tone(status: Column) -> Column:
    return F.when(status == "PASS", "green").when(status.isin("NOTICE", "REVIEW"), "yellow").when(status == "BLOCK", "red").otherwise("gray")


def rule_label(status: Column) -> Column:
    """Null for rules that don't apply: their rows are hidden."""
    return F.when(status == "PASS", "conforms").when(status.isin("NOTICE", "REVIEW"), "suggestion").when(status == "BLOCK", "violates")


def evidence_level(verification: Column, before: Column, example: Column) -> Column:
    """how sure an advice item is."""
    has = lambda c: F.coalesce(F.trim(c) != "", F.lit(False))
    return (
        F.when(verification.isin("verified", "corrected"), "confirmed").when(verification == "unverified", "review").when(has(before) & has(example), "review")
        .when(has(example) & T.sql_looking(example), "review").otherwise("info")
    )


def segments(advice: Column, original: Column, rewrites: Column) -> Column:
    """``array<struct<before, after>>`` to compare. An empty list of the server's rewrites counts, only a missing one falls back on the advice."""
    clean = F.filter(rewrites, lambda r: r["rule"] != "or_eq_to_in")
    own = F.transform(clean, lambda r: F.struct(r["before"].alias("before"), r["after"].alias("after")))
    after = lambda a: F.trim(F.regexp_replace(a["example"], r"^((?:若|假設|如果)[^：:]{1,80})[：:]\s*", ""))
    line = lambda a: F.trim(F.get(F.split(original, "\n"), best_line(original, after(a)) - 1))
    shown = F.filter(advice, lambda a: F.coalesce(a["verification"].isin("verified", "corrected") & (after(a) != "") & T.sql_looking(after(a)) & is_performance_advice(a["title"], a["explanation"], a["before"], a["example"]), F.lit(False)))
    told = F.transform(shown, lambda a: F.struct(F.coalesce(F.when(F.trim(a["before"]) != "", F.trim(a["before"])), line(a)).alias("before"), after(a).alias("after")))
    return F.when(rewrites.isNotNull(), own).otherwise(F.filter(told, lambda s: s["before"].isNotNull()))


def full_rewrite(suggested: Column, outcome: Column, rewrites: Column) -> Column:
    """the whole suggested statement, unless all of the server's rewrites only change the writing."""
    only_clean_up = F.coalesce((F.size(rewrites) > 0) & ~F.exists(rewrites, lambda r: r["rule"] != "or_eq_to_in"), F.lit(False))
    return F.when((outcome == "provided") & ~only_clean_up, suggested)


def adoption(status: Column, confirmed: Column, compliance: Column, potential: Column) -> Column:
    """what can be done with the advice now."""
    return (
        F.when(status == "pending", "pending").when(status == "unavailable", "unavailable").when(confirmed, "confirmed").when(compliance == "BLOCK", "blocked")
        .when(potential.isNull(), "none").when(potential == "notice_only", "notice_only").otherwise("confirm_first")
    )


def headline(compliance: Column, status: Column, n_advice: Column, n_rewrites: Column) -> Column:
    """the detail line of the overview."""
    return (
        F.when(compliance == "BLOCK", F.when(n_advice > 0, "fix_violations_and_advice").otherwise("fix_violations")).when(compliance == "REVIEW", "check_conditions")
        .when(n_rewrites > 0, F.when(status == "pending", "rewrites_advice_pending").when(status == "unavailable", "rewrites_advice_unavailable").otherwise("rewrites"))
        .when(status == "pending", "advice_pending").when(status == "unavailable", "advice_unavailable").when(n_advice > 0, "advice").otherwise("nothing_to_do")
    )


def level_label(level: Column, suggestions: Column) -> Column:
    """a good score beside suggestions reads as improvable."""
    return F.when((level == "GOOD") & (suggestions > 0), "IMPROVABLE").otherwise(level)


def overview(rule_rows: DataFrame, compliance: DataFrame, scores: DataFrame, replies: DataFrame, outcomes: DataFrame, rewrites: DataFrame, potential: DataFrame) -> DataFrame:
    """One row a request with the codes above; requests without a reply are pending.

    ``rewrites``: submission_id and ``rewrites``, all of the request's, null where they were not looked for.
    """
    counts = rule_rows.groupBy("submission_id").agg(F.sum((F.col("status") == "BLOCK").cast("int")).alias("blocks"), F.sum(F.col("status").isin("NOTICE", "REVIEW").cast("int")).alias("suggestions"))
    out = compliance.select("submission_id", F.col("status").alias("compliance")).join(counts, "submission_id").join(scores.select("submission_id", "level"), "submission_id")
    out = out.join(replies.select("submission_id", F.col("status").alias("reply")), "submission_id", "left").join(outcomes.select("submission_id", "outcome", "advice", "sql", F.col("confidence").alias("overall")), "submission_id", "left")
    out = out.join(rewrites, "submission_id", "left").join(potential.select("submission_id", "potential"), "submission_id", "left").withColumn("reply", F.coalesce("reply", F.lit("pending")))
    shown = F.filter("advice", lambda a: is_performance_advice(a["title"], a["explanation"], a["before"], a["example"]))
    out = out.withColumn("shown", F.when(F.col("reply") == "ok", shown))
    n_advice = F.coalesce(F.array_size("shown"), F.lit(0))
    n_rewrites = F.coalesce(F.array_size(F.filter("rewrites", lambda r: r["rule"] != "or_eq_to_in")), F.lit(0))
    confirmed = (F.coalesce(F.col("outcome"), F.lit("")) == "provided") | F.coalesce(F.exists("advice", lambda a: F.coalesce(a["verification"].isin("verified", "corrected"), F.lit(False))), F.lit(False))
    levels = F.transform("shown", lambda a: F.struct(evidence_level(a["verification"], a["before"], a["example"]).alias("level"), F.coalesce(a["confidence"], F.col("overall")).alias("confidence")))  # F8
    return out.select(
        "submission_id", compliance_summary(F.col("blocks"), F.col("suggestions")).alias("summary"), tone(F.col("compliance")).alias("tone"), headline(F.col("compliance"), F.col("reply"), n_advice, n_rewrites).alias("headline"),
        adoption(F.col("reply"), confirmed, F.col("compliance"), F.col("potential")).alias("adoption"), level_label(F.col("level"), F.col("suggestions")).alias("level_label"), n_advice.alias("n_advice"),
        F.to_json(levels).alias("advice_levels"), full_rewrite(F.col("sql"), F.col("outcome"), F.col("rewrites")).alias("full_rewrite"),
    )
