"""One call for the whole analysis of a table of requests."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sqlloom.config import Settings
from sqlloom.operators import detect, guards, masking, outcomes, patterns, plan_analysis, plan_rows, rules, score, statements
from sqlloom.sources.once import once
from sqlloom.sources.scratch import written
from sqlloom.sources.tables import spread


def analyze(submissions: DataFrame, replies: DataFrame | None = None, settings: Settings = Settings()) -> dict[str, DataFrame]:
    """Results of the requests, by name; nothing is computed but the parsed statements and their findings, which are written once.

    ``requests`` (with ``error_code``), ``statements``, ``findings``, ``rule_rows``, ``compliance``,
    ``scores``, ``rewrites``, ``patterns``, ``evidence``, ``packed``, ``plans``, ``plan_steps``,
    ``plan_observations``, ``plan_contexts``, and with ``replies`` (submission_id, finish_reason,
    reply_json, replied_at) also ``replies``, ``outcomes`` and ``potential``. Requests that are not
    valid, but for their cost, have no results beyond ``requests``.
    """
    every = rules.requests(submissions)
    request = every.where("error_code IS NULL OR error_code = 'bad_cost'")
    stmts = written(statements.statements(spread(submissions.select("submission_id", "sql"))))
    found = written(rules.findings(stmts, request, settings))
    rows = rules.rule_rows(request, stmts, found, settings)
    matched = patterns.matches(stmts, found, settings)
    out = {
        "requests": every, "statements": stmts, "findings": found, "rule_rows": rows, "compliance": rules.compliance(rows), "scores": score.scores(request, stmts, found, settings),
        "rewrites": stmts.select("submission_id", F.col("idx").alias("statement_index"), F.inline("rewrites")).dropDuplicates(), "patterns": matched, "evidence": patterns.evidence(matched, stmts), "packed": patterns.packed(matched),
    }
    plans = spread(submissions.where("plan_text IS NOT NULL").select("submission_id", "plan_text"))
    steps = written(plan_analysis.with_predicates(plan_rows.plan_steps(plans, "submission_id"), plan_analysis.predicates(plans, "submission_id")))
    measured = plan_analysis.metrics(once(plans, "submission_id"), "submission_id")
    with_cost = plans.select("submission_id").join(request.select("submission_id", F.col("cost").alias("expected_cost")), "submission_id", "left")
    plan = plan_analysis.plans(with_cost, steps, measured, "submission_id")
    substr = stmts.where(F.exists("rewrites", lambda r: r["rule"] == "substr_eq_to_like")).select(F.col("submission_id").alias("key")).dropDuplicates()
    noted = plan_analysis.observations(steps, plan, substr)
    tables = stmts.select(F.col("submission_id").alias("key"), F.explode("tables").alias("table_name")).dropDuplicates()
    out |= {"plans": plan, "plan_steps": steps, "plan_observations": noted, "plan_contexts": plan_analysis.contexts(plan, steps, tables, noted, measured)}
    if replies is not None:
        judged = guards.replies(replies)
        told = written(outcomes.judged(reply_rows(stmts, found, request, replies, judged, settings)))
        out |= {"replies": judged, "outcomes": told, "potential": guards.potential(told, found)}
    return out


def reply_rows(stmts: DataFrame, found: DataFrame, request: DataFrame, replies: DataFrame, judged: DataFrame, settings: Settings = Settings()) -> DataFrame:
    """Valid replies beside the statement they are about, as ``outcomes.judged`` takes them."""
    chosen = guards.representative(stmts, found)
    mine = stmts.withColumn("gate", guards.gate(settings)).join(chosen, ["submission_id", "idx"]).select("submission_id", "raw_sql", (F.col("statement_type") == "PLSQL").alias("is_block"), "gate")
    good = judged.where("status = 'ok'").select("submission_id", "h")
    texts = replies.withColumn("h", F.xxhash64("finish_reason", "reply_json")).join(good, ["submission_id", "h"], "left_semi").groupBy("submission_id").agg(F.min("reply_json").alias("reply_json"))
    over = request.select("submission_id", (F.col("cost") >= settings.cost_threshold).alias("cost_blocks"))
    return mine.join(texts, "submission_id").join(over, "submission_id", "left")


def payloads(results: dict[str, DataFrame], settings: Settings = Settings()) -> DataFrame:
    """What a model would see of each request: see ``outcomes.payloads``."""
    stmts, found = results["statements"], results["findings"]
    chosen = guards.representative(stmts, found)
    masked = stmts.join(chosen, ["submission_id", "idx"]).select("submission_id", masking.mask_udf("raw_sql", years=True).alias("m")).select("submission_id", "m.masked_sql", "m.hints")
    plans = results["plan_contexts"].select(F.col("key").alias("submission_id"), F.struct(*[c for c in results["plan_contexts"].columns if c != "key"]).alias("plan"))
    return outcomes.payloads(stmts, found, results["compliance"], results["requests"], results["packed"], masked, chosen, guards.gate(settings), plans)


def extract(texts: DataFrame, key: str, filename: str, text: str) -> DataFrame:
    """SQL found in texts of attachments: see ``operators.detect``; for files see ``sources.attachments``."""
    return detect.detected(spread(texts.select(key, filename, text)), key, filename, text)
