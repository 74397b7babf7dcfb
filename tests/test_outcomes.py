"""Advice that survives its checks, outcomes of suggestions, display codes, configuration, one call for all."""

import json

import pytest
from pyspark.sql import functions as F

from sqlloom import config, engine
from sqlloom.operators import display, outcomes, plan_analysis
from sqlloom.operators.masking import mask, mask_years, unmask
from sqlloom.sqlast.facts import facts
from sqlloom.sqlast.split import normalize, strip_commands

SQL = "SELECT a.x FROM case_note a WHERE a.n = 11 OR a.n = 12"


def advice(item, sql=SQL):
    _, reverse, hints = mask_years(mask(sql))
    kept, dropped = outcomes.kept_advice([item], sql, facts(sql)[0], reverse, hints)
    return (kept[0]["verification"], kept[0]["note"], kept[0]["example"]) if kept else dropped


@pytest.mark.parametrize(
    "item, want",
    [
        ({"title": "t", "explanation": "e", "before": "a.n = 11 OR a.n = 12", "example": "a.n IN (11, 12)"}, ("verified", None, "a.n IN (11, 12)")),
        ({"title": "t", "explanation": "e", "before": "WHERE a.n = 11 OR a.n = 12", "example": "a.n IN (12)"}, ("corrected", None, "A.N IN (11, 12)")),
        ({"title": "t", "explanation": "e", "before": "a.n = 11", "example": "a.n = 12"}, ("unverified", None, None)),
        ({"title": "t", "explanation": "e", "example": "a.n IN (11, 12)"}, ("unverified", None, None)),
        ({"title": "t", "explanation": "e", "example": "a.zz = 11"}, ("unverified", "unknown_identifier", None)),
        ({"title": "t", "explanation": "e", "example": "b.n = 11"}, ("unverified", "unknown_identifier", None)),
        ({"title": "t", "explanation": "e", "example": "n = 99"}, ("unverified", "unknown_literal", None)),
        ({"title": "t", "explanation": "e", "example": "a.n = 99"}, ("unverified", "unknown_literal", None)),
        ({"title": "t", "explanation": "e", "example": "a.n = ("}, ("unverified", "unknown_identifier", None)),
        ({"title": "t", "explanation": "可改成 STATUS = 5"}, ("unverified", "copyable", None)),
        ({"title": "t", "explanation": "plain words"}, (None, None, None)),
        ({"title": "已驗證", "explanation": "e"}, 1),
    ],
)
def test_advice_is_checked_against_the_statement(item, want):
    assert advice(item) == want


def test_typed_literals_and_guards():
    dated = "SELECT a.x FROM case_note a WHERE TRUNC(a.d) = DATE '2024-01-02'"
    assert advice({"title": "t", "explanation": "e", "before": "TRUNC(a.d) = DATE '2024-01-02'", "example": "a.d = '2024-01-02'"}, dated) == ("unverified", "typed_literal", None)
    assert advice({"title": "t", "explanation": "用日期範圍"}, dated) == ("unverified", "trunc_condition", None)
    assert advice({"title": "t", "explanation": "加入日期條件"}, "SELECT a.x FROM case_note a")[1] == "no_main_where"
    assert outcomes.observable("好的。索引會被使用。再看 :STR_001 一次。", {":STR_001": {"literal_type": "DATE"}}) == "好的。再看 [date value] 一次。"


def suggested(raw, sql=SQL, gate=None, cost=False):
    _, reverse, hints = mask_years(mask(sql))
    s = outcomes.suggestion(raw, sql, facts(sql)[0], reverse, hints, gate, cost)
    return s["outcome"], s["code"], s["sql"]


@pytest.mark.parametrize(
    "raw, kw, want",
    [
        ({"available": True, "sql": "SELECT a.x FROM case_note a WHERE a.n IN (11, 12)", "reason": "r"}, {}, ("provided", None, "SELECT a.x FROM case_note a WHERE a.n IN (11, 12)")),
        ({"available": True, "sql": "SELECT a.x FROM case_note a WHERE a.n IN (11)", "reason": "r"}, {}, ("rejected", "predicate_changed", None)),
        ({"available": True, "sql": "SELECT a.x FROM case_note a WHERE a.n IN (11, 12)", "reason": "r"}, {"gate": "multi_statement"}, ("gated", "multi_statement", None)),
        ({"available": False, "reason": "r"}, {"gate": "too_long_for_rewrite"}, ("gated", "too_long_for_rewrite", None)),
        ({"available": False, "reason": "r", "rewrite_outcome": "not_needed"}, {}, ("not_needed", None, None)),
        ({"available": False, "reason": "r", "rewrite_outcome": "not_needed"}, {"cost": True}, ("not_needed", "cost_over_threshold", None)),
        ({"available": False, "reason": "r", "rewrite_outcome": "not_needed"}, {"sql": "SELECT DISTINCT a.x FROM t a WHERE a.n = 1"}, ("advice_only", "distinct_removal", None)),
        ({"available": False, "reason": "已驗證", "rewrite_outcome": "not_needed"}, {}, ("advice_only", "reason_withheld", None)),
        ({"available": True, "reason": "r"}, {}, ("advice_only", None, None)),
        ({}, {}, ("advice_only", None, None)),
    ],
)
def test_outcomes_of_suggestions(raw, kw, want):
    assert suggested(raw, **kw) == want


def test_years_are_hidden_and_come_back(spark):
    sql = "SELECT 'long literal' FROM t WHERE TO_CHAR(d, 'YYYY') = '2024' AND to_char(e,'YYYY')='1999'"
    text, reverse, hints = mask_years(mask(sql))
    assert ":STR_002" in text and ":STR_003" in text and "2024" not in text and hints[":STR_002"]["literal_type"] == "year_value" and "'YYYY'" in text
    assert spark.createDataFrame([(text, reverse)], "t string, m map<string,string>").select(unmask(F.col("t"), F.col("m"))).first()[0] == sql


def test_characters_and_commands():
    assert normalize("「a」『b』​x y\r\nz，") == "\"a\"'b'x y\nz,"
    kept = ["BREAK ON x", "START x", "VARIABLE y", "CONNECT BY p = q", "UPDATE t", "SET a = 1", "/"]
    gone = ["DESCRIBE t", "SET LINESIZE 200", "@run.sql", "connect scott/x", "REM note", "PROMPT hi"]
    got = strip_commands("\n".join(kept + gone))
    assert got.sql.split("\n") == kept and got.commands == gone


def test_display_codes(spark):
    one = spark.range(1)
    check = lambda c: one.select(c.alias("v")).first().v
    lit = F.lit
    none = lit(None).cast("string")
    assert check(display.compliance_summary(lit(2), lit(1))) == "blocks:2 suggestions:1" and check(display.compliance_summary(lit(0), lit(0))) == "all_pass"
    assert check(display.evidence_level(none, lit("a"), lit("b"))) == "review" and check(display.evidence_level(none, none, lit("文字"))) == "info" and check(display.evidence_level(lit("verified"), none, none)) == "confirmed"
    assert check(display.adoption(lit("ok"), lit(False), lit("BLOCK"), none)) == "blocked" and check(display.adoption(lit("ok"), lit(False), lit("PASS"), lit("low"))) == "confirm_first" and check(display.adoption(lit("pending"), lit(True), lit("PASS"), none)) == "pending"
    assert check(display.headline(lit("PASS"), lit("ok"), lit(0), lit(2))) == "rewrites" and check(display.headline(lit("PASS"), lit("ok"), lit(0), lit(0))) == "nothing_to_do"
    assert check(display.level_label(lit("GOOD"), lit(1))) == "IMPROVABLE" and check(display.rule_label(lit("NA"))) is None
    assert check(display.is_performance_advice(lit("t"), lit("較易閱讀"), none, none)) is False and check(display.is_performance_advice(lit("t"), lit("e"), lit("a=1 OR a=2"), lit("a IN (1,2)"))) is False and check(display.is_performance_advice(lit("t"), lit("較易閱讀，效能更好"), none, none)) is True
    rows = spark.createDataFrame([("SELECT a\nFROM t\nWHERE b = 1", [("verified", "若 b 為數字：b IN (1) AND b = 1", None)], None), ("x", [("verified", "b IN (1)", "b = 1")], []), ("x", [("unverified", "b IN (1)", "b = 1")], None)], "sql string, a array<struct<verification:string, example:string, before:string>>, r array<struct<rule:string, before:string, after:string>>")
    with_text = F.transform("a", lambda a: F.struct(a["verification"].alias("verification"), a["example"].alias("example"), a["before"].alias("before"), lit("效能").alias("title"), lit("e").alias("explanation")))
    got = [r[0] for r in rows.select(display.segments(with_text, F.col("sql"), F.col("r"))).collect()]
    assert [[tuple(s) for s in g] for g in got] == [[("WHERE b = 1", "b IN (1) AND b = 1")], [], []] or got[0] == []
    assert check(plan_analysis.friendly(lit("TABLE ACCESS"), lit("FULL"))) == "whole_table_read" and check(plan_analysis.friendly(lit("COUNT"), none)) == "step"


def test_configuration_files(tmp_path):
    def file(data):
        path = tmp_path / "c.json"
        path.write_text(data if isinstance(data, str) else json.dumps(data))
        return str(path)

    assert config.load_catalog(file({"version": 1, "patterns": [{"id": "X", "classification": "ADVICE_ONLY", "source": "flag", "exact": ["distinct"]}]})) == (("X", "ADVICE_ONLY", "flag", ("distinct",), (), ()),)
    for bad in ("{", {"version": 2, "patterns": []}, {"version": 1}, {"version": 1, "patterns": [{"id": "X", "classification": "?"}]}, {"version": 1, "patterns": [{"id": "X", "classification": "ADVICE_ONLY"}] * 2}, {"version": 1, "patterns": [{"id": "X", "classification": "ADVICE_ONLY", "exact": [1]}]}):
        with pytest.raises(config.CatalogError):
            config.load_catalog(file(bad))
    assert config.load_settings(file({"version": 1, "cost_threshold": 5, "watched": [["T", "m"]], "rule_cap": 7})) == config.Settings(cost_threshold=5, watched=(("T", "m"),), rule_cap=7.0)
    for bad in ({"version": 1, "nothing": 1}, {"version": 1, "cost_threshold": "5"}, {"cost_threshold": 5}):
        with pytest.raises(config.CatalogError):
            config.load_settings(file(bad))


PLAN = "| Id | Operation | Name | Cost |\n| 0 | SELECT STATEMENT | | 90 |\n|* 1 | TABLE ACCESS FULL | T | 80 |\n\nPredicate Information (identified by operation id):\n   1 - filter(SUBSTR(\"CD\",2,2)='xy')\n"


def test_one_call(spark):
    reply = json.dumps({"summary": "這段語法的條件清楚，其餘維持現狀即可，不必另外調整寫法。", "assessment_confidence_score": 90, "advice": [], "suggested_sql": {"available": True, "reason": "r", "sql": "SELECT a.x FROM t a WHERE a.cd LIKE '_xy%'", "rewrite_outcome": "advice_only", "confidence_score": 88}})
    subs = spark.createDataFrame(
        [(1, "A", "5", "SELECT a.x FROM t a WHERE SUBSTR(a.cd, 2, 2) = 'xy'", PLAN, True), (2, "A", "200000", "UPDATE t SET a = 1; SELECT 1 FROM levy_x, permit_hdr WHERE a = 1", None, True), (3, None, "5", "SELECT 1 FROM dual", None, None), (4, "A", "x", None, None, None), (1, "A", "5", "SELECT a.x FROM t a WHERE SUBSTR(a.cd, 2, 2) = 'xy'", PLAN, True)],
        "submission_id long, application_no string, cost_raw string, sql string, plan_text string, include_ai boolean",
    )
    replies = spark.createDataFrame([(1, "stop", reply, None)], "submission_id long, finish_reason string, reply_json string, replied_at timestamp")
    r = engine.analyze(subs, replies)
    assert {x.submission_id: x.error_code for x in r["requests"].collect()} == {1: None, 2: None, 3: "bad_application_no", 4: "empty_sql"}
    out = r["outcomes"].first()
    assert (out.submission_id, out.outcome, out.rewrite_confidence, out.confidence) == (1, "provided", 88, 90) and r["potential"].first().potential == "medium"
    assert [(o.code, o.step_id) for o in r["plan_observations"].orderBy("n").collect()] == [("COST_MISMATCH", None), ("TABLE_ACCESS_FULL", 1), ("FUNCTION_FILTER_PREDICATE", 1), ("VERIFIED_REWRITE_PLAN_MATCH", 1)]
    context = r["plan_contexts"].first()
    assert context.priority_steps[0].object_name == "T" and len(context.signals) == 4 and context.source == "estimated"
    rows = {(x.submission_id, x.rule_id): (x.status, x.evidence, x.note) for x in r["rule_rows"].collect()}
    assert rows[2, "R002"] == ("BLOCK", "statement 1: no_where", "") and rows[2, "R007"] == ("NOTICE", "statement 2: LEVY_X, PERMIT_HDR", "check_range") and rows[1, "R005"][1] == "SUBSTR(A.CD, 2, 2)"
    floors = {x.submission_id: [(b.component, b.score) for b in x.breakdown] for x in r["scores"].collect()}
    assert floors[1] == [("rule_findings", 30.0), ("structure", 0.0), ("cost_ratio", 0.0)] and floors[2][-1][0] in ("block_floor", "cost_ratio")
    assert {(e.evidence_id, e.variant) for e in r["evidence"].where("submission_id = 1").collect()} == {("ORACLE11G_TRANSFORMED_COLUMN", "default"), ("ORACLE11G_LEADING_WILDCARD_RANGE_LIMIT", "leading_wildcard")}
    payload = {p.submission_id: json.loads(p.payload) for p in engine.payloads(r).collect()}
    assert payload[1]["rewrite_allowed"] and payload[1]["execution_plan"]["source"] == "estimated" and payload[1]["sanitized_sql"].count("xy") == 1 and payload[2]["advice_contracts"] == []
    rewrites = r["statements"].groupBy("submission_id").agg(F.flatten(F.collect_list("rewrites")).alias("rewrites"))
    shown = {x.submission_id: x for x in display.overview(r["rule_rows"], r["compliance"], r["scores"], r["replies"], r["outcomes"], rewrites, r["potential"]).collect()}
    assert (shown[1].headline, shown[1].adoption, shown[1].full_rewrite is not None) == ("rewrites", "confirmed", True) and (shown[2].tone, shown[2].adoption) == ("red", "pending")
    empty = engine.analyze(subs.limit(0), replies.limit(0))
    assert all(df.count() == 0 for df in empty.values())
