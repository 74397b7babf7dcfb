import io
import zipfile

import pytest
from pyspark.sql import functions as F

from sqlloom.config import Settings
from sqlloom.functions import text as T
from sqlloom.operators import detect, diff, guards, masking, patterns, plan_analysis, plan_rows, rules, score, statements
from sqlloom.sources import archive, attachments

SUB = "submission_id long, application_no string, cost_raw string, sql string, plan_text string, include_ai boolean, submitted_at timestamp"


def subs(spark, *rows):
    full = [(i, "A", c, q, None, None, None) for i, (c, q) in enumerate(rows)]
    return spark.createDataFrame(full, SUB)


def analysed(spark, *rows, settings=Settings()):
    df = subs(spark, *rows)
    req = rules.requests(df)
    s = statements.statements(df)
    f = rules.findings(s, req, settings)
    return req, s, f


def test_costs(spark):
    texts = ["68420", "68,420", " 1 000 ", "-5", "1.5", "abc", "", None, "1_000", "٣", "9" * 30]
    df = spark.createDataFrame([(t,) for t in texts], "c string")
    assert [r[0] for r in df.select(rules.cost(F.col("c"))).collect()] == [68420, 68420, 1000, None, None, None, None, None, None, None, None]


def test_rejected_requests(spark):
    df = spark.createDataFrame([(1, "A", "5", "SELECT 1 FROM t", None, None, None), (2, " ", "5", "x", None, None, None), (3, "A", "5", "  ", None, None, None), (4, "A", "n/a", "x", None, None, None), (1, "A", "5", "SELECT 1 FROM t", None, None, None)], SUB)
    assert {r.submission_id: r.error_code for r in rules.requests(df).collect()} == {1: None, 2: "bad_application_no", 3: "empty_sql", 4: "bad_cost"}


def test_rules_and_score(spark):
    req, s, f = analysed(spark, ("99999", "SELECT a FROM t WHERE b = 1"), ("100000", "SELECT a FROM t WHERE b = 1"), ("1", "SELECT a FROM t"), ("1", "SELECT x FROM a, b WHERE a.i = 1"), ("1", "SELECT a FROM t JOIN u ON t.i = u.i"), ("1", "garbage in"), ("1", "-- nothing"))
    verdict = {r.submission_id: r.status for r in rules.compliance(rules.rule_rows(req, s, f)).collect()}
    assert verdict == {0: "PASS", 1: "BLOCK", 2: "BLOCK", 3: "PASS", 4: "REVIEW", 5: "REVIEW", 6: "PASS"}
    points = {r.submission_id: (r.score, r.level) for r in score.scores(req, s, f).collect()}
    assert points[0] == (14, "GOOD") and points[1] == (80, "PRIORITY") and points[2] == (80, "PRIORITY") and points[3] == (60, "IMPROVE")


def test_score_grows_with_findings_and_is_capped(spark):
    likes = [" AND ".join([f"c{i} LIKE '%x{i}'" for i in range(n)]) for n in (1, 2, 3, 8, 30)]
    req, s, f = analysed(spark, *[("1", f"SELECT a FROM t WHERE {c}") for c in likes])
    points = [r.rule_score for r in score.scores(req, s, f).orderBy("submission_id").collect()]
    assert points == sorted(points) and points[0] == 25 and points[1] == 37.5 and max(points) <= 70


def test_half_points_round_to_even(spark):
    req, s, f = analysed(spark, ("1", "SELECT a FROM t WHERE c1 LIKE '%x' AND c2 LIKE '%y'"))
    assert score.scores(req, s, f).first().score == 38


def test_disabled_rules_and_forbidden_tables(spark):
    settings = Settings(disabled=frozenset(("R006",)), forbidden=(("SECRET_*", ("DELETE",)),))
    req, s, f = analysed(spark, ("1", "DELETE FROM secret_x WHERE a = 1 OR b = 2"), ("1", "SELECT a FROM secret_x WHERE a = 1"), settings=settings)
    assert [(r.submission_id, r.rule_id) for r in f.collect()] == [(0, "R008")]
    assert {r.status for r in rules.rule_rows(req, s, f, settings).where("rule_id = 'R006'").collect()} == {"NA"}


def test_patterns_and_packing(spark):
    _, s, f = analysed(spark, ("1", "SELECT DISTINCT * FROM a WHERE x = 1 OR x = 2"))
    m = patterns.matches(s, f)
    kinds = {r.pattern_id: r.match_kind for r in m.collect()}
    assert kinds["OR_SAME_COLUMN_TO_IN"] == "exact" and kinds["OR_CROSS_COLUMN_TO_UNION_ALL"] == "family" and kinds["DISTINCT_REMOVAL"] == "exact"
    whole = patterns.packed(m, chars=6000).first()
    assert whole.patterns == ["OR_SAME_COLUMN_TO_IN", "DISTINCT_REMOVAL", "SELECT_STAR"] and patterns.packed(m, items=1).first().patterns == whole.patterns[:1] and patterns.packed(m, items=0).first().patterns == []
    less = patterns.packed(m, chars=whole.chars - 1).first()  # one that is too big uses nothing up
    assert less.patterns == whole.patterns[:2] and patterns.packed(m, chars=0).first().patterns == []


def test_empty_tables(spark):
    req, s, f = analysed(spark)
    assert s.count() == f.count() == score.scores(req, s, f).count() == rules.compliance(rules.rule_rows(req, s, f)).count() == patterns.matches(s, f).count() == 0


def test_plan_analysis(spark):
    text = "Plan hash value: 1\n-----\n| Id | Operation | Name | Starts | E-Rows | A-Rows | Cost |\n-----\n| 0 | SELECT STATEMENT | | 1 | 1 | 1 | 90 |\n|* 1 | TABLE ACCESS FULL | T | 2 | 10 | 4000 | 80 |\n|* 2 | HASH JOIN | | 1 | 0 | 5 | 70 |\n-----\n\nPredicate Information (identified by operation id):\n-----\n   1 - filter(SUBSTR(\"A\",1,2)='x' AND\n       \"B\"=1)\n   2 - access(\"C\"=\"D\")\n\nStatistics\n-----\n    1,018  consistent gets\n   7  consistent gets\n   3  unknown things\n"
    df = spark.createDataFrame([(1, text, 90), (2, "nothing", 5), (3, None, None)], "plan_id long, plan_text string, expected_cost long")
    steps = plan_analysis.with_predicates(plan_rows.plan_steps(df), plan_analysis.predicates(df))
    m = plan_analysis.metrics(df)
    plan = plan_analysis.plans(df, steps, m)
    assert [(r.key, r.recognized, r.source, r.root_cost, r.cost_matches) for r in plan.orderBy("key").collect()] == [(1, True, "actual", 90, True), (2, False, None, None, None), (3, False, None, None, None)]
    assert [(r.metric, r.value) for r in m.collect()] == [("consistent_gets", 1018)]
    assert {(r.code, r.step_id, r.detail) for r in plan_analysis.observations(steps, plan).collect()} == {("TABLE_ACCESS_FULL", 1, "T"), ("FUNCTION_FILTER_PREDICATE", 1, "SUBSTR"), ("CARDINALITY_GAP", 1, "200"), ("CARDINALITY_GAP", 2, "inf")}
    keys = spark.createDataFrame([(1,)], "key long")
    assert plan_analysis.rewrite_matches(steps, keys).first().step_id == 1
    top = plan_analysis.summary(steps, spark.createDataFrame([(1, "t")], "key long, table_name string")).orderBy("rank").collect()
    assert [(r.operation, r.object_name, r.functions) for r in top] == [("TABLE_ACCESS_FULL", "T", "SUBSTR"), ("HASH_JOIN", None, "")]


def test_masking(spark):
    text, back, hints = masking.mask("SELECT 'Smith''s' x, 1234567, 12345 FROM t WHERE d = DATE '2024-01-01' AND c = 'AB%' AND n = 'Smith''s' AND b = :123456")
    assert text == "SELECT :STR_001 x, :NUM_001, 12345 FROM t WHERE d = DATE :STR_002 AND c = 'AB%' AND n = :STR_001 AND b = :123456"
    assert hints[":STR_002"]["literal_type"] == "DATE" and back[":STR_001"] == "'Smith''s'"
    assert masking.mask("x = 'open and 1234567")[0] == "x = 'open and :NUM_001"
    df = spark.createDataFrame([(1, "a = 'long literal' AND b = 'another one'"), (2, None)], "submission_id long, sql string")
    m = masking.masked(df).orderBy("submission_id").collect()
    assert m[1].masked_sql is None
    assert masking.masked(df).where("submission_id = 1").select(masking.unmask(F.col("masked_sql"), F.col("reverse_map"))).first()[0] == "a = 'long literal' AND b = 'another one'"
    scrub = spark.createDataFrame([("x = :STR_001 AND y = :STR_009",)], "t string").select(masking.scrub_invented(F.col("t"), F.array(F.lit(":STR_001")))).first()[0]
    assert scrub == "x = :STR_001 AND y = :VALUE"


def test_text_functions(spark):
    df = spark.createDataFrame([("SELECT /*+ PARALLEL(a) */ 1 /* gone */ FROM t -- gone\nWHERE a = 'A123456789' AND m = 'x@y.example' AND n = 12345678",), ("SELECT '/*+ PARALLEL */' FROM t",), (None,)], "s string")
    rows = df.select(T.parallel_hint(F.col("s")), T.deidentify(T.strip_comments(F.col("s"))), T.token_estimate(F.col("s")), T.context_tier(F.lit(20000))).collect()
    assert rows[0][0] == "/*+ PARALLEL(a) */" and rows[1][0] is None and rows[2][0] is None
    assert "gone" not in rows[0][1] and rows[0][1].count("[REDACTED]") == 3 and rows[0][3] == 32768


def test_detection():
    assert detect.detect("a.md", "text\n```sql\nSELECT 1 FROM t;\n```\nmore")[:2] == ("SELECT 1 FROM t;", 1)
    assert detect.detect("a.txt", "Hello,\n\nSELECT a\nFROM t\n\nWHERE b IN (\n\nSELECT c FROM u)\n\nThanks a lot") == ("SELECT a\nFROM t\n\nWHERE b IN (\n\nSELECT c FROM u)", 1, True, True)
    assert detect.detect("a.csv", 'id,sql\n1,"SELECT a, b FROM t"\n2,UPDATE t SET a=1\n')[1] == 2
    assert detect.detect("a.txt", "no statement here")[3] is False and detect.detect("", "")[3] is False
    assert detect.detect("x.sql", "SELECT 1 FROM t; DELETE FROM u;")[1] == 2


def docx(*paragraphs):
    f = io.BytesIO()
    body = "".join(f"<w:p><w:r><w:t>{p}</w:t></w:r></w:p>" for p in paragraphs)
    with zipfile.ZipFile(f, "w") as z:
        z.writestr("word/document.xml", f'<w:document xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main"><w:body>{body}</w:body></w:document>')
    return f.getvalue()


def test_attachments(spark):
    pdf = b"%PDF-1.4\nstream\nBT (SELECT a FROM table_name) Tj ET\nendstream"
    files = [("a.sql", "SELECT 1".encode()), ("b.txt", "﻿中文".encode()), ("c.txt", "查詢".encode("cp950")), ("d.exe", b"MZ"), ("e.sql", b""), ("f.sql", b"MZ123"), ("g.pdf", b"nope"), ("h.docx", docx("SELECT x", " ", "FROM t")), ("i.docx", b"PK\x03\x04broken"), ("j.pdf", pdf)]
    df = spark.createDataFrame(files, "path string, content binary")
    got = {r.path: (r.text, r.error_code) for r in attachments.texts(df).collect()}
    assert got == {"a.sql": ("SELECT 1", None), "b.txt": ("中文", None), "c.txt": ("查詢", None), "d.exe": (None, "bad_extension"), "e.sql": (None, "empty"), "f.sql": (None, "program"), "g.pdf": (None, "not_pdf"), "h.docx": ("SELECT x\nFROM t", None), "i.docx": (None, "corrupt"), "j.pdf": ("SELECT a FROM table_name", None)}


def test_page_furniture(spark):
    pages = spark.createDataFrame([("p", 0, "Title\nSELECT 1\n1"), ("p", 1, "Title\nFROM t\n2"), ("p", 2, "Title\nWHERE x\n- 3 -"), ("q", 0, "Title\n7")], "path string, page int, text string")
    assert {r.path: r.text for r in attachments.without_furniture(pages).collect()} == {"p": "SELECT 1\nFROM t\nWHERE x", "q": "Title\n7"}


def test_replies(spark):
    good = '{"summary": "這段語法的條件清楚，其餘維持現狀即可，不必另外調整寫法。", "assessment_confidence_score": %s, "advice": %s, "suggested_sql": {"available": false, "reason": "無", "rewrite_outcome": "not_needed"}}'
    rows = [(1, "stop", good % (41, "[]")), (2, "length", good % (41, "[]")), (3, "stop", '{"summary'), (4, "stop", None), (5, "stop", good % ("true", "[]")), (6, "stop", good % ('"41"', "[]")), (7, "stop", good % (101, "[]")), (8, "stop", good % (5, "[1,2,3,4]")), (9, "stop", '{"summary": "short", "assessment_confidence_score": 1, "advice": []}'), (10, "stop", '{"summary": "long enough but in another language", "assessment_confidence_score": 1, "advice": []}')]
    item = '[{"title": "a", "explanation": "b", "confidence_score": %s}]'
    rows += [(11, "stop", good % (5, item % 7)), (12, "stop", good % (5, item % '"7"')), (13, "stop", good % (5, item % "7.0")), (14, "stop", good % (5, '{"a": 1}')), (15, "stop", (good % (5, "[]")).replace("not_needed", "done")), (16, "stop", (good % (5, "[]")).replace('"advice": [], ', ""))]
    df = spark.createDataFrame([(*r, None) for r in rows] + [(*rows[0], None)], "submission_id long, finish_reason string, reply_json string, replied_at timestamp")
    got = {r.submission_id: r.failure for r in guards.replies(df).collect()}
    assert got == {1: None, 2: "truncated", 3: "bad_json", 4: "no_reply", 5: "bad_confidence", 6: "bad_confidence", 7: "bad_confidence", 8: "too_much_advice", 9: "no_suggestion", 10: "wrong_language", 11: None, 12: "bad_advice", 13: "bad_advice", 14: "bad_advice", 15: "bad_outcome", 16: None}


def test_advice(spark):
    j = '{"advice": [{"title": "優化字段", "explanation": "已驗證", "example": "", "confidence_score": 5}, {"title": "b", "explanation": "c", "example": "d", "confidence_score": "x"}]}'
    df = spark.createDataFrame([(1, j), (1, j), (2, None), (3, "[")], "submission_id long, reply_json string")
    assert [(r.pos, r.title, r.confidence, r.dropped) for r in guards.advice(df).orderBy("pos").collect()] == [(0, "改善欄位", 5, True), (1, "b", None, False)]


def test_gate_and_representative(spark):
    _, s, f = analysed(spark, ("1", "SELECT a FROM t WHERE b = 1; DELETE FROM u"), ("1", "SELECT a FROM t WHERE ROWNUM < 5"), ("1", "SELECT a FROM t WHERE b = 1"))
    assert {(r.submission_id, r.g) for r in s.select("submission_id", guards.gate().alias("g")).collect()} == {(0, "multi_statement"), (1, "complexity:rownum"), (2, None)}
    assert {r.submission_id: r.idx for r in guards.representative(s, f).collect()} == {0: 1, 1: 0, 2: 0}


def test_diff(spark):
    assert diff.line_tags("a\nb\nc", "a\nx\nc\nd") == [("same", 1, 1), ("changed", 2, 2), ("same", 3, 3), ("added", None, 4)]
    assert diff.word_diff("SELECT a", "select b") == [("same", "select "), ("removed", "a"), ("added", "b")]
    df = spark.createDataFrame([("SELECT a\nFROM t\nWHERE b = 1", "where b like 1"), ("x", "y"), (None, "z")], "t string, f string")
    assert [r[0] for r in df.select(diff.best_line(F.col("t"), F.col("f"))).collect()] == [3, None, None]


def test_archive_and_stream(spark, tmp_path):
    import datetime as dt

    rows = [(1, "A", "5", "SELECT a FROM t WHERE n = 'Jane Roe'", None, None, dt.datetime(2025, 1, 31, 20)), (2, "A", "200000", "SELECT /*+ PARALLEL */ a FROM t", None, None, None)]
    df = spark.createDataFrame(rows, SUB)
    req, s = rules.requests(df), statements.statements(df)
    f = rules.findings(s, req)
    rec = archive.records(df, s, rules.compliance(rules.rule_rows(req, s, f)), score.scores(req, s, f))
    archive.append(rec, str(tmp_path / "a"))
    back = spark.read.json(str(tmp_path / "a"))
    assert {r.month for r in back.collect()} == {"2025-02", "unknown"} and "application_no" not in back.columns and back.where("sql LIKE '%Jane%'").count() == 0
    from sqlloom.streaming import pipeline

    df.withColumn("received_at", F.lit(dt.datetime(2025, 2, 1))).union(df.withColumn("received_at", F.lit(dt.datetime(2025, 2, 1)))).write.parquet(str(tmp_path / "in"))
    q = pipeline.start(pipeline.screened(pipeline.read(spark, str(tmp_path / "in"))), str(tmp_path / "out"), str(tmp_path / "cp"))
    q.awaitTermination(120)
    assert {r.submission_id: r.status for r in spark.read.parquet(str(tmp_path / "out")).collect()} == {1: "PASS", 2: "BLOCK"}


def test_wide_rows_with_clashing_names(spark):
    df = spark.createDataFrame([(1, "A", "1", "SELECT a FROM t", None, None, None, "k", "t", "idx")], SUB + ", key string, text string, idx string")
    assert statements.statements(df).count() == 1 and masking.masked(df).count() == 1 and rules.requests(df).count() == 1



@pytest.mark.parametrize(
    "a, b, why",
    [("SELECT x FROM t WHERE a = 1 OR a = 2", "SELECT x FROM t WHERE a IN (1, 2)", None), ("SELECT x FROM t WHERE a = 1", "select x from t where a = 1", "identical"), ("SELECT x FROM t WHERE a = 1", "SELECT x FROM u WHERE a = 1", "tables"),
     ("SELECT x FROM t WHERE a = 1", "SELECT DISTINCT x FROM t WHERE a = 1", "structure:distinct"), ("SELECT x FROM t WHERE a = 1", "SELECT x, y FROM t WHERE a = 1", "signature:select_count"), ("SELECT x FROM t WHERE a = 1", "SELECT x FROM t", "where"),
     ("SELECT x FROM t WHERE a = 1", "SELECT y FROM t WHERE a = 1", "skeleton"), ("SELECT x FROM t WHERE a = 1 AND b = 2", "SELECT x FROM t WHERE a = 1", "predicate_lost"), ("SELECT x FROM t WHERE a = 1", "SELECT x FROM t WHERE a = 1 AND b = 2", "predicate_added"),
     ("SELECT x FROM t WHERE a = 1", "SELECT x FROM t WHERE", "unreadable"), ("SELECT x FROM t WHERE a = 1", None, "missing"), ("SELECT x FROM t WHERE ROWNUM < 2", "SELECT x FROM t WHERE 2 > ROWNUM", "rownum")],
)
def test_revalidation(a, b, why):
    from sqlloom.operators.revalidate import reason

    assert reason(a, b) == why


if __name__ == "__main__":
    pytest.main([__file__])
