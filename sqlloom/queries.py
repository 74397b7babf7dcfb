"""The registered queries of the core and their SQL."""

from __future__ import annotations

import json
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sqlloom import corpus
from sqlloom.config import GUIDANCE, PATTERNS
from sqlloom.functions import text as T
from sqlloom.operators import detect, diff, guards, masking, patterns, plan_analysis, plan_rows, revalidate, rules, score, statements
from sqlloom.sources import archive
from sqlloom.sources.scratch import written
from sqlloom.sources.tables import spread, table
from sqlloom.sqlast import rewrites

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def query(oracle: str | None = None) -> Callable:
    def register(f: Callable[[SparkSession, str], DataFrame]) -> Callable:
        QUERIES[f.__name__] = f
        if oracle:
            ORACLE[f.__name__] = oracle
        return f

    return register


@query()
def p1_found(spark: SparkSession, folder: str) -> DataFrame:
    """Rows of plan grids that fail to parse."""
    plans = spread(table(spark, folder, "plan_extracts").select("plan_id", "plan_text"))
    return plan_rows.plan_rejects(plans).select(F.col("key").alias("plan_id"), "line_no")


@query()
def p1_rejects(spark: SparkSession, folder: str) -> DataFrame:
    """Failing rows with layout, reason and raw text."""
    plans = spread(table(spark, folder, "plan_extracts").select("plan_id", "plan_text"))
    return plan_rows.plan_rejects(plans).withColumnRenamed("key", "plan_id")


@query()
def p1_steps(spark: SparkSession, folder: str) -> DataFrame:
    """The valid rows as typed plan steps."""
    plans = spread(table(spark, folder, "plan_extracts").select("plan_id", "plan_text"))
    return plan_rows.plan_steps(plans).withColumnRenamed("key", "plan_id")


# --- statements, rules and scores over the generated corpus -----------------------------------


def _corpus(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Requests, statements (parsed once and written) and findings."""
    rows = corpus.submissions(table(spark, folder, "orders"))
    req = rules.requests(rows)
    stmts = written(statements.statements(spread(rows.select("submission_id", "sql"))))
    return req, stmts, rules.findings(stmts, req)


_E = "WITH " + corpus.expected_cte() + " "
_WHERE = "CASE WHEN NOT applicable THEN 'na' WHEN has_where THEN 'pass' WHEN has_where IS NULL THEN 'review' WHEN restriction IS NULL THEN 'block' WHEN restriction = 'source_where' THEN 'pass' ELSE 'review' END"


@query(_E + f"""SELECT submission_id, kind AS statement_type, CASE WHEN ok THEN 'ok' ELSE 'failed' END AS parse_status, tables, applicable AS where_applicable, has_where, restriction AS restriction_kind,
 ors AS or_count, CAST(likes AS INTEGER) AS n_likes, functions, flags, hint AS has_hint FROM e""")
def a_facts(spark: SparkSession, folder: str) -> DataFrame:
    """Statement facts (A1-A14) of the corpus."""
    _, s, _ = _corpus(spark, folder)
    joined = lambda c, sep: F.array_join(F.array_sort(c), sep)
    return s.select(
        "submission_id", "statement_type", "parse_status", F.when(F.col("parse_status") == "ok", joined("tables", ",")).otherwise("").alias("tables"), "where_applicable", "has_where", "restriction_kind",
        "or_count", F.size("like_hits").alias("n_likes"), joined("function_hits", ";").alias("functions"), joined("flags", ",").alias("flags"), F.col("hint").isNotNull().alias("has_hint"),
    )


@query(corpus.expected_flags())
def a_flags(spark: SparkSession, folder: str) -> DataFrame:
    """Flags (A12-A14) of statements that tell top level from nested and queries from changes, and the structure score."""
    rows = corpus.submissions(table(spark, folder, "orders"), corpus.FLAG_TEMPLATES)
    s = statements.statements(spread(rows.select("submission_id", "sql")))
    return s.select("submission_id", F.array_join(F.array_sort("flags"), ",").alias("flags"), score.structure().alias("structure_score"))


@query(_E + """, w AS (SELECT submission_id, CAST(unnest(string_split(tables, ',')) AS VARCHAR) AS tb FROM e WHERE ok)
SELECT submission_id, 'R001' AS rule_id, 'BLOCK' AS status, CAST(1 AS BIGINT) AS n FROM e WHERE cost >= 100000
UNION ALL SELECT submission_id, 'R002', upper(v), 1 FROM (SELECT submission_id, has_where, """ + _WHERE + """ AS v FROM e) WHERE v = 'block' OR v = 'review' AND has_where IS NOT NULL
UNION ALL SELECT submission_id, 'R003', 'BLOCK', 1 FROM e WHERE hint
UNION ALL SELECT submission_id, 'R004', 'NOTICE', likes FROM e WHERE likes > 0
UNION ALL SELECT submission_id, 'R005', 'NOTICE', nf FROM e WHERE nf > 0
UNION ALL SELECT submission_id, 'R006', 'NOTICE', 1 FROM e WHERE ors > 0
UNION ALL SELECT submission_id, 'R007', 'NOTICE', count(*) FROM w WHERE tb = 'PERMIT_HDR' OR tb LIKE 'LEVY\\_%' ESCAPE '\\' GROUP BY submission_id""")
def r_findings(spark: SparkSession, folder: str) -> DataFrame:
    """Findings (R001-R007) by rule."""
    _, _, f = _corpus(spark, folder)
    return f.groupBy("submission_id", "rule_id", "status").agg(F.count("*").alias("n"))


@query(_E + """, w AS (SELECT submission_id, CAST(unnest(string_split(tables, ',')) AS VARCHAR) AS tb FROM e WHERE ok),
w7 AS (SELECT DISTINCT submission_id FROM w WHERE tb = 'PERMIT_HDR' OR tb LIKE 'LEVY\\_%' ESCAPE '\\'),
v AS (SELECT e.*, """ + _WHERE + """ AS v, w7.submission_id IS NOT NULL AS watched FROM e LEFT JOIN w7 USING (submission_id))
SELECT submission_id, CASE WHEN cost >= 100000 OR v = 'block' OR hint THEN 'BLOCK' WHEN v = 'review' THEN 'REVIEW' ELSE 'PASS' END AS status,
CAST((cost >= 100000)::INT + (v = 'block')::INT + hint::INT AS BIGINT) AS block_count, CAST((likes > 0)::INT + (nf > 0)::INT + (ors > 0)::INT + watched::INT AS BIGINT) AS notice_count FROM v""")
def r10_compliance(spark: SparkSession, folder: str) -> DataFrame:
    """Compliance of each request (R10) from its rule rows."""
    req, s, f = _corpus(spark, folder)
    return rules.compliance(rules.rule_rows(req, s, f))


@query(_E + """, w AS (SELECT submission_id, CAST(unnest(string_split(tables, ',')) AS VARCHAR) AS tb FROM e WHERE ok),
w7 AS (SELECT submission_id, count(*) AS n7 FROM w WHERE tb = 'PERMIT_HDR' OR tb LIKE 'LEVY\\_%' ESCAPE '\\' GROUP BY submission_id),
v AS (SELECT e.*, """ + _WHERE + """ AS v, coalesce(n7, 0) AS n7 FROM e LEFT JOIN w7 USING (submission_id)),
p AS (SELECT *, (v = 'block' OR v = 'review' AND has_where IS NOT NULL)::INT * 35 + hint::INT * 30 + 25 * (CASE likes WHEN 0 THEN 0 WHEN 1 THEN 1 WHEN 2 THEN 1.5 ELSE 1.5 + 0.25 * (likes - 2) END)
 + 30 * (CASE nf WHEN 0 THEN 0 WHEN 1 THEN 1 ELSE 1.5 END) + (ors > 0)::INT * 15 + 20 * (CASE n7 WHEN 0 THEN 0 WHEN 1 THEN 1 ELSE 1.5 END) AS w, (cost >= 100000)::INT * 35 AS g,
 least(15, contains(flags, 'cartesian_join')::INT * 6 + contains(flags, 'select_star')::INT * 2 + contains(flags, 'distinct_or_union')::INT * 3 + contains(flags, 'not_in_subquery')::INT * 2 + (nt >= 4 AND ok)::INT * 4) AS s,
 CASE WHEN cost <= 25000 THEN 0 WHEN cost <= 50000 THEN 5 WHEN cost <= 75000 THEN 10 WHEN cost <= 100000 THEN 14 ELSE 15 END AS c FROM v),
z AS (SELECT submission_id, greatest(least(100, round_even(least(w + g, 70) + s + c, 0)), contains(flags, 'cartesian_join')::INT * 60, (cost >= 100000 OR v = 'block' OR hint)::INT * 80) AS score FROM p)
SELECT submission_id, CAST(score AS INTEGER) AS score, CASE WHEN score >= 80 THEN 'PRIORITY' WHEN score >= 60 THEN 'IMPROVE' ELSE 'GOOD' END AS level FROM z""")
def c_score(spark: SparkSession, folder: str) -> DataFrame:
    """The review-priority score."""
    req, s, f = _corpus(spark, folder)
    return score.scores(req, s, f).select("submission_id", "score", "level")


@query(_E + "SELECT submission_id, any_rewrite AS rule, replace(replace(rewrites, '@K', CAST(submission_id AS VARCHAR)), '@Q', CAST(cost AS VARCHAR)) AS after FROM e WHERE rewrites <> ''")
def w_rewrites(spark: SparkSession, folder: str) -> DataFrame:
    """Provable rewrites."""
    _, s, _ = _corpus(spark, folder)
    return s.select("submission_id", F.explode("rewrites").alias("r")).select("submission_id", "r.rule", "r.after").dropDuplicates()


_SIGNALS = """, w AS (SELECT submission_id, CAST(unnest(string_split(tables, ',')) AS VARCHAR) AS tb FROM e WHERE ok),
s AS (SELECT submission_id, CAST(unnest(string_split(flags, ',')) AS VARCHAR) AS signal FROM e WHERE flags <> ''
UNION SELECT submission_id, any_rewrite FROM e WHERE any_rewrite <> '' UNION SELECT submission_id, 'many_tables' FROM e WHERE ok AND nt >= 4 UNION SELECT submission_id, 'R004' FROM e WHERE likes > 0
UNION SELECT submission_id, 'R005' FROM e WHERE nf > 0 UNION SELECT submission_id, 'R006' FROM e WHERE ors > 0 UNION SELECT submission_id, 'R007' FROM w WHERE tb = 'PERMIT_HDR' OR tb LIKE 'LEVY\\_%' ESCAPE '\\'),
c(pattern_id, how, signal) AS (VALUES """ + ", ".join(f"('{p[0]}', '{how}', '{x}')" for p in PATTERNS for how, xs in (("exact", p[3]), ("family", p[4])) for x in xs) + ")"


@query(_E + _SIGNALS + """,
h AS (SELECT DISTINCT submission_id, pattern_id, how FROM s JOIN c USING (signal))
SELECT submission_id, pattern_id, how AS match_kind FROM h WHERE how = 'exact' OR NOT EXISTS (SELECT 1 FROM h x WHERE x.submission_id = h.submission_id AND x.pattern_id = h.pattern_id AND x.how = 'exact')""")
def k_patterns(spark: SparkSession, folder: str) -> DataFrame:
    """Catalog patterns of the corpus (K1-K3)."""
    _, s, f = _corpus(spark, folder)
    return patterns.matches(s, f).select("submission_id", "pattern_id", "match_kind")


@query(_E + _SIGNALS + """, r(pattern_id, evidence_id) AS (VALUES """ + ", ".join(f"('{p[0]}', '{e}')" for p in PATTERNS for e in p[5]) + """)
SELECT submission_id, evidence_id, pattern_id, '0' AS statement_indexes, 'default' AS variant FROM (SELECT DISTINCT submission_id, pattern_id FROM s JOIN c USING (signal) WHERE how = 'exact' AND pattern_id <> 'OR_SAME_COLUMN_TO_IN') JOIN r USING (pattern_id)
UNION ALL SELECT submission_id, 'ORACLE11G_LEADING_WILDCARD_RANGE_LIMIT', 'SUBSTR_EQ_TO_LIKE', '0', 'leading_wildcard' FROM e WHERE any_rewrite = 'substr_eq_to_like'""")
def k_evidence(spark: SparkSession, folder: str) -> DataFrame:
    """Evidence of exact matches (K4)."""
    _, s, f = _corpus(spark, folder)
    return patterns.evidence(patterns.matches(s, f), s).withColumn("statement_indexes", F.array_join("statement_indexes", ","))


def _item(p: tuple) -> int:
    """Characters of a pattern's compact JSON in a context."""
    return len(json.dumps({"pattern_id": p[0], "classification": p[1], "name": p[0].lower().replace("_", " "), "guidance": GUIDANCE[p[0]]}, separators=(",", ":")))


@query(_E + _SIGNALS + """, d(pattern_id, rank, pos, chars) AS (VALUES """ + ", ".join(f"('{p[0]}', {patterns.CLASS_ORDER[p[1]]}, {i}, {_item(p)})" for i, p in enumerate(PATTERNS) if p[0] in GUIDANCE) + """),
h AS (SELECT DISTINCT submission_id, pattern_id FROM s JOIN c USING (signal) WHERE how = 'exact' AND signal NOT IN ('R001')),
o AS (SELECT *, row_number() OVER (PARTITION BY submission_id ORDER BY rank, pos) AS n FROM h JOIN d USING (pattern_id))
SELECT submission_id, CAST(0 AS INTEGER) AS statement_index, string_agg(pattern_id, ',' ORDER BY n) AS patterns, CAST(sum(chars) AS INTEGER) AS chars FROM o WHERE n <= 4 GROUP BY submission_id""")
def k5_packed(spark: SparkSession, folder: str) -> DataFrame:
    """Patterns that fit a context (K5)."""
    _, s, f = _corpus(spark, folder)
    return patterns.packed(patterns.matches(s, f)).select("submission_id", "statement_index", F.array_join("patterns", ",").alias("patterns"), "chars")


@query(_E + """SELECT submission_id, CASE WHEN kind <> 'SELECT' THEN 'not_select' WHEN NOT ok THEN 'parse_failed' WHEN contains(flags, 'connect_by') THEN 'complexity:connect_by' WHEN contains(flags, 'correlated_subquery') THEN 'complexity:correlated_subquery'
 WHEN contains(flags, 'rownum') THEN 'complexity:rownum' WHEN contains(flags, 'set_operation') THEN 'complexity:set_operation' WHEN contains(flags, 'window_function') THEN 'complexity:window_function' END AS gate FROM e""")
def g1_gate(spark: SparkSession, folder: str) -> DataFrame:
    """Why no full rewrite is asked (G1)."""
    _, s, _ = _corpus(spark, folder)
    return s.select("submission_id", guards.gate().alias("gate"))


@query("""WITH b AS (SELECT p_partkey, p_brand, p_type FROM part) SELECT 'substr_eq_to_like' AS rule, count(*) AS n FROM b WHERE substr(p_brand, 1, 6) = 'Brand#' UNION ALL SELECT 'or_eq_to_in', count(*) FROM part WHERE p_size = 1 OR p_size = 5 OR p_size = 9""")
def w_proof(spark: SparkSession, folder: str) -> DataFrame:
    """Rewritten predicates (W1, W2) on data: the oracle counts with the original ones."""
    part = table(spark, folder, "part")
    cases = (("substr_eq_to_like", "SUBSTR(p_brand, 1, 6) = 'Brand#'"), ("or_eq_to_in", "p_size = 1 OR p_size = 5 OR p_size = 9"))
    parts = []
    for rule, before in cases:
        _, after, _ = rewrites.verify_fragment(before, "")
        parts.append(part.where(after).agg(F.count("*").alias("n")).select(F.lit(rule).alias("rule"), "n"))
    return parts[0].union(parts[1])


# --- over the submissions themselves -----------------------------------------------------------


def _submissions(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "submissions")


@query("""SELECT DISTINCT submission_id, try_cast(regexp_replace(cost_raw, '[, ]', '', 'g') AS BIGINT) AS cost FROM submissions WHERE regexp_full_match(regexp_replace(cost_raw, '[, ]', '', 'g'), '[0-9]+')""")
def n11_cost(spark: SparkSession, folder: str) -> DataFrame:
    """Cost texts as whole numbers."""
    return _submissions(spark, folder).select("submission_id", rules.cost(F.col("cost_raw")).alias("cost")).where("cost IS NOT NULL").dropDuplicates()


@query("""WITH r AS (SELECT DISTINCT submission_id, regexp_replace(cost_raw, '[, ]', '', 'g') AS c FROM submissions) SELECT submission_id, CASE WHEN try_cast(c AS BIGINT) = 100000 THEN 'equal' ELSE 'above' END AS relation FROM r WHERE regexp_full_match(c, '[0-9]+') AND try_cast(c AS BIGINT) >= 100000""")
def r1_cost_block(spark: SparkSession, folder: str) -> DataFrame:
    """Requests whose cost blocks."""
    c = _submissions(spark, folder).select("submission_id", rules.cost(F.col("cost_raw")).alias("cost")).dropDuplicates().where("cost >= 100000")
    return c.select("submission_id", F.when(F.col("cost") == 100000, "equal").otherwise("above").alias("relation"))


_DEID = "regexp_replace(regexp_replace(regexp_replace({0}, '\\b[A-Za-z][12]\\d{{8}}\\b', '[REDACTED]', 'g'), '[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\\.[A-Za-z]{{2,}}', '[REDACTED]', 'g'), '\\b\\d{{8,}}\\b', '[REDACTED]', 'g')"
_STRIP = "regexp_replace(regexp_replace({0}, '/\\*[^+](?s:.*?)\\*/|/\\*\\*/', ' ', 'g'), '--[^+\\n][^\\n]*|--$', '', 'g')"


@query("SELECT doc_id, " + _DEID.format("text") + " AS safe, substr(sha256(upper(trim(regexp_replace(" + _DEID.format("text") + ", '[ \\t\\n\\r\\f\\x0B]+', ' ', 'g')))), 1, 16) AS fingerprint FROM documents WHERE text IS NOT NULL AND regexp_full_match(text, '[\\x00-\\x7F]*')")
def m7_deidentified(spark: SparkSession, folder: str) -> DataFrame:
    """De-identification and fingerprint (M7, M8) of the ASCII documents: the part of ``m7_documents`` that SQL can state."""
    docs = table(spark, folder, "documents").where(F.col("text").isNotNull() & (F.octet_length("text") == F.length("text")))
    return docs.select("doc_id", T.deidentify(F.col("text")).alias("safe"), T.fingerprint(T.deidentify(F.col("text"))).alias("fingerprint"))


@query()
def m7_documents(spark: SparkSession, folder: str) -> DataFrame:
    """De-identification and fingerprint (M7, M8) of all documents with a text, in whatever script."""
    docs = table(spark, folder, "documents").where("text IS NOT NULL")
    return docs.select("doc_id", T.deidentify(F.col("text")).alias("safe"), T.fingerprint(T.deidentify(F.col("text"))).alias("fingerprint"))


@query("SELECT DISTINCT submission_id, len(regexp_extract_all(sql, '[\\x{3400}-\\x{9FFF}]')) + (length(sql) - len(regexp_extract_all(sql, '[\\x{3400}-\\x{9FFF}]'))) // 4 + 1 AS tokens FROM submissions WHERE sql IS NOT NULL")
def g2_tokens(spark: SparkSession, folder: str) -> DataFrame:
    """Token estimate."""
    return _submissions(spark, folder).where("sql IS NOT NULL").select("submission_id", T.token_estimate(F.col("sql")).alias("tokens")).dropDuplicates()


@query()
def d_statements(spark: SparkSession, folder: str) -> DataFrame:
    """Statements of the submissions with their facts."""
    s = statements.statements(spread(_submissions(spark, folder).select("submission_id", "sql")))
    return s.withColumn("rewrites", F.to_json("rewrites")).withColumn("signature", F.to_json("signature"))


@query()
def d_scores(spark: SparkSession, folder: str) -> DataFrame:
    """Compliance and score of the submissions."""
    rows = _submissions(spark, folder)
    req = rules.requests(rows).where("error_code IS NULL OR error_code = 'bad_cost'")
    s = written(statements.statements(spread(rows.select("submission_id", "sql"))))
    f = written(rules.findings(s, req))
    return score.scores(req, s, f).join(rules.compliance(rules.rule_rows(req, s, f)), "submission_id")


@query()
def d_archive(spark: SparkSession, folder: str) -> DataFrame:
    """Archive records (M10, S9) of the submissions."""
    rows = _submissions(spark, folder)
    req = rules.requests(rows).where("error_code IS NULL OR error_code = 'bad_cost'")
    s = written(statements.statements(spread(rows.select("submission_id", "sql"))))
    f = written(rules.findings(s, req))
    out = archive.records(spread(rows.select("submission_id", "submitted_at", "sql")), s, rules.compliance(rules.rule_rows(req, s, f)), score.scores(req, s, f))
    return out.withColumn("statements", F.to_json("statements")).withColumn("compliance", F.to_json("compliance")).withColumn("improvement", F.to_json("improvement"))


@query()
def m1_masked(spark: SparkSession, folder: str) -> DataFrame:
    """Masked statements with the number of placeholders (M1-M3)."""
    m = masking.masked(spread(_submissions(spark, folder).select("submission_id", "sql")))
    return m.select("submission_id", "masked_sql", F.size("reverse_map").alias("n_placeholders"))


@query("""WITH r AS (SELECT submission_id, any_value(application_no) AS a, any_value(sql) AS q, any_value(cost_raw) AS c, any_value(plan_text) AS p FROM submissions GROUP BY submission_id),
e AS (SELECT CASE WHEN a IS NULL OR trim(a) = '' OR length(trim(a)) > 50 THEN 'bad_application_no' WHEN q IS NULL OR NOT regexp_matches(q, '\\S') THEN 'empty_sql'
WHEN NOT coalesce(regexp_full_match(regexp_replace(c, '[, ]', '', 'g'), '[0-9]+') AND try_cast(regexp_replace(c, '[, ]', '', 'g') AS BIGINT) IS NOT NULL, false) THEN 'bad_cost' WHEN length(p) > 300000 THEN 'plan_too_long' END AS error_code FROM r)
SELECT error_code, count(*) AS n FROM e WHERE error_code IS NOT NULL GROUP BY error_code""")
def n_rejected(spark: SparkSession, folder: str) -> DataFrame:
    """Submissions that are no valid request, by reason."""
    return rules.requests(_submissions(spark, folder)).where("error_code IS NOT NULL").groupBy("error_code").agg(F.count("*").alias("n"))


@query()
def s_detected(spark: SparkSession, folder: str) -> DataFrame:
    """SQL found in the extracted texts."""
    return detect.detected(spread(table(spark, folder, "sql_extracts").select("extract_id", "filename", "sql").dropDuplicates(["extract_id"])), "extract_id", "filename", "sql")


# --- plans ---------------------------------------------------------------------------------


def _plans(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """Plans, steps with predicates (written), metrics, plan rows."""
    p = table(spark, folder, "plan_extracts")
    text = spread(p.select("plan_id", "plan_text"))
    steps = written(plan_analysis.with_predicates(plan_rows.plan_steps(text), plan_analysis.predicates(text)))
    measured = plan_analysis.metrics(p.select("plan_id", "plan_text").dropDuplicates(["plan_id"]))
    return p, steps, measured, plan_analysis.plans(p, steps, measured)


@query()
def d_plans(spark: SparkSession, folder: str) -> DataFrame:
    """Plans: recognised, source, root cost and its match."""
    return _plans(spark, folder)[3].withColumnRenamed("key", "plan_id")


@query()
def plan_observations(spark: SparkSession, folder: str) -> DataFrame:
    """Observations of the plans (P10)."""
    _, steps, _, plan = _plans(spark, folder)
    return plan_analysis.observations(steps, plan).withColumnRenamed("key", "plan_id")


@query()
def d_plan_summary(spark: SparkSession, folder: str) -> DataFrame:
    """Bounded summary of the plans."""
    p, steps, _, _ = _plans(spark, folder)
    allowed = p.select(F.col("plan_id").alias("key"), F.explode("allowed_tables").alias("table_name"))
    return plan_analysis.summary(steps, allowed).withColumnRenamed("key", "plan_id")


_LINES = "SELECT l_orderkey AS k, l_linenumber AS id, CAST(floor(l_extendedprice) AS BIGINT) AS cost, CAST(floor(l_quantity) AS BIGINT) AS est FROM lineitem"


@query("WITH s AS (" + _LINES + "), r AS (SELECT k, id, cost, row_number() OVER (PARTITION BY k ORDER BY cost DESC, id) AS n FROM s) SELECT CAST(k AS BIGINT) AS plan_id, CAST(id AS BIGINT) AS step_id, cost, CAST(n AS INTEGER) AS rank FROM r WHERE n <= 3")
def plan_top3(spark: SparkSession, folder: str) -> DataFrame:
    """The three most costly steps (P14) of pipe tables generated from the order lines."""
    steps = plan_rows.plan_steps(_line_plans(spark, folder))
    return plan_analysis.top_steps(steps, 3).select(F.col("key").alias("plan_id"), "step_id", "cost", "rank")


@query("WITH s AS (" + _LINES + ") SELECT CAST(k AS BIGINT) AS plan_id, CAST(id AS BIGINT) AS step_id, CASE WHEN id % 3 = 0 THEN 'TABLE_ACCESS_FULL' WHEN id % 3 = 1 THEN 'INDEX_ACCESS' ELSE 'HASH_JOIN' END AS operation, est * 1000 AS estimated_rows, cost FROM s")
def plan_typed_steps(spark: SparkSession, folder: str) -> DataFrame:
    """Typed steps (P1, P2, P4, P11) of the generated pipe tables."""
    steps = plan_rows.plan_steps(_line_plans(spark, folder)).where("step_id <> 0")
    return steps.select(F.col("key").alias("plan_id"), "step_id", plan_analysis.operation_kind(F.col("operation"), F.col("options")).alias("operation"), "estimated_rows", "cost")


def _line_plans(spark: SparkSession, folder: str) -> DataFrame:
    """A pipe table for each order: a root and a step for each of its lines; an order has few lines."""
    line = F.format_string(
        "|* %3d | %-24s | IX_%d | %dK | %d (%d) |", F.col("l_linenumber"), F.when(F.col("l_linenumber") % 3 == 0, "TABLE ACCESS FULL").when(F.col("l_linenumber") % 3 == 1, "INDEX RANGE SCAN").otherwise("HASH JOIN"),
        F.col("l_suppkey"), F.floor("l_quantity").cast("long"), F.floor("l_extendedprice").cast("long"), F.lit(3),
    )
    rows = table(spark, folder, "lineitem").groupBy(F.col("l_orderkey").alias("plan_id")).agg(F.array_sort(F.collect_list(F.struct("l_linenumber", line.alias("t")))).alias("ls"))
    rule = "-" * 60
    head = f"Plan hash value: 1\n\n{rule}\n| Id  | Operation | Name | Rows | Cost (%CPU) |\n{rule}\n|   0 | SELECT STATEMENT |  |  | 1 |\n"
    return rows.select("plan_id", F.concat(F.lit(head), F.array_join(F.transform("ls", lambda x: x["t"]), "\n"), F.lit(f"\n{rule}\n")).alias("plan_text"))


# --- differences, rewrites, workload ------------------------------------------------------------


@query("""SELECT DISTINCT submission_id, CAST(len(string_split(sql, chr(10))) AS INTEGER) AS n_lines FROM submissions WHERE sql IS NOT NULL""")
def f1_diff_lines(spark: SparkSession, folder: str) -> DataFrame:
    """Line differences (F1-F3) of each statement with itself and two lines more: as many lines stay the same as it has; ``f1_altered`` has the other kinds."""
    rows = _submissions(spark, folder).where("sql IS NOT NULL").select("submission_id", "sql").dropDuplicates(["submission_id"])
    d = diff.rows(spread(rows.withColumn("more", F.concat("sql", F.lit("\n@@ added one\n@@ added two")))), "submission_id", "sql", "more")
    return d.where("kind = 'same'").groupBy("submission_id").agg(F.count("*").cast("int").alias("n_lines"))


@query()
def f1_altered(spark: SparkSession, folder: str) -> DataFrame:
    """Line differences (F1-F3) of each statement with its masked form without comments: the lines of each kind."""
    rows = _submissions(spark, folder).where("sql IS NOT NULL").select("submission_id", "sql").dropDuplicates(["submission_id"])
    masked = spread(rows).select("submission_id", "sql", T.strip_comments(masking.mask_udf("sql")["masked_sql"]).alias("safe"))
    d = diff.rows(masked, "submission_id", "sql", "safe")
    return d.groupBy("submission_id").agg(*(F.count(F.when(F.col("kind") == k, 1)).cast("int").alias(f"n_{k}") for k in ("same", "changed", "removed", "added")))


@query()
def x_workload(spark: SparkSession, folder: str) -> DataFrame:
    """New: statements by type, with and without WHERE, and how often each rule fires, over the submissions."""
    rows = _submissions(spark, folder)
    s = written(statements.statements(spread(rows.select("submission_id", "sql"))))
    f = rules.findings(s, rules.requests(rows))
    by_rule = f.groupBy(F.concat(F.lit("rule:"), "rule_id").alias("what")).agg(F.countDistinct("submission_id").alias("n"))
    by_type = s.groupBy(F.concat(F.lit("type:"), "statement_type").alias("what")).agg(F.count("*").alias("n"))
    by_flag = s.select(F.explode("flags").alias("f")).groupBy(F.concat(F.lit("flag:"), "f").alias("what")).agg(F.count("*").alias("n"))
    return by_rule.union(by_type).union(by_flag)


@query(_E + "SELECT submission_id, CAST(NULL AS VARCHAR) AS reason FROM e WHERE any_rewrite = 'or_eq_to_in' UNION ALL SELECT submission_id, 'predicate_lost' FROM e WHERE template IN (14, 19)")
def w8_revalidated(spark: SparkSession, folder: str) -> DataFrame:
    """Full rewrites judged (W6-W8): an OR chain against its IN list is proved, a dropped condition is not."""
    rows = corpus.submissions(table(spark, folder, "orders")).where(F.col("template").isin(14, 15, 19))
    in_list = F.concat(F.lit("SELECT a.x FROM case_note a WHERE a.n IN ("), F.col("submission_id").cast("string"), F.lit(", "), F.col("cost_raw"), F.lit(", 7)"))
    lost = F.lit("SELECT a.x FROM case_note a WHERE UPPER(a.nm) = 'A' || 'B'")
    pairs = rows.select("submission_id", "template", "sql", F.when(F.col("template") == 15, in_list).when(F.col("template") == 14, lost).otherwise(F.lit("SELECT 1 FROM case_note WHERE 1 = 1")).alias("suggested"))
    pairs = pairs.withColumn("sql", F.when(F.col("template") == 19, F.lit("SELECT 1 FROM case_note WHERE n = 5")).otherwise(F.col("sql")))
    return revalidate.revalidated(spread(pairs), "submission_id", "sql", "suggested")


@query("WITH x(alteration, template, reason) AS (VALUES " + corpus.expected_reasons() + f"""), o AS (SELECT CAST(o_orderkey AS BIGINT) AS submission_id, CAST(o_orderkey % {corpus.N} AS INTEGER) AS template FROM orders),
a AS (SELECT *, """ + corpus.alteration() + """ AS alteration FROM o UNION ALL SELECT *, 'own' FROM o)
SELECT submission_id, alteration, CAST(reason AS VARCHAR) AS reason FROM a JOIN x USING (alteration, template)""")
def w8_all_judged(spark: SparkSession, folder: str) -> DataFrame:
    """Two suggestions for every order judged (W6-W8): its own rewrites, and one of the alterations in turn."""
    rows = corpus.submissions(table(spark, folder, "orders")).select("submission_id", "sql")
    how = F.expr(corpus.alteration().replace("//", "DIV"))
    changed = rows.select("submission_id", how.alias("alteration"), "sql").withColumn("suggested", corpus.altered(F.col("sql"), F.col("alteration")))
    own = revalidate.own_rewrites(spread(rows), "submission_id", "sql").withColumn("alteration", F.lit("own"))
    pairs = spread(changed).unionByName(own).withColumn("pair", F.struct("submission_id", "alteration"))
    return revalidate.revalidated(pairs, "pair", "sql", "suggested").select("pair.submission_id", "pair.alteration", "reason")


from sqlloom import queries_more  # noqa: E402, F401 - registers its queries
