"""Queries over replies, and over texts and plans generated so that SQL can state their results."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from sqlloom import engine
from sqlloom.functions import text as T
from sqlloom.operators import display, guards, masking, plan_analysis, plan_rows
from sqlloom.queries import query
from sqlloom.sources import attachments
from sqlloom.sources.scratch import written
from sqlloom.sources.tables import spread, table

# --- replies -----------------------------------------------------------------------------------


@query(r"""WITH v AS (SELECT *, CASE WHEN json_valid(reply_json) THEN reply_json END AS j FROM model_replies),
t AS (SELECT *, json_extract_string(j, '$.summary') AS summary, json_type(j, '$.summary') AS ts, json_extract_string(j, '$.assessment_confidence_score') AS c, json_type(j, '$.assessment_confidence_score') AS tc, coalesce(json_type(j, '$.advice'), 'none') AS ta,
 CASE WHEN json_type(j, '$.advice') = 'ARRAY' THEN json_array_length(j, '$.advice') ELSE 0 END AS n, json_type(j, '$.suggested_sql.available') AS tv, json_type(j, '$.suggested_sql.reason') AS tr, json_extract_string(j, '$.suggested_sql.rewrite_outcome') AS outcome FROM v),
i AS (SELECT t.*, len(list_filter(json_extract(j, '$.advice[*]'), lambda a: NOT coalesce(json_type(a, '$.title') = 'VARCHAR' AND json_type(a, '$.explanation') = 'VARCHAR' AND json_type(a, '$.confidence_score') IN ('UBIGINT', 'BIGINT') AND regexp_full_match(json_extract_string(a, '$.confidence_score'), '\d{1,2}|100'), false))) AS bad FROM t),
f AS (SELECT submission_id, replied_at, c, n, outcome, CASE WHEN reply_json IS NULL OR trim(reply_json) = '' THEN 'no_reply' WHEN finish_reason = 'length' THEN 'truncated' WHEN j IS NULL OR NOT regexp_matches(j, '^\s*\{') THEN 'bad_json' WHEN coalesce(ts, '') <> 'VARCHAR' THEN 'no_summary'
 WHEN length(summary) >= 20 AND NOT regexp_matches(summary, '[\x{4E00}-\x{9FFF}]') THEN 'wrong_language' WHEN coalesce(tc, '') NOT IN ('UBIGINT', 'BIGINT') OR NOT regexp_full_match(c, '\d{1,2}|100') THEN 'bad_confidence' WHEN ta NOT IN ('none', 'ARRAY') THEN 'bad_advice'
 WHEN n > 3 THEN 'too_much_advice' WHEN bad > 0 THEN 'bad_advice' WHEN coalesce(tv, '') <> 'BOOLEAN' OR coalesce(tr, '') <> 'VARCHAR' THEN 'no_suggestion' WHEN outcome NOT IN ('not_needed', 'advice_only') THEN 'bad_outcome' END AS failure FROM i),
b AS (SELECT *, row_number() OVER (PARTITION BY submission_id ORDER BY failure IS NOT NULL, CASE WHEN failure IS NULL THEN epoch_us(replied_at) ELSE -epoch_us(replied_at) END) AS r FROM f)
SELECT submission_id, CASE WHEN failure IS NULL THEN 'ok' ELSE 'unavailable' END AS status, failure FROM b WHERE r = 1""")
def g7_replies(spark: SparkSession, folder: str) -> DataFrame:
    """Replies judged."""
    return guards.replies(table(spark, folder, "model_replies")).select("submission_id", "status", "failure")


def _quoted(v: str) -> str:
    return "'" + v.replace("'", "''") + "'"


def _replaced(c: str) -> str:
    for old, new in guards.VOCABULARY:
        c = f"replace({c}, {_quoted(old)}, {_quoted(new)})"
    return c


@query(r"""WITH r AS (SELECT DISTINCT submission_id, reply_json FROM model_replies WHERE json_valid(reply_json)), a AS (SELECT submission_id, unnest(json_extract(reply_json, '$.advice[*]')) AS a, generate_subscripts(json_extract(reply_json, '$.advice[*]'), 1) - 1 AS pos FROM r),
t AS (SELECT submission_id, CAST(pos AS INTEGER) AS pos, """ + _replaced("json_extract_string(a, '$.title')") + " AS title, " + _replaced("json_extract_string(a, '$.explanation')") + r""" AS explanation, json_extract_string(a, '$.confidence_score') AS c FROM a WHERE pos < 3)
SELECT submission_id, pos, title, explanation, CASE WHEN regexp_full_match(c, '\d{1,2}|100') THEN CAST(c AS INTEGER) ELSE -1 END AS confidence, """ + " OR ".join(f"contains(concat_ws(' ', title, explanation), {_quoted(p)})" for p in guards.FORBIDDEN) + " AS dropped FROM t")
def g8_advice(spark: SparkSession, folder: str) -> DataFrame:
    """Advice items with replaced vocabulary and forbidden phrases."""
    return guards.advice(table(spark, folder, "model_replies")).drop("example").na.fill(-1, ["confidence"])


def _analysed(spark: SparkSession, folder: str) -> dict[str, DataFrame]:
    return engine.analyze(table(spark, folder, "submissions"), table(spark, folder, "model_replies"))


@query()
def d_outcomes(spark: SparkSession, folder: str) -> DataFrame:
    """Outcomes of the replies with advice that survives, capped confidence (G8-G10) and potential."""
    r = _analysed(spark, folder)
    return r["outcomes"].withColumn("advice", F.to_json("advice")).join(r["potential"], "submission_id", "left")


@query()
def d_payloads(spark: SparkSession, folder: str) -> DataFrame:
    """What a model would see of each request."""
    return engine.payloads(_analysed(spark, folder))


@query()
def d_overview(spark: SparkSession, folder: str) -> DataFrame:
    """What a page would show of each request."""
    r = _analysed(spark, folder)
    lists = r["statements"].groupBy("submission_id").agg(F.flatten(F.collect_list("rewrites")).alias("rewrites"))  # those of one script
    return display.overview(r["rule_rows"], r["compliance"], r["scores"], r["replies"], r["outcomes"], lists, r["potential"])


@query()
def d_plan_contexts(spark: SparkSession, folder: str) -> DataFrame:
    """Plans of the submissions with their statements' rewrites (P10) and bounded contexts."""
    c = _analysed(spark, folder)["plan_contexts"].withColumnRenamed("key", "submission_id")
    return c.select(*(F.to_json(x).alias(x) if x in ("priority_steps", "signals", "runtime_metrics") else F.col(x) for x in c.columns))


@query(r"""WITH t AS (SELECT DISTINCT submission_id, len(regexp_extract_all(sql, '[\x{3400}-\x{9FFF}]')) + (length(sql) - len(regexp_extract_all(sql, '[\x{3400}-\x{9FFF}]'))) // 4 + 1 AS n FROM submissions WHERE sql IS NOT NULL)
SELECT submission_id, CAST(CASE WHEN 100 * n + 3072 <= 16384 THEN 16384 ELSE 32768 END AS INTEGER) AS context FROM t""")
def g3_context(spark: SparkSession, folder: str) -> DataFrame:
    """Context tier (G3) for a hundred times each statement's tokens."""
    rows = table(spark, folder, "submissions").where("sql IS NOT NULL").select("submission_id", T.token_estimate(F.col("sql")).alias("n")).dropDuplicates()
    return rows.select("submission_id", T.context_tier(F.col("n") * 100).alias("context"))


@query("""SELECT CAST(l_orderkey AS BIGINT) AS k, CAST(l_linenumber AS INTEGER) AS n, CASE WHEN q >= 80 THEN 'high' WHEN q >= 60 THEN 'medium' ELSE 'low' END AS band, CAST(least(q, CASE WHEN n3 = 0 THEN 59 WHEN n3 = 1 THEN 79 ELSE 100 END) AS INTEGER) AS capped
FROM (SELECT *, CAST(l_quantity * 2 AS INTEGER) AS q, l_linenumber % 3 AS n3 FROM lineitem)""")
def g10_capped(spark: SparkSession, folder: str) -> DataFrame:
    """Confidence under its caps (G10) and its bands (G13), over twice the quantities."""
    q, n3, no = (F.col("l_quantity") * 2).cast("int"), F.col("l_linenumber") % 3, F.lit(False)
    capped = guards.calibrated(q, n3 == 0, no, no, no, n3 == 1)
    return table(spark, folder, "lineitem").select(F.col("l_orderkey").cast("long").alias("k"), F.col("l_linenumber").cast("int").alias("n"), T.confidence_band(q).alias("band"), capped.cast("int").alias("capped"))


# --- texts -------------------------------------------------------------------------------------

_HIDDEN = "'SELECT x /* note */ FROM t WHERE a = :STR_001 AND b = :NUM_001 AND d = ''ab%'' AND e = DATE :STR_002 AND f = :STR_001 AND TO_CHAR(g, ''YYYY'') = :STR_003'"


@query("SELECT CAST(o_orderkey AS BIGINT) AS submission_id, " + _HIDDEN + " AS masked_sql, 4 AS n_placeholders, true AS comes_back, '7 :VALUE :STR_001' AS scrubbed FROM orders")
def m1_generated(spark: SparkSession, folder: str) -> DataFrame:
    """Masking of literals and years, the way back, and invented placeholders (M1, M3-M5, M9) over statements made of the orders."""
    k, clerk = (F.col("o_orderkey") + 1_000_000).cast("string"), F.col("o_orderkey").cast("string")
    sql = F.concat(F.lit("SELECT x /* note */ FROM t WHERE a = 'made by "), clerk, F.lit("' AND b = "), k, F.lit(" AND d = 'ab%' AND e = DATE '1999-12-31' AND f = 'made by "), clerk, F.lit("' AND TO_CHAR(g, 'YYYY') = '2024'"))
    rows = table(spark, folder, "orders").select(F.col("o_orderkey").cast("long").alias("submission_id"), sql.alias("sql"))
    m = spread(rows).withColumn("m", masking.mask_udf("sql", years=True))
    scrubbed = masking.scrub_invented(F.lit("7 :NUM_404 :STR_001"), F.map_keys("m.reverse_map"))
    return m.select("submission_id", "m.masked_sql", F.size("m.reverse_map").alias("n_placeholders"), (masking.unmask(F.col("m.masked_sql"), F.col("m.reverse_map")) == F.col("sql")).alias("comes_back"), scrubbed.alias("scrubbed"))


_FOUND = "'SELECT a.x FROM t a WHERE a.n = ' || CAST(o_orderkey AS VARCHAR)"


@query("SELECT CAST(o_orderkey AS BIGINT) AS k, CASE o_orderkey % 5 WHEN 3 THEN '' WHEN 2 THEN " + _FOUND + " || ';' || chr(10) || chr(10) || 'UPDATE t SET a = 1 WHERE b = 2;' ELSE " + _FOUND + """ END AS sql, CAST(CASE o_orderkey % 5 WHEN 3 THEN 0 WHEN 2 THEN 2 ELSE 1 END AS INTEGER) AS statement_count,
o_orderkey % 5 IN (1, 2, 4) AS needs_confirmation, o_orderkey % 5 <> 3 AS found FROM orders""")
def s_generated(spark: SparkSession, folder: str) -> DataFrame:
    """SQL found in texts of five layouts (N3-N7, S8): a fence, prose around, two statements, none, a cell."""
    sql = F.concat(F.lit("SELECT a.x FROM t a WHERE a.n = "), F.col("o_orderkey").cast("string"))
    k = F.pmod(F.col("o_orderkey"), F.lit(5))
    text = (
        F.when(k == 0, F.concat(F.lit("# Title\n\nSome prose.\n\n```sql\n"), sql, F.lit("\n```\n\nSELECT is a word.\n"))).when(k == 1, F.concat(F.lit("Please review:\n\n"), sql, F.lit("\n\nIt runs for long.")))
        .when(k == 2, F.concat(F.lit("First:\n"), sql, F.lit("\n\nNext one:\n\nUPDATE t SET a = 1 WHERE b = 2\n"))).when(k == 3, F.lit("Nothing of the kind here.")).otherwise(F.concat(F.lit('id,query\n1,"'), sql, F.lit('"\n')))
    )
    name = F.when(k == 0, "a.md").when(k == 4, "b.CSV").otherwise("c.txt")
    return engine.extract(table(spark, folder, "orders").select(F.col("o_orderkey").cast("long").alias("k"), name.alias("filename"), text.alias("text")), "k", "filename", "text")


@query(r"""WITH f AS (SELECT DISTINCT extract_id, filename, sql, lower(regexp_extract(filename, '\.([^./\\]+)$', 1)) AS ext FROM sql_extracts) SELECT extract_id, CASE WHEN ext NOT IN ('sql', 'txt', 'md', 'markdown', 'csv', 'docx', 'pdf') OR ext IS NULL THEN 'bad_extension' WHEN sql IS NULL OR sql = '' THEN 'empty'
WHEN starts_with(sql, 'MZ') THEN 'program' WHEN ext = 'pdf' THEN 'not_pdf' WHEN ext = 'docx' THEN 'not_docx' END AS error_code, CASE WHEN ext IN ('sql', 'txt', 'md', 'markdown', 'csv') AND sql <> '' THEN length(regexp_replace(sql, '^\x{FEFF}', '')) ELSE -1 END AS n_chars, ext IN ('txt', 'csv') AS plan_allowed FROM f""")
def s1_attachments(spark: SparkSession, folder: str) -> DataFrame:
    """The extracts' texts as files: checked, decoded and cut (S1, S2, S6, S7); those named like documents hold none."""
    rows = table(spark, folder, "sql_extracts").select("extract_id", "filename", "sql").dropDuplicates(["extract_id"])
    files = rows.select(F.concat_ws("/", F.col("extract_id").cast("string"), F.coalesce("filename", F.lit(""))).alias("path"), F.encode("sql", "utf-8").alias("content"))
    read = attachments.truncated(attachments.texts(spread(files)))
    plan = attachments.extension(F.col("path")).isin(*attachments.PLAN_EXTENSIONS)
    return read.select(F.substring_index("path", "/", 1).cast("long").alias("extract_id"), "error_code", F.coalesce(F.length("text"), F.lit(-1)).cast("long").alias("n_chars"), plan.alias("plan_allowed"))


@query("""WITH p AS (SELECT l_orderkey, l_suppkey, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_suppkey) AS page FROM lineitem)
SELECT CAST(l_orderkey AS BIGINT) AS k, string_agg('line ' || CAST(page AS VARCHAR) || ' of ' || CAST(l_suppkey AS VARCHAR), chr(10) ORDER BY page) || CASE WHEN count(*) = 1 THEN chr(10) || '1' ELSE '' END AS text FROM p GROUP BY l_orderkey""")
def s5_pages(spark: SparkSession, folder: str) -> DataFrame:
    """Pages joined without heads and page numbers (S5): a page for each order line; a single page keeps its lines."""
    page = F.row_number().over(Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_suppkey"))  # an order has few lines
    alone = F.count("*").over(Window.partitionBy("l_orderkey")) == 1
    lines = table(spark, folder, "lineitem").select(F.col("l_orderkey").cast("long").alias("k"), page.alias("page"), "l_suppkey", alone.alias("alone"))
    line = F.concat_ws(" ", F.lit("line"), "page", F.lit("of"), "l_suppkey")
    pages = lines.select("k", "page", F.concat(F.when(F.col("alone"), "").otherwise("Head\n"), line, F.lit("\n"), F.col("page").cast("string")).alias("text"))
    return attachments.without_furniture(pages, "k")


# --- plans -------------------------------------------------------------------------------------


def _full_plans(spark: SparkSession, folder: str) -> dict[str, DataFrame]:
    """Plans of the orders with predicates, statistics and, for even keys, runtime columns."""
    n, k, runtime = F.col("l_linenumber"), F.col("l_orderkey"), F.pmod(F.col("l_orderkey"), F.lit(2)) == 0
    e = F.floor("l_quantity").cast("long")
    actual = F.when(n % 4 == 0, F.lit(0)).when(n % 2 == 0, e * n * 10).otherwise(e)
    text = lambda c: F.when(runtime, c.cast("string")).otherwise("-")
    op = F.when(n % 3 == 0, "TABLE ACCESS FULL").when(n % 3 == 1, "INDEX RANGE SCAN").otherwise("HASH JOIN")
    line = F.format_string("|* %d | %s | T_%d | %s | %d | %s | %d |", n, op, F.col("l_suppkey"), text(1 + n % 2), e, text(actual), F.floor("l_extendedprice").cast("long"))
    predicate = F.format_string("   %d - %s", n, F.when(n % 2 == 0, 'filter(TRUNC("D")=1 AND\n       NVL("E",0)=2)').otherwise('access("A"="B")'))
    lines = table(spark, folder, "lineitem").groupBy(k.alias("plan_id")).agg(
        F.array_sort(F.collect_list(F.struct("l_linenumber", line.alias("t"), predicate.alias("p")))).alias("ls"),
        F.collect_list(F.when(F.col("l_suppkey") % 2 == 0, F.concat(F.lit("own.t_"), F.col("l_suppkey").cast("string")))).alias("allowed"),
    )
    orders = table(spark, folder, "orders").select(F.col("o_orderkey").alias("plan_id"), F.floor("o_totalprice").cast("long").alias("expected_cost"))
    rule = "-" * 60
    root = F.col("expected_cost") + (F.pmod("plan_id", F.lit(5)) != 0).cast("int")
    head = F.concat(F.lit(f"Plan hash value: 1\n\n{rule}\n| Id | Operation | Name | Starts | E-Rows | A-Rows | Cost |\n{rule}\n| 0 | SELECT STATEMENT | | - | 1 | - | "), root.cast("string"), F.lit(" |\n"))
    stats = F.when(F.pmod("plan_id", F.lit(3)) == 0, F.concat(F.lit("\n\nStatistics\n-----\n   "), F.pmod("plan_id", F.lit(1000)).cast("string"), F.lit("  consistent gets\n   7  consistent gets\n"))).otherwise("")
    body = lambda f: F.array_join(F.transform("ls", lambda x: x[f]), "\n")
    whole = F.concat(head, body("t"), F.lit(f"\n{rule}\n\nPredicate Information (identified by operation id):\n{rule}\n"), body("p"), stats)
    p = written(lines.join(orders, "plan_id").select(F.col("plan_id").cast("long").alias("plan_id"), "expected_cost", "allowed", whole.alias("plan_text")))
    steps = written(plan_analysis.with_predicates(plan_rows.plan_steps(spread(p)), plan_analysis.predicates(spread(p))))
    measured = plan_analysis.metrics(p)
    plan = plan_analysis.plans(p, steps, measured)
    allowed = p.select(F.col("plan_id").alias("key"), F.explode("allowed").alias("table_name"))
    return {"steps": steps, "measured": measured, "plan": plan, "summary": plan_analysis.summary(steps, allowed)}


_FULL = """WITH o AS (SELECT CAST(o_orderkey AS BIGINT) AS k, CAST(floor(o_totalprice) AS BIGINT) AS expected FROM orders), l AS (SELECT CAST(l_orderkey AS BIGINT) AS k, CAST(l_linenumber AS BIGINT) AS id, CAST(l_suppkey AS BIGINT) AS supp, CAST(floor(l_quantity) AS BIGINT) AS e, CAST(floor(l_extendedprice) AS BIGINT) AS cost FROM lineitem) """


@query(_FULL + ", m AS (SELECT k, count(*) AS n FROM l GROUP BY k) SELECT k AS plan_id, true AS recognized, n + 1 AS n_steps, CASE WHEN k % 2 = 0 OR k % 3 = 0 THEN 'actual' ELSE 'estimated' END AS source, expected + (k % 5 <> 0)::INT AS root_cost, k % 5 = 0 AS cost_matches FROM o JOIN m USING (k)")
def plan_headers(spark: SparkSession, folder: str) -> DataFrame:
    """Recognition, source, root cost (P8, P9, P13) of generated plans."""
    return _full_plans(spark, folder)["plan"].withColumnRenamed("key", "plan_id")


@query(_FULL + "SELECT k AS plan_id, 'consistent_gets' AS metric, k % 1000 AS value FROM o SEMI JOIN l USING (k) WHERE k % 3 = 0")
def plan_metrics(spark: SparkSession, folder: str) -> DataFrame:
    """Runtime statistics (P7) of generated plans."""
    return _full_plans(spark, folder)["measured"].withColumnRenamed("key", "plan_id")


@query(_FULL + """, x AS (SELECT k, 'COST_MISMATCH' AS code, 'review' AS level, CAST(NULL AS BIGINT) AS step_id, CAST(expected + 1 AS VARCHAR) AS detail, 0 AS part FROM o SEMI JOIN l USING (k) WHERE k % 5 <> 0
UNION ALL SELECT k, 'TABLE_ACCESS_FULL', 'fact', id, 'T_' || CAST(supp AS VARCHAR), 1 FROM l WHERE id % 3 = 0 UNION ALL SELECT k, 'FUNCTION_FILTER_PREDICATE', 'opportunity', id, 'TRUNC', 2 FROM l WHERE id % 2 = 0
UNION ALL SELECT k, 'CARDINALITY_GAP', 'review', id, CASE WHEN id % 4 = 0 THEN 'inf' ELSE CAST(id * 10 AS VARCHAR) END, 3 FROM l WHERE k % 2 = 0 AND id % 2 = 0)
SELECT k AS plan_id, code, level, coalesce(step_id, -1) AS step_id, detail FROM x""")
def plan_observed(spark: SparkSession, folder: str) -> DataFrame:
    """Predicates by step and observations (P5, P6, P10) of generated plans; their order is tested elsewhere, for line numbers repeat."""
    r = _full_plans(spark, folder)
    return plan_analysis.observations(r["steps"], r["plan"]).withColumnRenamed("key", "plan_id").drop("n").na.fill(-1, ["step_id"])


@query(_FULL + """SELECT k AS plan_id, CAST(row_number() OVER (PARTITION BY k ORDER BY cost DESC, id) AS INTEGER) AS rank, id AS step_id, CASE id % 3 WHEN 0 THEN 'TABLE_ACCESS_FULL' WHEN 1 THEN 'INDEX_ACCESS' ELSE 'HASH_JOIN' END AS operation, CASE WHEN supp % 2 = 0 THEN 'T_' || CAST(supp AS VARCHAR) END AS object_name, cost,
e AS estimated_rows, CASE WHEN k % 2 <> 0 THEN -1 WHEN id % 4 = 0 THEN 0 WHEN id % 2 = 0 THEN e * id * 10 ELSE e END AS actual_rows, CASE WHEN k % 2 = 0 THEN 1 + id % 2 ELSE -1 END AS starts, CASE WHEN id % 2 = 0 THEN 'NVL,TRUNC' ELSE '' END AS functions FROM l QUALIFY rank <= 8""")
def plan_summary(spark: SparkSession, folder: str) -> DataFrame:
    """Top 8 steps with what may be told of them (P11, P12) of generated plans."""
    return _full_plans(spark, folder)["summary"].withColumnRenamed("key", "plan_id").na.fill(-1, ["actual_rows", "starts"])
