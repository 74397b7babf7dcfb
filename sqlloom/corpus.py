"""A statement corpus generated from the ``orders`` table: every order key picks a template.

The expected facts of each template are written by hand, so that SQL over the same table can
state the results without a parser. ``@K`` stands for the order key, ``@Q`` for the whole
part of its price, which is also the submission's cost.
"""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


class Template(NamedTuple):
    sql: str
    kind: str  # statement type
    ok: bool
    tables: str
    applicable: bool
    has_where: bool | None
    restriction: str | None
    ors: int = 0
    likes: str = ""
    functions: str = ""
    flags: str = ""
    hint: bool = False
    rewrites: str = ""
    any_rewrite: str = ""


T = Template
TEMPLATES: tuple[Template, ...] = (
    T("SELECT a.c1, a.c2 FROM permit_hdr a WHERE a.ref_no = @K", "SELECT", True, "PERMIT_HDR", True, True, None),
    T("select * from levy_notice where due_amt > @Q", "SELECT", True, "LEVY_NOTICE", True, True, None, flags="select_star"),
    T("SELECT a.x FROM case_note a", "SELECT", True, "CASE_NOTE", True, False, None),
    T("SELECT 1 FROM dual", "SELECT", True, "DUAL", False, None, None),
    T("SELECT a.x, b.y FROM case_note a JOIN doc_scan b ON b.id = a.id AND b.kind = 'K@K'", "SELECT", True, "CASE_NOTE,DOC_SCAN", True, False, "join_on_constant"),
    T("SELECT a.x, b.y FROM case_note a LEFT JOIN doc_scan b ON b.id = a.id AND b.n = @Q", "SELECT", True, "CASE_NOTE,DOC_SCAN", True, False, "join_on_outer_constant", flags="outer_join"),
    T("SELECT a.x, b.y FROM case_note a INNER JOIN doc_scan b ON b.id = a.id", "SELECT", True, "CASE_NOTE,DOC_SCAN", True, False, "join_on_only"),
    T("SELECT q.x FROM (SELECT x FROM case_note WHERE n = @K) q", "SELECT", True, "CASE_NOTE", True, False, "source_where"),
    T("WITH w AS (SELECT x FROM doc_scan WHERE n < @Q) SELECT w.x FROM w", "SELECT", True, "DOC_SCAN,W", True, False, "source_where"),
    T("SELECT x FROM case_note WHERE n = @K UNION SELECT y FROM doc_scan", "SELECT", True, "CASE_NOTE,DOC_SCAN", True, False, None, flags="distinct_or_union,set_operation"),
    T("SELECT x FROM case_note WHERE n = @K UNION ALL SELECT y FROM case_note WHERE n = @Q", "SELECT", True, "CASE_NOTE", True, True, None, flags="repeated_source_set_operation,set_operation"),
    T("SELECT /*+ PARALLEL(a, 4) */ a.x FROM case_note a WHERE a.n = @K", "SELECT", True, "CASE_NOTE", True, True, None, hint=True),
    T("SELECT a.x FROM case_note a WHERE a.note = '/*+ PARALLEL */' AND a.n = @K", "SELECT", True, "CASE_NOTE", True, True, None),
    T("SELECT a.x FROM case_note a WHERE a.nm LIKE '%part@K' AND a.cd LIKE '_ab%'", "SELECT", True, "CASE_NOTE", True, True, None, likes="2"),
    T("SELECT a.x FROM case_note a WHERE UPPER(a.nm) = 'A@K' AND TRUNC(a.d) = DATE '2024-01-01' AND TRUNC(SYSDATE) > a.d", "SELECT", True, "CASE_NOTE", True, True, None, functions="TRUNC(A.D);UPPER(A.NM)"),
    T("SELECT a.x FROM case_note a WHERE a.n = @K OR a.n = @Q OR a.n = 7", "SELECT", True, "CASE_NOTE", True, True, None, ors=2, rewrites="A.N IN (@K, @Q, 7)", any_rewrite="or_eq_to_in"),
    T("SELECT a.x FROM case_note a WHERE (a.n = @K OR a.m = @Q) AND a.note <> 'this or that'", "SELECT", True, "CASE_NOTE", True, True, None, ors=1, flags="cross_column_or"),
    T("SELECT a.x FROM case_note a WHERE SUBSTR(a.cd, 2, 2) = 'xy' AND a.n = @K", "SELECT", True, "CASE_NOTE", True, True, None, functions="SUBSTR(A.CD, 2, 2)", rewrites="A.CD LIKE '_xy%'", any_rewrite="substr_eq_to_like"),
    T("UPDATE levy_hist SET amt = @Q", "UPDATE", True, "LEVY_HIST", True, False, None),
    T("UPDATE case_note SET amt = @Q WHERE n = @K", "UPDATE", True, "CASE_NOTE", True, True, None),
    T("DELETE FROM case_note WHERE n = @K OR m = 1", "DELETE", True, "CASE_NOTE", True, True, None, ors=1),
    T("INSERT INTO case_hist (x) SELECT x FROM case_note", "INSERT", True, "CASE_HIST,CASE_NOTE", True, False, None),
    T("INSERT INTO case_hist (x, y) VALUES (@K, @Q)", "INSERT", True, "CASE_HIST", False, None, None),
    T("MERGE INTO case_hist h USING case_note s ON (h.id = s.id) WHEN MATCHED THEN UPDATE SET h.x = @K", "MERGE", True, "CASE_HIST,CASE_NOTE", False, None, None),
    T("SELECT a.x, b.y, c.z, d.w FROM t1 a, t2 b, t3 c, t4 d WHERE a.i = b.i AND c.n = @K", "SELECT", True, "T1,T2,T3,T4", True, True, None, flags="cartesian_join"),
    T("SELECT a.x FROM t1 a, t2 b WHERE a.i = b.i(+) AND ROWNUM <= 10", "SELECT", True, "T1,T2", True, True, None, flags="cartesian_join,outer_join,rownum"),
    T("SELECT DISTINCT a.x FROM case_note a WHERE a.i NOT IN (SELECT b.i FROM doc_scan b WHERE b.n = @K)", "SELECT", True, "CASE_NOTE,DOC_SCAN", True, True, None, flags="distinct,not_in_subquery"),
    T("SELECT a.x FROM case_note a WHERE EXISTS (SELECT 1 FROM doc_scan b WHERE b.i = a.i AND b.n = @K)", "SELECT", True, "CASE_NOTE,DOC_SCAN", True, True, None, flags="correlated_subquery"),
    T("SELECT a.k, COUNT(*), SUM(a.n) OVER (PARTITION BY a.k) FROM case_note a WHERE a.n > @Q GROUP BY a.k", "SELECT", True, "CASE_NOTE", True, True, None, flags="group_by_aggregate,window_function"),
    T("SELECT LEVEL FROM case_note START WITH p IS NULL CONNECT BY PRIOR id = p", "SELECT", True, "CASE_NOTE", True, False, None, flags="connect_by"),
    T("SELECT a.x FROM t1 a JOIN t2 b ON a.k || a.l = b.kl WHERE a.n = @K", "SELECT", True, "T1,T2", True, True, None, flags="column_expression_join,string_concat_predicate"),
    T("SELEC a.x FORM case_note a WERE n = @K", "UNKNOWN", False, "", True, None, None),
    T("BEGIN pkg.run(@K); END;\n/", "PLSQL", False, "", False, None, None),
)
N = len(TEMPLATES)

#: Statements whose flags tell top level from nested, queries from changes; (sql, flags, points they score), by hand.
FLAG_TEMPLATES: tuple[tuple[str, str, int], ...] = (
    ("SELECT a.x FROM case_note a WHERE EXISTS (SELECT * FROM doc_scan u, t2 v WHERE u.n = @K)", "", 0),
    ("INSERT INTO case_hist SELECT * FROM case_note t, doc_scan u WHERE t.n = @K", "", 0),
    ("SELECT a.x FROM case_note a NATURAL JOIN doc_scan b WHERE a.n = @K", "cartesian_join", 6),
    ("SELECT a.x FROM case_note a CROSS JOIN doc_scan b WHERE a.n = @K", "", 0),
    ("DELETE FROM case_note WHERE n = @K AND i NOT IN (SELECT b.i FROM doc_scan b WHERE b.n = @Q)", "", 0),
    ("UPDATE case_note SET amt = @Q WHERE i IN (SELECT i FROM doc_scan UNION SELECT i FROM t2)", "distinct_or_union,set_operation", 3),
    ("SELECT DISTINCT a.x FROM case_note a WHERE a.n = @K", "distinct", 0),
    ("SELECT q.x FROM (SELECT DISTINCT x FROM case_note WHERE n = @K) q WHERE q.x > 1", "", 0),
    ("SELECT a.* FROM case_note a WHERE a.n = @K", "", 0),
    ("SELECT q.x FROM (SELECT x FROM case_note WHERE ROWNUM <= 5 AND n = @K) q WHERE q.x > 1", "rownum", 0),
    ("SELECT SUM(a.n) OVER (ORDER BY a.k) FROM case_note a WHERE a.n = @K", "group_by_aggregate,window_function", 0),
    ("SELECT a.x, (SELECT MAX(b.n) FROM doc_scan b WHERE b.m = @K) FROM case_note a WHERE a.n = @Q", "group_by_aggregate", 0),
    ("SELECT a.x FROM case_note a WHERE a.d = (SELECT MAX(h.d) FROM doc_scan h WHERE h.i = a.i) AND a.t = (SELECT MAX(g.t) FROM doc_scan g WHERE g.i = a.i) AND a.n = @K", "correlated_subquery,repeated_correlated_max_subquery", 0),
    ("SELECT a.x, (SELECT COUNT(*) FROM doc_scan d1 WHERE d1.i = a.i) c1, (SELECT COUNT(*) FROM doc_scan d2 WHERE d2.i = a.i) c2 FROM case_note a WHERE a.n = @K", "correlated_subquery,group_by_aggregate,repeated_scalar_aggregate", 0),
    ("SELECT a.x FROM case_note a WHERE a.n = @K MINUS SELECT b.x FROM doc_scan b WHERE b.i NOT IN (SELECT i FROM t2)", "distinct_or_union,not_in_subquery,set_operation", 5),
    ("SELECT * FROM case_note a, doc_scan b WHERE a.n = @K OR b.m = @Q", "cartesian_join,cross_column_or,select_star", 8),
    ("MERGE INTO case_hist h USING (SELECT * FROM case_note, doc_scan) s ON (h.id = s.id) WHEN MATCHED THEN UPDATE SET h.x = @K", "", 0),
    ("SELECT a.x FROM case_note a WHERE a.n = @K UNION ALL SELECT b.x FROM (SELECT x FROM t2 UNION SELECT x FROM t3) b", "distinct_or_union,set_operation", 3),
)


#: Alterations of a statement as (pattern, what replaces it), or a text put behind it, or a statement instead of it.
ALTERATIONS: dict[str, tuple[str, ...]] = {
    "same": ("\\s+", "  "),
    "missing": (),
    "second": (";\nSELECT 1 FROM dual",),
    "open": (" WHERE (",),
    "delete": ("(?s)^.*$", "DELETE FROM case_note WHERE n = 1"),
    "table": ("\\b(case_note|case_hist|doc_scan|permit_hdr|levy_\\w+|dual|t1)\\b", "other_tab"),
    "hint": (" /*+ PARALLEL */",),
    "rownum": (" AND ROWNUM <= 5",),
    "distinct": ("(?i)^SELECT", "SELECT DISTINCT"),
    "column": ("(?i)^SELECT", "SELECT 0,"),
    "order": (" ORDER BY 1",),
    "no_where": ("(?s) WHERE .*$", ""),
    "added": (" AND 'a' = 'b'",),
    "wild": (" AND zz LIKE '%q'",),
    "name": ("(?i)^SELECT (a\\.)?\\w+", "SELECT zz"),
    "changed": (" = ", " <> "),
}


_CHANGES = (18, 19, 20, 21, 22, 23)
_NO_CONDITION_LAST = (2, 3, 7, 8, 9, 18, 21, 22, 23, 28, 31, 32)  # " AND ..." can't follow
_NO_SELECT_FIRST = (8, *_CHANGES, 31, 32)
#: For each alteration the reason by which it is not proved, and the templates with another one (None: proved), written by hand.
REASONS: dict[str, tuple[str, dict[str | None, tuple[int, ...]]]] = {
    "same": ("identical", {}),
    "missing": ("missing", {}),
    "second": ("not_one_statement", {"unreadable": (32,)}),
    "open": ("unreadable", {}),
    "delete": ("type", {"unreadable": (31, 32)}),
    "table": ("tables", {"type": _CHANGES, "unreadable": (31,), "identical": (32,)}),
    "hint": ("hint", {"type": _CHANGES, "unreadable": (31, 32)}),
    "rownum": ("rownum", {"unreadable": _NO_CONDITION_LAST, "hint": (11,), "type": (19, 20)}),
    "distinct": ("structure:distinct", {"identical": _NO_SELECT_FIRST, "hint": (11,), "rownum": (25,), "unreadable": (26,)}),
    "column": ("signature:select_count", {"identical": _NO_SELECT_FIRST, "hint": (11,), "rownum": (25,), "unreadable": (26,)}),
    "order": ("signature:order_by", {"unreadable": (18, 19, 20, 22, 23, 31, 32), "hint": (11,), "type": (21,), "rownum": (25,)}),
    "no_where": ("where", {"identical": (1, 2, 3, 4, 5, 6, 18, 21, 22, 23, 29, 31, 32), "unreadable": (7, 8), "tables": (9, 26, 27), "structure:set_operation": (10,), "hint": (11,), "type": (19, 20), "rownum": (25,), "signature:group_by_count": (28,)}),
    "added": ("predicate_added", {"unreadable": _NO_CONDITION_LAST, "hint": (11,), "predicate_changed": (15,), "type": (19, 20), "rownum": (25,), "skeleton": (29,)}),
    "wild": ("more_findings", {"unreadable": _NO_CONDITION_LAST, "hint": (11,), "type": (19, 20), "rownum": (25,), "skeleton": (29,)}),
    "name": ("skeleton", {"identical": (1, 11, *_NO_SELECT_FIRST), "rownum": (25,), "unreadable": (26,)}),
    "changed": ("predicate_lost", {"blocks": (9,), "identical": (1, 2, 3, 8, 13, 21, 22, 28, 32), "hint": (11,), "predicate_changed": (15,), "unreadable": (18, 19, 23, 31), "type": (20,), "rownum": (25,), "skeleton": (29,)}),
    "own": ("missing", {None: (15, 17)}),
}


def expected_reasons() -> str:
    """SQL: ``alteration, template, reason`` of all."""
    rows = [(how, i, next((r for r, at in other.items() if i in at), usual)) for how, (usual, other) in REASONS.items() for i in range(N)]
    return ", ".join(f"({_q(h)}, {i}, {_q(r)})" for h, i, r in rows)


def alteration(order: str = "submission_id") -> str:
    """SQL: the alteration of an order, all of them in turn over the orders of a template."""
    return f"CASE ({order} // {N}) % {len(ALTERATIONS)} " + " ".join(f"WHEN {i} THEN {_q(a)}" for i, a in enumerate(ALTERATIONS)) + " END"


def altered(sql: Column, how: Column) -> Column:
    """The text after the alteration named."""
    out = F.lit(None).cast("string")
    for name, a in ALTERATIONS.items():
        if a:
            out = F.when(how == name, F.concat(sql, F.lit(a[0])) if len(a) == 1 else F.regexp_replace(sql, a[0], a[1])).otherwise(out)
    return out


def submissions(orders: DataFrame, templates: tuple = TEMPLATES) -> DataFrame:
    """``submission_id, template, cost_raw, sql`` and the other columns of a submission."""
    picked = F.element_at(F.array(*(F.lit(t[0]) for t in templates)), (F.col("template") + 1))
    q = F.floor("o_totalprice").cast("string")
    text = F.replace(F.replace(picked, F.lit("@K"), F.col("o_orderkey").cast("string")), F.lit("@Q"), q)
    base = orders.withColumn("template", F.pmod(F.col("o_orderkey"), F.lit(len(templates))).cast("int"))
    return base.select(
        F.col("o_orderkey").cast("long").alias("submission_id"), "template", F.concat(F.lit("AP-"), F.col("o_orderkey").cast("string")).alias("application_no"), q.alias("cost_raw"),
        text.alias("sql"), F.lit(None).cast("string").alias("plan_text"), F.lit(True).alias("include_ai"), F.col("o_orderdate").alias("submitted_at"),
    )


def _q(v: object) -> str:
    return "NULL" if v is None else str(v).upper() if isinstance(v, bool) else str(v) if isinstance(v, int) else "'" + str(v).replace("'", "''") + "'"


def expected_flags() -> str:
    """SQL: ``submission_id, flags, structure_score`` of every order for ``FLAG_TEMPLATES``."""
    rows = ", ".join(f"({i}, {_q(flags)}, {points})" for i, (_, flags, points) in enumerate(FLAG_TEMPLATES))
    return f"WITH t(template, flags, points) AS (VALUES {rows}) SELECT CAST(o.o_orderkey AS BIGINT) AS submission_id, t.flags, CAST(t.points AS DOUBLE) AS structure_score FROM orders o JOIN t ON o.o_orderkey % {len(FLAG_TEMPLATES)} = t.template"


def expected_cte() -> str:
    """SQL: CTE ``e`` with one row an order and the hand-written facts of its template."""
    names = "template, kind, ok, tables, applicable, has_where, restriction, ors, likes, functions, flags, hint, rewrites, any_rewrite"
    rows = []
    for i, t in enumerate(TEMPLATES):
        rows.append("(" + ", ".join(_q(v) for v in (i, t.kind, t.ok, t.tables, t.applicable, t.has_where, t.restriction, t.ors, int(t.likes or 0), t.functions, t.flags, t.hint, t.rewrites, t.any_rewrite)) + ")")
    return (
        f"t({names}) AS (VALUES {', '.join(rows)}), "
        "e AS (SELECT CAST(o.o_orderkey AS BIGINT) AS submission_id, CAST(floor(o.o_totalprice) AS BIGINT) AS cost, t.*, CASE WHEN t.functions = '' THEN 0 ELSE len(string_split(t.functions, ';')) END AS nf, "
        f"CASE WHEN t.tables = '' THEN 0 ELSE len(string_split(t.tables, ',')) END AS nt FROM orders o JOIN t ON o.o_orderkey % {N} = t.template)"
    )
