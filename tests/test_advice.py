"""What the first review found left out."""

import hashlib
import os
import re

import pytest

from conftest import DATA
from sqlloom import queries as core
from sqlloom.functions import text as T

needs_data = pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables here")


def deidentified(text):
    """M7 and M8 by Python's regular expressions, in which letters and digits of every script count."""
    for p in (r"\b[A-Za-z][12]\d{8}\b", r"(?:[^\W]|[.%+-])+@(?:[^\W_]|[.-])+\.[^\W\d_]{2,}", r"\b\d{8,}\b"):
        text = re.sub(p, "[REDACTED]", text)
    return text, hashlib.sha256(" ".join(re.split(r"\s+", text)).strip(" ").upper().encode()).hexdigest()[:16]


ODD = ["證號A123456789。", "證號 A123456789 號", "A123456789號", "é12345678", "12345678é ٣12345678 12345678", "１２３４５６７８", "josé@exämple.org, x", "寄到jane@x.org謝謝", "a 　b  ß ǆ", "x_12345678 12345678", "plain A223456789 b@c.de 123456789", ""]


def test_documents_of_every_script_are_deidentified(spark, tmp_path):
    from pyspark.sql import functions as F

    spark.createDataFrame([*enumerate(ODD), (99, None)], "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    got = {r.doc_id: (r.safe, r.fingerprint) for r in core.QUERIES["m7_documents"](spark, str(tmp_path)).collect()}
    assert got == {i: deidentified(t) for i, t in enumerate(ODD)}
    assert got[0][0] == "證號A123456789。" and got[1][0] == "證號 [REDACTED] 號" and got[5][0] == "[REDACTED]" and got[6][0] == "[REDACTED], x"
    one = spark.createDataFrame([(t,) for t in ODD], "t string").select("t", T.deidentify(F.col("t")).alias("d")).collect()
    assert all(r.d == deidentified(r.t)[0] for r in one)


@needs_data
def test_all_documents_against_brute_force(spark):
    from sqlloom.sources.tables import table

    want = sorted((r.doc_id, *deidentified(r.text)) for r in table(spark, DATA, "documents").collect() if r.text is not None)
    assert sorted(map(tuple, core.QUERIES["m7_documents"](spark, DATA).collect())) == want
    assert any(not r[1].isascii() for r in want)


def test_every_alteration_of_every_template_is_judged_as_expected(spark):
    from pyspark.sql import functions as F

    from sqlloom import corpus
    from sqlloom.operators import revalidate

    rows = [(h, i, t.sql.replace("@K", "33").replace("@Q", "99999")) for h in corpus.ALTERATIONS for i, t in enumerate(corpus.TEMPLATES)]
    df = spark.createDataFrame(rows, "how string, i int, sql string").withColumn("new", corpus.altered(F.col("sql"), F.col("how"))).withColumn("k", F.concat_ws(" ", "how", "i"))
    got = {r.k: r.reason for r in revalidate.revalidated(df, "k", "sql", "new").collect()}
    got |= {f"own {i}": revalidate.reason(s, revalidate.rewritten(s)) for h, i, s in rows if h == "same"}
    assert got == {f"{h} {i}": next((r for r, at in other.items() if i in at), usual) for h, (usual, other) in corpus.REASONS.items() for i in range(corpus.N)}
    first = {None if r is None else r.split(":")[0] for r in got.values()}
    assert first == {None, "missing", "identical", "not_one_statement", "unreadable", "type", "tables", "hint", "rownum", "structure", "signature", "where", "skeleton", "blocks", "more_findings", "predicate_lost", "predicate_changed", "predicate_added"}


def test_conditions_of_inline_views_are_compared():
    from sqlloom.operators.revalidate import reason

    assert reason("SELECT q.x FROM (SELECT x FROM t WHERE n = 1) q", "SELECT q.x FROM (SELECT x FROM t WHERE n <> 1) q") == "predicate_lost"
    assert reason("SELECT q.x FROM (SELECT x FROM t WHERE n = 1 OR n = 2) q", "SELECT q.x FROM (SELECT x FROM t WHERE n IN (1, 2)) q") is None


def test_orders_get_both_suggestions(spark, tmp_path):
    from sqlloom import corpus

    n = corpus.N * len(corpus.ALTERATIONS)
    spark.range(n).selectExpr("id AS o_orderkey", "1234.5D AS o_totalprice", "DATE '2024-01-01' AS o_orderdate").write.parquet(str(tmp_path / "orders.parquet"))
    got = core.QUERIES["w8_all_judged"](spark, str(tmp_path)).collect()
    assert len(got) == 2 * n == len({(r.submission_id, r.alteration) for r in got}) and len({(r.submission_id % corpus.N, r.alteration) for r in got}) == n + corpus.N


def test_line_differences_of_altered_statements(spark, tmp_path):
    from sqlloom.operators import diff

    texts = ["SELECT a\nFROM t", "SELECT a\nFROM t\nWHERE n = 'long literal'", "/* one\ntwo\nthree */\nSELECT a\nFROM t\nWHERE n = 1234567 -- why", "SELECT 'open\nline two' x\nFROM t", ""]
    spark.createDataFrame([*enumerate(texts), (1, texts[1]), (9, None)], "submission_id long, sql string").write.parquet(str(tmp_path / "submissions.parquet"))
    got = {r.submission_id: (r.n_same, r.n_changed, r.n_removed, r.n_added) for r in core.QUERIES["f1_altered"](spark, str(tmp_path)).collect()}
    assert got == {0: (2, 0, 0, 0), 1: (2, 1, 0, 0), 2: (2, 2, 2, 0), 3: (1, 1, 1, 0), 4: (1, 0, 0, 0)}

    # All kinds by brute force: the same lines are a longest common subsequence here, the others are paired in each gap.
    def longest(a, b):
        return 0 if not a or not b else 1 + longest(a[1:], b[1:]) if a[0] == b[0] else max(longest(a[1:], b), longest(a, b[1:]))

    for x, y in (("a\nb\nc", "a\nc"), ("a\nc", "a\nb\nc"), ("a\nb\nc", "a\nx\ny\nc"), ("a\nb", "c")):
        n = {k: sum(t[0] == k for t in diff.line_tags(x, y)) for k in ("same", "changed", "removed", "added")}
        a, b = x.split("\n"), y.split("\n")
        assert n["same"] == longest(a, b) and n["same"] + n["changed"] + n["removed"] == len(a) and n["same"] + n["changed"] + n["added"] == len(b)
