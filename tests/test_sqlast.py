import pytest
from hypothesis import given
from hypothesis import strategies as st

from sqlloom import corpus
from sqlloom.sqlast import rewrites as W
from sqlloom.sqlast.facts import facts
from sqlloom.sqlast.nodes import render
from sqlloom.sqlast.parser import ParseError, parse
from sqlloom.sqlast.split import normalize, segments, strip_commands


@pytest.mark.parametrize("t", corpus.TEMPLATES, ids=lambda t: t.sql[:40])
def test_templates(t):
    row, _ = facts(segments(t.sql.replace("@K", "7").replace("@Q", "9"))[0][0][0], t.kind == "PLSQL")
    assert row["statement_type"] == t.kind and (row["parse_status"] == "ok") == t.ok
    if t.ok:
        assert ",".join(row["tables"]) == t.tables and ",".join(row["flags"]) == t.flags and row["restriction_kind"] == t.restriction and row["has_where"] == t.has_where


@pytest.mark.parametrize("sql", ["", "SELECT", "SELECT a FROM", "SELECT 'x FROM t", "UPDATE t", "DELETE", "SELECT a FROM t WHERE", "SELECT a FROM t WHERE (a = 1", "hello world", "(" * 500 + "1"])
def test_unreadable(sql):
    with pytest.raises(ParseError):
        parse(sql)


@pytest.mark.parametrize("sql", ["SELECT A.X, COUNT(*) AS N FROM T A LEFT JOIN U B ON A.I = B.I WHERE A.X IN (1, 2) AND NOT EXISTS (SELECT 1 FROM V) GROUP BY A.X HAVING COUNT(*) > 1 ORDER BY 2 DESC", "UPDATE T SET A = 1, B = 'x''y' WHERE (A = 1 OR B = 2) AND C LIKE '%z' ESCAPE '!'", "INSERT INTO T (A, B) VALUES (1, -2)", "SELECT X FROM (SELECT Y FROM T) Q UNION ALL SELECT Z FROM U"])
def test_rendering_is_stable(sql):
    assert render(parse(sql)) == sql == render(parse(render(parse(sql))))


def test_long_chains_need_no_recursion():
    n = 1500
    tree = parse("SELECT 1 FROM t WHERE " + " OR ".join(f"a = {i}" for i in range(n)))
    assert facts(render(tree))[0]["or_count"] == n - 1 and W.find(tree) == []
    assert len(W.find(parse("SELECT 1 FROM t WHERE " + " OR ".join(f"a = {i}" for i in range(1000))))) == 1
    assert len(parse("SELECT 1 FROM t WHERE " + " AND ".join(f"a = {i}" for i in range(n))).where.args) == n


def test_splitting():
    found, commands = segments("SET PAGESIZE 0\r\nSPOOL x.lst\nSELECT ';' FROM t; -- a;b\nBEGIN\n  x;\nEND;\n/\nUPDATE t\nSET a = 1\nWHERE b = 2")
    assert [b for _, b in found] == [False, True, False] and commands == ["SET PAGESIZE 0", "SPOOL x.lst"]
    assert strip_commands("SELECT 1 FROM t\nSTART WITH a = 1\nCONNECT BY PRIOR a = b").commands == []


@given(st.text(max_size=60))
def test_normalising_is_idempotent_and_nothing_fails(text):
    once = normalize(text)
    assert normalize(once) == once
    segments(text)
    facts(text)


@pytest.mark.parametrize(
    "before, example, status",
    [("SUBSTR(a,1,2) = 'ab'", "a LIKE 'ab%'", "verified"), ("SUBSTR(a,1,2) = 'ab'", "a LIKE '%ab%'", "corrected"), ("SUBSTR(a,1,3) = 'ab'", "a LIKE 'ab%'", "unverified"), ("SUBSTR(a,1,2) = 'a%'", "a LIKE 'a%%'", "unverified"),
     ("TRUNC(d) = x", "d = x", "unverified"), ("WHERE a = 1 OR a = 2", "a IN (1, 2)", "verified"), ("a = 1 OR b = 2", "a IN (1, 2)", "unverified"), ("c = 3 AND SUBSTR(a,2,2) = 'x'''", "a LIKE '_x''%' AND c = 3", "verified")],
)
def test_fragments(before, example, status):
    assert W.verify_fragment(before, example)[0] == status


def test_full_rewrites():
    q = "SELECT x FROM t LEFT JOIN u ON t.i = u.i AND u.k = 1 WHERE t.a = 1 OR t.a = 2"
    assert W.explain_change(parse(q), parse(q.replace("t.a = 1 OR t.a = 2", "t.a IN (1, 2)"))) is None
    assert W.explain_change(parse(q), parse("SELECT x FROM t LEFT JOIN u ON t.i = u.i WHERE (t.a = 1 OR t.a = 2) AND u.k = 1")) == "predicate_lost"
    assert W.explain_change(parse("SELECT x FROM t WHERE NOT (a = 1)"), parse("SELECT x FROM t WHERE a = 1")) == "predicate_lost"


def test_rewrites_give_the_same_rows(spark):
    rows = spark.createDataFrame([("abc", 1), ("xab", 2), (None, 3), ("ab", None), ("a", 2), ("ABc", 1)], "a string, n int")
    for before in ("SUBSTR(a, 1, 2) = 'ab'", "SUBSTR(a, 2, 2) = 'ab'", "n = 1 OR n = 2 OR n = 7"):
        _, after, _ = W.verify_fragment(before, "")
        assert sorted(map(str, rows.where(before).collect())) == sorted(map(str, rows.where(after).collect()))
