"""Facts of one statement, as plain values for a DataFrame row.

Design choices where the reading of a tree allows several: CASE and CAST over a column count
as functions on the column, EXISTS doesn't; text of findings is the canonical rendering.
"""

from __future__ import annotations

import re
from collections import Counter
from typing import Any

from sqlloom.sqlast.nodes import QUERY, Node, render
from sqlloom.sqlast.parser import ParseError, parse

AGGREGATES = frozenset("COUNT SUM AVG MIN MAX LISTAGG STDDEV VARIANCE MEDIAN".split())
_FIRST = re.compile(r"\s*(?:/\*.*?\*/\s*|--[^\n]*\n\s*)*([A-Za-z]+)", re.S)
_TYPES = {"SELECT": "SELECT", "WITH": "SELECT", "UPDATE": "UPDATE", "DELETE": "DELETE", "INSERT": "INSERT", "MERGE": "MERGE"}
_LITERAL = re.compile(r"'(?:[^']|'')*'")
_HINT = re.compile(r"/\*\+.*?\*/", re.S), re.compile(r"--\+[^\n]*")
_PARALLEL = re.compile(r"\bPARALLEL(?:_INDEX)?\b", re.I)
_AFTER = re.compile(r"\b(?:FROM|JOIN|UPDATE|INTO)\s+((?:\"?[\w$#]+\"?\.)*\"?[\w$#]+\"?)", re.I)
RANK = {"where": 0, "source_where": 1, "join_on_constant": 2, "join_on_outer_constant": 3, "join_on_only": 4}


def blank_literals(sql: str) -> str:
    """Same length, with the insides of string literals blanked."""
    return _LITERAL.sub(lambda m: "'" + " " * (len(m.group()) - 2) + "'", sql)


def parallel_hint(sql: str) -> str | None:
    """The first hint text that asks for parallel execution, block hints before line hints."""
    blank = blank_literals(sql)
    for pattern in _HINT:
        for m in pattern.finditer(blank):
            if _PARALLEL.search(m.group()):
                return sql[m.start() : m.end()]
    return None


def branches(n: Node) -> list[Node]:
    """Top-level SELECTs of a query, in order."""
    out, todo = [], [n]
    while todo:
        x = todo.pop()
        if x.kind == "setop":
            todo += [x.right, x.left]
        elif x.kind == "select":
            out.append(x)
    return out


def _real_source(s: Node) -> bool:
    return s.source is not None and not (s.source.kind == "table" and s.source.name == "DUAL" and not s.joins)


def _has_literal(n: Node | None) -> bool:
    return n is not None and any(x.kind in ("lit", "bind") and x.kind == "lit" for x in n.walk())


def _query_of(n: Node) -> Node | None:
    if n.kind in QUERY:
        return n
    return n.query if n.kind == "insert" else None


def restriction(s: Node, ctes: dict[str, Node], level: int = 0) -> str | None:
    """How a SELECT branch is restricted: the evidence of its own WHERE, its first source, or its joins."""
    if s.where is not None:
        return "where"
    inner = None
    if s.source is not None and s.source.kind == "derived" and s.source.query.kind in QUERY:
        inner = s.source.query
    elif s.source is not None and s.source.kind == "table" and s.source.name in ctes and ctes[s.source.name].kind == "select" and level == 0:
        inner = ctes[s.source.name]
    if inner is not None and any(restriction(b, ctes, level + 1) for b in branches(inner)):
        return "source_where"
    found = None
    for j in s.joins:
        outer = j.how in ("LEFT", "RIGHT", "FULL")
        if j.on is None and not j.using:
            continue
        kind = "join_on_only" if not _has_literal(j.on) else "join_on_outer_constant" if outer else "join_on_constant"
        if found is None or RANK[kind] < RANK[found]:
            found = kind
    return found


def source_kind(s: Node, ctes: dict[str, Node]) -> str | None:
    """The evidence inside the first source that ``source_where`` hides."""
    q = s.source.query if s.source is not None and s.source.kind == "derived" and s.source.query.kind in QUERY else ctes.get(s.source.name) if s.source is not None and s.source.kind == "table" else None
    if q is None:
        return None
    kinds = [k for b in branches(q) if (k := restriction(b, ctes, 1))]
    return min(kinds, key=RANK.__getitem__) if kinds else None


def scopes(n: Node) -> list[Node]:
    """Conditions of a statement: WHERE, HAVING and ON of top-level branches, of changes, and ON of MERGE."""
    q = _query_of(n)
    if q is not None:
        return [c for s in branches(q) for c in (s.where, *(j.on for j in s.joins), s.having) if c is not None]
    if n.kind in ("update", "delete"):
        return [n.where] if n.where is not None else []
    return [n.on] if n.kind == "merge" else []


def _columns(n: Node) -> list[Node]:
    return [x for x in n.walk() if x.kind == "col" and x.name not in ("SYSDATE", "SYSTIMESTAMP", "ROWNUM", "USER", "LEVEL")]


def _function_sides(p: Node) -> list[Node]:
    if p.kind == "cmp":
        return [p.left, p.right]
    if p.kind in ("like",):
        return [p.left, p.right]
    return [p.left] if p.kind in ("between", "in", "isnull") else []


def _leftmost(n: Node) -> Node:
    while n.kind == "bin" and n.op == "||":
        n = n.left
    return n


def _aliases(s: Node) -> set[str]:
    out = set()
    for item in [s.source, *(j.item for j in s.joins)]:
        if item is not None:
            out |= {item.alias} if item.alias else set()
            out |= {item.name} if item.kind == "table" else set()
    return out


def _correlated(q: Node, outside: set[str]) -> bool:
    for s in branches(q):
        own = _aliases(s)
        if s.where is not None and any(c.table and c.table not in own and c.table in outside for c in _columns(s.where)):
            return True
    return False


def _table_names(n: Node) -> set[str]:
    """What columns may name the tables of a tree by: the alias, else the name."""
    return {x.alias or x.name for x in n.walk() if x.kind == "table"}


def _flags(n: Node, everything: list[Node]) -> set[str]:
    """Set operations anywhere; everything else of the top-level branches of queries, with all that is nested in them."""
    out: set[str] = set()
    for x in everything:
        if x.kind == "setop":
            out |= {"set_operation"} if x.all else {"set_operation", "distinct_or_union"}
    if n.kind not in QUERY:
        return out
    names = _table_names(n)
    for s in branches(n):
        if s.distinct:
            out.add("distinct")
        if any(e.kind == "star" and not e.table for e, _ in s.items):
            out.add("select_star")
        if s.group or any(f.kind == "func" and f.name in AGGREGATES for e, _ in s.items for f in e.walk()):
            out.add("group_by_aggregate")
        if s.connect is not None:
            out.add("connect_by")
        for j in s.joins:
            if j.how in ("LEFT", "RIGHT", "FULL"):
                out.add("outer_join")
            if j.on is None and not j.using and j.how != "CROSS":
                out.add("cartesian_join")
        for x in everything if s is n else s.walk():
            if x.kind == "func" and x.get("over") is not None:
                out.add("window_function")
            elif x.kind == "col":
                if x.get("outer"):
                    out.add("outer_join")
                if x.name == "ROWNUM":
                    out.add("rownum")
            elif x.kind == "in" and x.neg and x.query is not None or x.kind == "not" and x.arg.kind == "in" and x.arg.query is not None:
                out.add("not_in_subquery")
            elif x.kind == "select" and x is not s and x.where is not None and "correlated_subquery" not in out:
                own = _table_names(x)
                if any(c.table and c.table not in own and c.table in names for c in _columns(x.where)):
                    out.add("correlated_subquery")
    return out


def normal_column(c: Node) -> str:
    return f"{c.table}.{c.name}" if c.table else c.name


def cross_column_or(n: Node) -> bool:
    """An OR, taken with all it is nested in, that touches more than one column."""
    for scope in scopes(n):
        for x in scope.walk():
            if x.kind == "or" and len({normal_column(c) for c in _columns(x)}) > 1:
                return True
    return False


def _tables(n: Node) -> frozenset[str]:
    return frozenset(x.name for x in n.walk() if x.kind == "table")


def _pattern_flags(n: Node) -> set[str]:
    if n.kind not in QUERY:
        return set()
    out: set[str] = set()
    if cross_column_or(n):
        out.add("cross_column_or")
    every: set[str] = set()
    for x in n.walk():
        if x.kind == "select":
            every |= _aliases(x)
    for scope in scopes(n):
        for p in scope.walk():
            if p.kind in ("cmp", "like", "in") and any(y.kind == "bin" and y.op == "||" and _columns(y) for side in _function_sides(p) for y in side.walk()):
                out.add("string_concat_predicate")
            if p.kind == "cmp" and p.op == "=":
                left, right = ({c.table for c in _columns(side) if c.table} for side in (p.left, p.right))
                nested = any(y.kind in ("scalar", "exists") for y in p.walk())
                if left and right and left != right and not nested and (p.left.kind != "col" or p.right.kind != "col"):
                    out.add("column_expression_join")
    maxima: Counter = Counter()
    aggregates: Counter = Counter()
    for x in n.walk():
        if x.kind == "scalar" and x.query.kind == "select" and len(x.query.items) == 1:
            e = x.query.items[0][0]
            if e.kind == "func" and e.name in AGGREGATES:
                correlated = _correlated(x.query, every)
                if e.name == "MAX" and correlated:
                    maxima[_tables(x.query)] += 1
                else:
                    aggregates[_tables(x.query)] += 1
    if any(k >= 2 for k in maxima.values()):
        out.add("repeated_correlated_max_subquery")
    if any(k >= 2 for k in aggregates.values()):
        out.add("repeated_scalar_aggregate")
    if n.kind == "setop":
        sources = Counter(_tables(b) for b in branches(n))
        if any(k >= 2 for t, k in sources.items() if t):
            out.add("repeated_source_set_operation")
    return out


def signature(n: Node) -> dict[str, Any] | None:
    q = _query_of(n)
    if q is None:
        return None
    bs = branches(q)
    calls = [f.name for s in bs for e, _ in s.items for f in e.walk(QUERY) if f.kind == "func" and f.name in AGGREGATES]
    return {
        "select_count": sum(len(s.items) for s in bs),
        "distinct": any(s.distinct for s in bs),
        "group_by_count": sum(len(s.group) for s in bs),
        "having": any(s.having is not None for s in bs),
        "order_by": bool(q.get("order")) or any(s.order for s in bs),
        "agg_funcs": sorted(calls),
        "join_sides": [j.how for s in bs for j in s.joins],
    }


def skeleton(n: Node) -> str:
    """The statement with every condition replaced by TRUE."""
    true = Node("raw", text="TRUE")
    hidden = {"select": ("where", "having"), "join": ("on",), "update": ("where",), "delete": ("where",)}

    def fold(x: Any) -> Any:
        kind = x.__class__
        if kind is Node:
            drop = hidden.get(x.kind, ())
            return Node(x.kind, **{k: v if v is None or v.__class__ is str else true if k in drop else fold(v) for k, v in x.f.items()})
        if kind is list:
            return [fold(v) for v in x]
        return tuple(fold(v) for v in x) if kind is tuple else x

    return render(fold(n))


def guess_type(sql: str) -> str:
    m = _FIRST.match(sql)
    return _TYPES.get(m.group(1).upper(), "UNKNOWN") if m else "UNKNOWN"


def guess_tables(sql: str) -> list[str]:
    plain = re.sub(r"/\*.*?\*/|--[^\n]*", " ", blank_literals(sql), flags=re.S)
    return sorted({m.rpartition(".")[2].strip('"').upper() for m in _AFTER.findall(plain)})


def facts(sql: str, block: bool = False) -> tuple[dict[str, Any], Node | None]:
    """One row of facts, and the tree where there is one."""
    tree = None
    error = "plsql" if block else None
    if not block:
        try:
            tree = parse(sql)
        except ParseError as e:
            error = str(e)[:80]
    out: dict[str, Any] = {
        "statement_type": "PLSQL" if block else guess_type(sql), "parse_status": "ok" if tree else "failed", "parse_error": error,
        "tables": [], "base_tables": [], "where_applicable": False, "has_where": None, "restriction_kind": None, "source_evidence_kind": None, "hint": parallel_hint(sql),
        "or_count": 0, "like_hits": [], "function_hits": [], "flags": [], "signature": None, "skeleton": None,
    }
    if tree is None:
        out["tables"] = out["base_tables"] = guess_tables(sql)
        out["where_applicable"] = out["statement_type"] in ("SELECT", "UPDATE", "DELETE", "UNKNOWN")
        return out, None
    n = tree
    out["statement_type"] = "SELECT" if n.kind in QUERY else n.kind.upper()
    everything = list(n.walk())
    out["tables"] = sorted({x.name for x in everything if x.kind == "table"})
    ctes = {c: body for x in everything if x.kind in QUERY for c, body in (x.get("ctes") or [])}
    out["base_tables"] = [t for t in out["tables"] if t not in ctes]
    q = _query_of(n)
    if q is not None:
        applicable = [s for s in branches(q) if _real_source(s)]
        out["where_applicable"] = bool(applicable)
        if applicable:
            out["has_where"] = all(s.where is not None for s in applicable)
            if n.kind in QUERY and not out["has_where"]:
                kinds = [restriction(s, ctes) for s in applicable]
                if all(kinds):
                    out["restriction_kind"] = max(kinds, key=RANK.__getitem__)
                    if out["restriction_kind"] == "source_where":
                        out["source_evidence_kind"] = next((k for s, r in zip(applicable, kinds) if r == "source_where" and (k := source_kind(s, ctes))), None)
    elif n.kind in ("update", "delete"):
        out["where_applicable"], out["has_where"] = True, n.where is not None
    likes, functions, ors = [], [], 0
    for scope in scopes(n):
        for p in scope.walk():
            if p.kind == "or":
                ors += len(p.args) - 1
            elif p.kind == "like":
                first = _leftmost(p.right)
                if first.kind == "lit" and first.text[1:2] in ("%", "_"):
                    text = first.text[1:-1]
                    likes.append(text if len(text) <= 12 else text[:12] + "…")
            for side in _function_sides(p):
                if side.kind in ("func", "case", "cast") and _columns(side):
                    functions.append(render(side))
    out["or_count"], out["like_hits"], out["function_hits"] = ors, likes, list(dict.fromkeys(functions))
    out["flags"] = sorted(_flags(n, everything) | _pattern_flags(n))
    out["signature"], out["skeleton"] = signature(n), skeleton(n)
    return out, n
