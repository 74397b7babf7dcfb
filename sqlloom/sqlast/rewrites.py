"""Rewrites of predicates whose results are provably the same, and checks of proposed ones."""

from __future__ import annotations

import re
from collections import Counter

from sqlloom.sqlast.facts import scopes
from sqlloom.sqlast.nodes import QUERY, Node, render
from sqlloom.sqlast.parser import ParseError, parse

IN_LIMIT = 1000
#: Rewrite rule, the analysis rule it answers, and its title.
RULES = (("substr_eq_to_like", "R005", "SUBSTR comparison as LIKE"), ("or_eq_to_in", "R006", "OR chain on one column as IN list"))


def _int(n: Node) -> int | None:
    return int(n.text) if n.kind == "lit" and n.type == "number" and re.fullmatch(r"\d+", n.text) else None


def substr_to_like(p: Node) -> Node | None:
    """``SUBSTR(col, p, n) = 'v'`` with n characters in v as LIKE with p-1 leading single wildcards."""
    if p.kind != "cmp" or p.op != "=":
        return None
    for a, b in ((p.left, p.right), (p.right, p.left)):
        if a.kind == "func" and a.name == "SUBSTR" and len(a.args) == 3 and a.args[0].kind == "col" and not a.args[0].get("outer") and b.kind == "lit" and b.type == "string" and b.text[0] == "'":
            at, n = _int(a.args[1]), _int(a.args[2])
            value = b.text[1:-1].replace("''", "'")
            if at and n and at >= 1 and len(value) == n and not re.search("[%_]", value):
                text = "'" + "_" * (at - 1) + value.replace("'", "''") + "%'"
                return Node("like", left=a.args[0], right=Node("lit", type="string", text=text), escape=None, neg=False)
    return None


def _disjuncts(n: Node) -> list[Node]:
    out, todo = [], [n]
    while todo:
        x = todo.pop()
        if x.kind == "or":
            todo += reversed(x.args)
        else:
            out.append(x)
    return out


def conjuncts(n: Node) -> list[Node]:
    out, todo = [], [n]
    while todo:
        x = todo.pop()
        if x.kind == "and":
            todo += reversed(x.args)
        else:
            out.append(x)
    return out


def or_to_in(p: Node) -> Node | None:
    """A chain ``c = x OR c = y`` on one column, 2 to 1000 values in source order, as an IN list."""
    if p.kind != "or":
        return None
    values, column = [], None
    for d in _disjuncts(p):
        if d.kind != "cmp" or d.op != "=":
            return None
        c, v = (d.left, d.right) if d.left.kind == "col" else (d.right, d.left)
        if c.kind != "col" or c.get("outer") or v.kind not in ("lit", "bind") or column is not None and render(c) != render(column):
            return None
        column = c
        values.append(v)
    return Node("in", left=column, query=None, items=values, neg=False) if 2 <= len(values) <= IN_LIMIT else None


_APPLY = {"substr_eq_to_like": substr_to_like, "or_eq_to_in": or_to_in}


def derive(p: Node) -> list[tuple[str, str, str]]:
    """(rule, before, after) of one predicate."""
    return [(rule, render(p), render(new)) for rule, _, _ in RULES if (new := _APPLY[rule](p)) is not None]


def find(tree: Node) -> list[tuple[str, str, str]]:
    """Rewrites of the conjuncts in all SELECTs with a real source, without repeats."""
    out: dict[tuple[str, str, str], None] = {}
    for s in tree.walk():
        if s.kind != "select" or s.source is None:
            continue
        for scope in (s.where, *(j.on for j in s.joins), s.having):
            for c in conjuncts(scope) if scope is not None else ():
                out.update(dict.fromkeys(derive(c)))
    return list(out)


def anywhere(tree: Node) -> set[str]:
    """Rules that apply to any node of the tree, an OR only where no OR holds it."""
    return {rule for n in tree.walk() for rule, _, _ in derive(n)}


def _fragment(text: str) -> Node | None:
    body = re.sub(r"^\s*(?:WHERE|ON|AND|HAVING)\b", "", text.strip().rstrip(";"), flags=re.I)
    try:
        return parse("SELECT 1 FROM T WHERE " + body).where
    except ParseError:
        return None


def verify_fragment(before: str, example: str) -> tuple[str, str | None, str | None]:
    """(verified, corrected or unverified; the text that is right; the rules used) of a proposed rewrite of a condition."""
    a, b = _fragment(before), _fragment(example)
    if a is None:
        return "unverified", None, None
    expected, rules = [], []
    for c in conjuncts(a):
        if found := derive(c):
            rules.append(found[0][0])
            expected.append(found[0][2])
        else:
            expected.append(render(c))
    if not rules:
        return "unverified", None, None
    right = " AND ".join(expected)
    if b is not None and Counter(render(c) for c in conjuncts(b)) == Counter(expected):
        return "verified", right, ",".join(dict.fromkeys(rules))
    return "corrected", right, ",".join(dict.fromkeys(rules))


def _atoms(tree: Node) -> list[tuple[int, str, Node]]:
    """Predicates by scope, inline views and other subqueries included, with their polarity in the key."""
    out = []
    inner = [c for s in tree.walk() if s.kind == "select" for c in (s.where, *(j.on for j in s.joins), s.having) if c is not None]
    for k, scope in enumerate(inner if query_only(tree) else scopes(tree)):
        todo = [(scope, False)]
        while todo:
            n, neg = todo.pop()
            if n.kind == "and":
                todo += [(x, neg) for x in n.args]
            elif n.kind == "not":
                todo.append((n.arg, not neg))
            else:
                out.append((k, ("NOT " if neg else "") + render(n), n))
    return out


def explain_change(original: Node, suggested: Node) -> str | None:
    """Why a full rewrite isn't proved: a predicate was lost, added, or changed in a way no rule derives; None if proved."""
    a, b = _atoms(original), _atoms(suggested)
    old, new = {(k, t) for k, t, _ in a}, {(k, t) for k, t, _ in b}
    allowed = set()
    for k, t, n in a:
        if (k, t) in new:
            continue
        found = [] if t.startswith("NOT ") else [x for _, _, x in derive(n)]
        hit = next((x for x in found if (k, x) in new), None)
        if hit is None:
            return "predicate_changed" if found else "predicate_lost"
        allowed.add((k, hit))
    return "predicate_added" if new - old - allowed else None


STRUCTURE_FLAGS = ("set_operation", "distinct_or_union", "distinct", "select_star", "group_by_aggregate", "window_function", "connect_by", "outer_join", "cartesian_join", "correlated_subquery")


def query_only(n: Node) -> bool:
    return n.kind in QUERY
