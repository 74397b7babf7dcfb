"""Syntax tree of a statement: one node type with a kind, named fields and a canonical text."""

from __future__ import annotations

from collections.abc import Iterator
from typing import Any


class Node:
    __slots__ = ("kind", "f", "below")

    def __init__(self, kind: str, **fields: Any):
        self.kind, self.f, self.below = kind, fields, None

    def __getattr__(self, name: str) -> Any:
        try:
            return self.f[name]
        except KeyError:
            raise AttributeError(name) from None

    def get(self, name: str, default: Any = None) -> Any:
        return self.f.get(name, default)

    def children(self) -> tuple[Node, ...]:
        """Nodes right below in source order, kept once asked for: a tree doesn't change after it is read."""
        if self.below is None:
            out: list[Node] = []
            for v in self.f.values():
                if v.__class__ is Node:
                    out.append(v)
                elif v.__class__ is list or v.__class__ is tuple:
                    _nodes(v, out)
            self.below = tuple(out)
        return self.below

    def walk(self, stop: frozenset[str] = frozenset()) -> Iterator[Node]:
        """This node and all below in source order, without recursion; below nodes of a kind in ``stop`` it doesn't go."""
        todo = [self]
        while todo:
            n = todo.pop()
            yield n
            if n is self or n.kind not in stop:
                todo.extend(n.children()[::-1])


def _nodes(v: list | tuple, out: list[Node]) -> None:
    for x in v:
        if x.__class__ is Node:
            out.append(x)
        elif x.__class__ is list or x.__class__ is tuple:
            _nodes(x, out)


QUERY = frozenset(("select", "setop"))


def _many(xs: list[Node], sep: str = ", ") -> str:
    return sep.join(render(x) for x in xs)


def _operand(n: Node) -> str:
    text = render(n)
    return f"({text})" if n.kind in ("and", "or", "not", "cmp", "like", "in", "between", "isnull") or n.kind in QUERY else text


def render(n: Node) -> str:
    """Canonical text: upper-case words, single blanks, brackets only where they bind."""
    k = n.kind
    if k == "col":
        return ".".join(x for x in (n.table, n.name) if x) + ("(+)" if n.get("outer") else "")
    if k in ("lit", "bind", "raw"):
        return n.text
    if k == "star":
        return f"{n.table}.*" if n.table else "*"
    if k == "func":
        return f"{n.name}({'DISTINCT ' if n.get('distinct') else ''}{_many(n.args)})" + (f" OVER ({n.over_text})" if n.get("over") is not None else "")
    if k == "cast":
        return f"CAST({render(n.arg)} AS {n.type})"
    if k == "case":
        body = " ".join(f"WHEN {render(a)} THEN {render(b)}" for a, b in n.whens)
        return f"CASE{' ' + render(n.arg) if n.arg else ''} {body}{' ELSE ' + render(n.default) if n.default else ''} END"
    if k == "bin":
        return f"{_operand(n.left) if n.left.kind != 'bin' or n.left.op == n.op else '(' + render(n.left) + ')'} {n.op} {_operand(n.right) if n.right.kind != 'bin' else '(' + render(n.right) + ')'}"
    if k == "neg":
        return f"-{_operand(n.arg)}"
    if k == "and":
        return " AND ".join(f"({render(x)})" if x.kind == "or" else render(x) for x in n.args)
    if k == "or":
        return " OR ".join(render(x) for x in n.args)
    if k == "not":
        return f"NOT {_operand(n.arg)}"
    if k == "cmp":
        return f"{_operand(n.left)} {n.op} {_operand(n.right)}"
    no = "NOT " if n.get("neg") else ""
    if k == "like":
        return f"{_operand(n.left)} {no}LIKE {_operand(n.right)}" + (f" ESCAPE {render(n.escape)}" if n.escape else "")
    if k == "in":
        return f"{_operand(n.left)} {no}IN ({render(n.query) if n.query else _many(n.items)})"
    if k == "between":
        return f"{_operand(n.left)} {no}BETWEEN {_operand(n.low)} AND {_operand(n.high)}"
    if k == "isnull":
        return f"{_operand(n.left)} IS {no}NULL"
    if k == "exists":
        return f"EXISTS ({render(n.query)})"
    if k == "scalar":
        return f"({render(n.query)})"
    if k == "tuple":
        return f"({_many(n.items)})"
    if k == "table":
        return ".".join(x for x in (n.schema, n.name) if x) + (f"@{n.link}" if n.link else "") + (f" {n.alias}" if n.alias else "")
    if k == "derived":
        return f"({render(n.query)})" + (f" {n.alias}" if n.alias else "")
    if k == "join":
        head = {"COMMA": ",", "INNER": " JOIN"}.get(n.how, f" {n.how} JOIN")
        return f"{head} {render(n.item)}" + (f" ON {render(n.on)}" if n.on else "") + (f" USING ({', '.join(n.using)})" if n.using else "")
    if k == "select":
        out = ("WITH " + ", ".join(f"{c} AS ({render(q)})" for c, q in n.ctes) + " ") if n.ctes else ""
        out += "SELECT " + ("DISTINCT " if n.distinct else "") + ", ".join(render(e) + (f" AS {a}" if a else "") for e, a in n.items)
        if n.source:
            out += f" FROM {render(n.source)}" + "".join(render(j) for j in n.joins)
        for word, part in (("WHERE", n.where), ("START WITH", n.start), ("CONNECT BY", n.connect)):
            out += f" {word} {render(part)}" if part else ""
        out += f" GROUP BY {_many(n.group)}" if n.group else ""
        out += f" HAVING {render(n.having)}" if n.having else ""
        return out + (" ORDER BY " + ", ".join(render(e) + d for e, d in n.order) if n.order else "")
    if k == "setop":
        return f"{render(n.left)} {n.op}{' ALL' if n.all else ''} {render(n.right)}" + (" ORDER BY " + ", ".join(render(e) + d for e, d in n.order) if n.order else "")
    if k == "update":
        return f"UPDATE {render(n.target)} SET " + ", ".join(f"{render(a)} = {render(b)}" for a, b in n.sets) + (f" WHERE {render(n.where)}" if n.where else "")
    if k == "delete":
        return f"DELETE FROM {render(n.target)}" + (f" WHERE {render(n.where)}" if n.where else "")
    if k == "insert":
        return f"INSERT INTO {render(n.target)}" + (f" ({', '.join(n.columns)})" if n.columns else "") + (f" {render(n.query)}" if n.query else f" VALUES ({_many(n.values)})")
    return k.upper()
