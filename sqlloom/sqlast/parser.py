"""Recursive descent parser for the statements the engine analyses.

It covers SELECT with set operations, CTEs, joins, hierarchical and grouped queries,
UPDATE, DELETE, INSERT and MERGE in the Oracle flavour. Chains of AND and OR are read in a
loop into n-ary nodes, so that very long chains need no recursion. What it can't read raises
``ParseError``; callers turn that into a failed statement, never a guess.
"""

from __future__ import annotations

import sys

from sqlloom.sqlast.lexer import Token, tokens
from sqlloom.sqlast.nodes import Node


class ParseError(ValueError):
    pass


_SET = {"UNION": "UNION", "MINUS": "EXCEPT", "EXCEPT": "EXCEPT", "INTERSECT": "INTERSECT"}
_CLAUSE = frozenset("FROM WHERE GROUP HAVING ORDER CONNECT START UNION MINUS EXCEPT INTERSECT ON USING LEFT RIGHT FULL INNER CROSS JOIN NATURAL SET VALUES SELECT WHEN THEN ELSE END AND OR NOT IN IS LIKE BETWEEN EXISTS INTO AS FOR FETCH OFFSET RETURNING WITH LOG LIMIT ESCAPE BY ASC DESC".split())
_COMPARE = frozenset(("=", "<>", "!=", "^=", "<", "<=", ">", ">="))
_PLAIN = frozenset(("word", "op"))
_MAX_DEPTH = 3000  # levels of brackets; more than any C frame of a worker could walk


class Parser:
    def __init__(self, toks: list[Token]):
        self.t = [(x.kind, x.text.upper() if x.kind == "word" else x.text) for x in toks]
        self.i, self.depth = 0, 0

    # --- tokens ---
    def peek(self, k: int = 0) -> str:
        return self.t[self.i + k][1] if self.i + k < len(self.t) else ""

    def kind(self, k: int = 0) -> str:
        return self.t[self.i + k][0] if self.i + k < len(self.t) else "end"

    def at(self, word: str, *more: str) -> bool:
        t, i = self.t, self.i
        if i >= len(t) or t[i][1] != word or t[i][0] not in _PLAIN:
            return False
        for k, w in enumerate(more, i + 1):
            if k >= len(t) or t[k][1] != w or t[k][0] not in _PLAIN:
                return False
        return True

    def take(self, *words: str) -> bool:
        if self.at(*words):
            self.i += len(words)
            return True
        return False

    def need(self, *words: str) -> None:
        if not self.take(*words):
            raise ParseError(f"{' '.join(words)} expected at {self.peek() or 'the end'}")

    def name(self) -> str:
        kind, text = self.t[self.i] if self.i < len(self.t) else ("end", "")
        if kind == "quoted":
            self.i += 1
            return text[1:-1].upper() if text[1:-1].replace("_", "a").isalnum() else text
        if kind == "word" and text not in _CLAUSE:
            self.i += 1
            return text
        raise ParseError(f"name expected at {text or 'the end'}")

    # --- statements ---
    def statement(self) -> Node:
        w = self.peek()
        if w in ("SELECT", "WITH", "("):
            out = self.query()
        elif w == "UPDATE":
            out = self.update()
        elif w == "DELETE":
            out = self.delete()
        elif w == "INSERT":
            out = self.insert()
        elif w == "MERGE":
            out = self.merge()
        else:
            raise ParseError(f"no statement begins with {w}")
        self.take(";")
        if self.i < len(self.t):
            raise ParseError(f"unexpected {self.peek()}")
        return out

    def query(self) -> Node:
        self.depth += 1
        if self.depth > _MAX_DEPTH:
            raise ParseError("nested too deeply")
        ctes = []
        if self.take("WITH"):
            while True:
                c = self.name()
                if self.take("("):
                    while not self.take(")"):
                        self.i += 1
                        if self.i >= len(self.t):
                            raise ParseError("open bracket")
                self.need("AS")
                self.need("(")
                ctes.append((c, self.query()))
                self.need(")")
                if not self.take(","):
                    break
        out = self.term()
        while self.peek() in _SET and self.kind() == "word":
            op = _SET[self.peek()]
            self.i += 1
            everything = self.take("ALL")
            out = Node("setop", left=out, right=self.term(), op=op, all=everything, order=[])
        order = self.order()
        if self.take("FOR", "UPDATE"):
            while self.i < len(self.t) and self.peek() not in (")", ";"):
                self.i += 1
        if self.peek() in ("OFFSET", "FETCH"):
            while self.i < len(self.t) and self.peek() not in (")", ";"):
                self.i += 1
        if order:
            out.f["order"] = order
        if ctes:
            if out.kind == "select":
                out.f["ctes"] = ctes
            else:
                out.f["ctes"] = ctes
        self.depth -= 1
        return out

    def term(self) -> Node:
        if self.take("("):
            out = self.query()
            self.need(")")
            return out
        return self.select()

    def order(self) -> list:
        out = []
        if self.take("ORDER"):
            self.take("SIBLINGS")
            self.need("BY")
            while True:
                e = self.expr()
                d = " DESC" if self.take("DESC") else ""
                self.take("ASC")
                if self.take("NULLS"):
                    self.i += 1
                out.append((e, d))
                if not self.take(","):
                    break
        return out

    def select(self) -> Node:
        self.need("SELECT")
        distinct = self.take("DISTINCT") or self.take("UNIQUE")
        self.take("ALL")
        items = []
        while True:
            e = self.expr()
            alias = None
            if self.take("AS") or self.kind() == "quoted" or self.kind() == "word" and self.peek() not in _CLAUSE:
                alias = self.name()
            items.append((e, alias))
            if not self.take(","):
                break
        n = Node("select", ctes=[], distinct=distinct, items=items, source=None, joins=[], where=None, start=None, connect=None, group=[], having=None, order=[])
        if self.take("BULK"):
            self.need("COLLECT")
        if self.take("INTO"):
            while self.i < len(self.t) and not self.at("FROM"):
                self.i += 1
        if self.take("FROM"):
            n.f["source"] = self.item()
            n.f["joins"] = self.joins()
        if self.take("WHERE"):
            n.f["where"] = self.cond()
        for _ in range(2):
            if self.take("START", "WITH"):
                n.f["start"] = self.cond()
            if self.take("CONNECT", "BY"):
                self.take("NOCYCLE")
                n.f["connect"] = self.cond()
        if self.take("GROUP", "BY"):
            group = []
            while True:
                group.append(self.expr())
                if not self.take(","):
                    break
            n.f["group"] = group
        if self.take("HAVING"):
            n.f["having"] = self.cond()
        return n

    def item(self) -> Node:
        if self.take("("):
            if self.peek() in ("SELECT", "WITH", "("):
                q = self.query()
                self.need(")")
                return Node("derived", query=q, alias=self.alias())
            inner = self.item()
            joins = self.joins()
            self.need(")")
            if joins:
                q = Node("select", ctes=[], distinct=False, items=[(Node("star", table=None), None)], source=inner, joins=joins, where=None, start=None, connect=None, group=[], having=None, order=[])
                return Node("derived", query=q, alias=self.alias())
            return inner
        if self.at("TABLE", "("):
            self.i += 2
            e = self.expr()
            self.need(")")
            return Node("derived", query=e, alias=self.alias())
        parts = [self.name()]
        while self.take("."):
            parts.append(self.name())
        link = None
        if self.take("@"):
            link = self.name()
            while self.take("."):
                link += "." + self.name()
        if self.at("PARTITION", "(") or self.at("SAMPLE", "("):
            while not self.take(")"):
                self.i += 1
        return Node("table", schema=".".join(parts[:-1]) or None, name=parts[-1], link=link, alias=self.alias())

    def alias(self) -> str | None:
        if self.take("AS"):
            return self.name()
        return self.name() if self.kind() == "quoted" or self.kind() == "word" and self.peek() not in _CLAUSE else None

    def joins(self) -> list[Node]:
        out = []
        while True:
            if self.take(","):
                out.append(Node("join", how="COMMA", item=self.item(), on=None, using=None))
                continue
            natural = self.take("NATURAL")
            how = None
            for w in ("LEFT", "RIGHT", "FULL"):
                if self.take(w):
                    self.take("OUTER")
                    how = w
            how = how or ("CROSS" if self.take("CROSS") else None) or ("INNER" if self.take("INNER") else None)
            if not self.take("JOIN"):
                if how or natural:
                    raise ParseError("JOIN expected")
                return out
            item = self.item()
            on = using = None
            if self.take("ON"):
                on = self.cond()
            elif self.take("USING"):
                self.need("(")
                using = [self.name()]
                while self.take(","):
                    using.append(self.name())
                self.need(")")
            out.append(Node("join", how=how or ("NATURAL" if natural else "INNER"), item=item, on=on, using=using))

    def target(self) -> Node:
        return self.item()

    def update(self) -> Node:
        self.need("UPDATE")
        target = self.target()
        self.need("SET")
        sets = []
        while True:
            if self.at("("):
                left = self.primary()
            else:
                left = self.column()
            self.need("=")
            sets.append((left, self.expr()))
            if not self.take(","):
                break
        where = self.cond() if self.take("WHERE") else None
        return Node("update", target=target, sets=sets, where=where)

    def delete(self) -> Node:
        self.need("DELETE")
        self.take("FROM")
        target = self.target()
        return Node("delete", target=target, where=self.cond() if self.take("WHERE") else None)

    def insert(self) -> Node:
        self.need("INSERT")
        self.need("INTO")
        parts = [self.name()]
        while self.take("."):
            parts.append(self.name())
        target = Node("table", schema=".".join(parts[:-1]) or None, name=parts[-1], link=None, alias=None)
        if self.kind() == "word" and self.peek() not in _CLAUSE:
            target.f["alias"] = self.name()
        columns = []
        if self.at("(") and self.peek(1) not in ("SELECT", "WITH"):
            self.i += 1
            while True:
                columns.append(self.name())
                if self.take("."):
                    columns[-1] = self.name()
                if not self.take(","):
                    break
            self.need(")")
        if self.take("VALUES"):
            self.need("(")
            values = [self.expr()]
            while self.take(","):
                values.append(self.expr())
            self.need(")")
            return Node("insert", target=target, columns=columns, query=None, values=values)
        return Node("insert", target=target, columns=columns, query=self.query(), values=[])

    def merge(self) -> Node:
        self.need("MERGE", "INTO")
        target = self.target()
        self.need("USING")
        source = self.item()
        self.need("ON")
        wrapped = self.at("(")
        on = self.cond()
        del wrapped
        parts: list[Node] = []
        while self.take("WHEN"):
            neg = self.take("NOT")
            self.need("MATCHED")
            extra = self.cond() if self.take("AND") else None
            self.need("THEN")
            if self.take("UPDATE"):
                self.need("SET")
                sets = []
                while True:
                    left = self.column()
                    self.need("=")
                    sets.append((left, self.expr()))
                    if not self.take(","):
                        break
                where = self.cond() if self.take("WHERE") else None
                if self.take("DELETE"):
                    self.need("WHERE")
                    self.cond()
                parts.append(Node("mergeset", sets=sets, where=where, extra=extra))
            else:
                self.need("INSERT")
                columns = []
                if self.take("("):
                    while True:
                        columns.append(self.column())
                        if not self.take(","):
                            break
                    self.need(")")
                self.need("VALUES")
                self.need("(")
                values = [self.expr()]
                while self.take(","):
                    values.append(self.expr())
                self.need(")")
                where = self.cond() if self.take("WHERE") else None
                parts.append(Node("mergeinsert", columns=columns, values=values, where=where, neg=neg))
        return Node("merge", target=target, source=source, on=on, parts=parts)

    # --- conditions ---
    def cond(self) -> Node:
        ors = [self.conj()]
        while self.take("OR"):
            ors.append(self.conj())
        return ors[0] if len(ors) == 1 else Node("or", args=ors)

    def conj(self) -> Node:
        ands = [self.negation()]
        while self.take("AND"):
            ands.append(self.negation())
        return ands[0] if len(ands) == 1 else Node("and", args=ands)

    def negation(self) -> Node:
        n = 0
        while self.take("NOT"):
            n += 1
        e = self.predicate()
        for _ in range(n):
            e = Node("not", arg=e)
        return e

    def predicate(self) -> Node:
        if self.take("EXISTS"):
            self.need("(")
            q = self.query()
            self.need(")")
            return Node("exists", query=q)
        left = self.expr()
        while True:
            if self.kind() == "op" and self.peek() in _COMPARE:
                op = self.peek()
                self.i += 1
                if self.peek() in ("ANY", "ALL", "SOME") and self.peek(1) == "(":
                    self.i += 1
                left = Node("cmp", op="<>" if op in ("!=", "^=") else op, left=left, right=self.expr())
                continue
            neg = self.at("NOT") and self.peek(1) in ("LIKE", "ILIKE", "IN", "BETWEEN")
            if neg:
                self.i += 1
            if self.take("LIKE") or self.take("ILIKE"):
                right = self.expr()
                left = Node("like", left=left, right=right, escape=self.expr() if self.take("ESCAPE") else None, neg=neg)
            elif self.take("IN"):
                if not self.at("("):
                    left = Node("in", left=left, query=None, items=[self.expr()], neg=neg)
                    continue
                self.need("(")
                if self.peek() in ("SELECT", "WITH"):
                    left = Node("in", left=left, query=self.query(), items=[], neg=neg)
                else:
                    items = [self.expr()]
                    while self.take(","):
                        items.append(self.expr())
                    left = Node("in", left=left, query=None, items=items, neg=neg)
                self.need(")")
            elif self.take("BETWEEN"):
                low = self.expr()
                self.need("AND")
                left = Node("between", left=left, low=low, high=self.expr(), neg=neg)
            elif self.take("IS"):
                no = self.take("NOT")
                if not self.take("NULL"):
                    raise ParseError("NULL expected")
                left = Node("isnull", left=left, neg=no)
            else:
                return left

    # --- expressions ---
    def expr(self) -> Node:
        out = self.product()
        while self.kind() == "op" and self.peek() in ("+", "-", "||"):
            op = self.peek()
            self.i += 1
            out = Node("bin", op=op, left=out, right=self.product())
        return out

    def product(self) -> Node:
        out = self.unary()
        while self.kind() == "op" and self.peek() in ("*", "/"):
            op = self.peek()
            self.i += 1
            out = Node("bin", op=op, left=out, right=self.unary())
        return out

    def unary(self) -> Node:
        if self.kind() == "op" and self.peek() in ("-", "+"):
            sign = self.peek()
            self.i += 1
            arg = self.unary()
            if sign == "+":
                return arg
            return Node("lit", type="number", text="-" + arg.text) if arg.kind == "lit" and arg.type == "number" else Node("neg", arg=arg)
        if self.at("PRIOR") and self.kind(1) in ("word", "quoted"):
            self.i += 1
        return self.primary()

    def column(self) -> Node:
        parts = [self.name()]
        while self.take("."):
            if self.take("*"):
                return Node("star", table=".".join(parts))
            parts.append(self.name())
        return Node("col", table=".".join(parts[:-1]) or None, name=parts[-1], outer=self.take("(+)"))

    def primary(self) -> Node:
        kind, text = self.t[self.i] if self.i < len(self.t) else ("end", "")
        if kind == "string":
            self.i += 1
            return Node("lit", type="string", text=text)
        if kind == "number":
            self.i += 1
            return Node("lit", type="number", text=text)
        if kind == "bind":
            self.i += 1
            return Node("bind", text=text.upper())
        if text == "*":
            self.i += 1
            return Node("star", table=None)
        if text == "(":
            self.i += 1
            self.depth += 1
            if self.depth > _MAX_DEPTH:
                raise ParseError("nested too deeply")
            if self.peek() in ("SELECT", "WITH"):
                out: Node = Node("scalar", query=self.query())
            else:
                out = self.cond()
                if self.at(","):
                    items = [out]
                    while self.take(","):
                        items.append(self.cond())
                    out = Node("tuple", items=items)
            self.need(")")
            self.depth -= 1
            return out
        if kind == "word":
            if text == "CASE":
                return self.case()
            if text == "NULL":
                self.i += 1
                return Node("raw", text="NULL")
            if text == "CAST" and self.peek(1) == "(":
                self.i += 2
                arg = self.expr()
                self.need("AS")
                kind_of = []
                depth = 0
                while self.i < len(self.t) and (depth or self.peek() != ")"):
                    depth += (self.peek() == "(") - (self.peek() == ")")
                    kind_of.append(self.peek())
                    self.i += 1
                self.need(")")
                return Node("cast", arg=arg, type=" ".join(kind_of))
            if text in ("DATE", "TIMESTAMP") and self.kind(1) == "string":
                self.i += 2
                return Node("lit", type=text.lower(), text=f"{text} {self.t[self.i - 1][1]}")
            if text == "INTERVAL" and self.kind(1) == "string":
                self.i += 3
                return Node("lit", type="interval", text=f"INTERVAL {self.t[self.i - 2][1]} {self.t[self.i - 1][1]}")
            k = 1
            while self.peek(k) == "." and self.kind(k + 1) in ("word", "quoted"):
                k += 2
            if self.peek(k) == "(" and self.kind(k) == "op" and (text not in _CLAUSE or text in ("LEFT", "RIGHT")):
                fn = "".join(self.peek(x) for x in range(k))
                self.i += k
                return self.call(fn)
        return self.column()

    def call(self, fn: str) -> Node:
        self.need("(")
        distinct = self.take("DISTINCT")
        self.take("ALL")
        args = []
        while not self.at(")"):
            args.append(self.cond())
            if self.at("FROM") or self.at("USING") or self.at("AS"):  # EXTRACT(x FROM y), TRIM, LISTAGG variants
                self.i += 1
                continue
            if self.kind() in ("word", "string", "col") and not self.at(")"):
                continue
            if not self.take(","):
                break
        self.need(")")
        out = Node("func", name=fn, args=args, distinct=distinct, over=None, over_text="")
        if self.take("WITHIN", "GROUP"):
            self.need("(")
            self.order()
            self.need(")")
        if self.take("KEEP"):
            self.bracket()
        if self.take("OVER"):
            start = self.i
            parts = self.window()
            out.f["over"] = parts
            out.f["over_text"] = " ".join(x for _, x in self.t[start + 1 : self.i - 1])
        return out

    def bracket(self) -> None:
        self.need("(")
        depth = 1
        while depth:
            if self.i >= len(self.t):
                raise ParseError("open bracket")
            depth += (self.peek() == "(") - (self.peek() == ")")
            self.i += 1

    def window(self) -> list[Node]:
        self.need("(")
        parts: list[Node] = []
        if self.take("PARTITION", "BY"):
            while True:
                parts.append(self.expr())
                if not self.take(","):
                    break
        parts += [e for e, _ in self.order()]
        while not self.at(")"):
            self.i += 1
            if self.i >= len(self.t):
                raise ParseError("open bracket")
        self.need(")")
        return parts

    def case(self) -> Node:
        self.need("CASE")
        arg = None if self.at("WHEN") else self.expr()
        whens = []
        while self.take("WHEN"):
            a = self.cond()
            self.need("THEN")
            whens.append((a, self.expr()))
        default = self.expr() if self.take("ELSE") else None
        self.need("END")
        return Node("case", arg=arg, whens=whens, default=default)


def parse(sql: str) -> Node:
    toks = tokens(sql)
    if any(t.kind == "op" and t.text in "'\"" for t in toks):
        raise ParseError("open quotation mark")
    if not toks:
        raise ParseError("empty")
    sys.setrecursionlimit(max(sys.getrecursionlimit(), 40 * _MAX_DEPTH))  # for this and for the walks over the tree
    try:
        return Parser(toks).statement()
    except (IndexError, RecursionError) as e:
        raise ParseError(type(e).__name__) from None
