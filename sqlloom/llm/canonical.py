"""The canonical form of a SQL script: equal for scripts that differ in writing only.

White space, letter case outside quoted literals, punctuation without meaning (empty
statements, a closing semicolon or slash, quotation marks around ordinary identifiers,
brackets that bind nothing), the order of selected or assigned columns and the order of
conditions joined by AND are levelled. Everything else stays, comments included.
"""

from __future__ import annotations

import hashlib
import re
import sys

_FAST = re.compile(
    r"""[nN]?'(?:[^']|'')*'|--[^\n]*|/\*(?:[^*]|\*(?!/))*(?:\*/|\Z)|(?m:^)[ \t]*(?:[Rr][Ee][Mm](?:[Aa][Rr][Kk])?|[Pp][Rr][Oo][Mm][Pp][Tt])\b[^\n]*|"[^"]*"|[\w$#]+(?:\.\d+)?|<=|>=|<>|!=|\^=|\|\||:=|=>|\(\+\)|\.\.|[^\s\w]"""
)
#: A slash alone on its line ends a statement where the script ends or another statement follows.
_SLASH = re.compile(r"^[ \t]*/[ \t]*$(?=\s*(?:\Z|--|/\*|(?:SELECT|WITH|INSERT|UPDATE|DELETE|MERGE|BEGIN|DECLARE|CREATE|ALTER|DROP|SET|REM|PROMPT|SPOOL|EXIT)\b))", re.M | re.I)
_PLAIN_NAME = re.compile(r'"[A-Za-z][A-Za-z0-9_$#]*"')
_END_COND = frozenset("WHERE GROUP ORDER UNION MINUS INTERSECT EXCEPT HAVING CONNECT START FOR RETURNING LOG FETCH OFFSET LEFT RIGHT FULL INNER CROSS NATURAL JOIN ON SELECT UPDATE DELETE INSERT MERGE WITH SET BEGIN DECLARE WHEN THEN VALUES LOOP".split())
_COND = frozenset(("WHERE", "HAVING", "ON"))
_SELECT_END = frozenset(("FROM", "INTO", "UNION", "MINUS", "INTERSECT", "EXCEPT", "WHERE", "BULK", "ORDER"))
_SET_END = frozenset(("WHERE", "RETURNING", "LOG", "WHEN", "DELETE", "FROM"))
_SEP = "\x1f"
_LONG = 1000


def fold(text: str) -> str:
    """Upper case; other letters than ASCII only where that gives one letter outside ASCII."""
    if text.isascii():
        return text.upper()
    return "".join(c.upper() if c.isascii() or len(u := c.upper()) == 1 and not u.isascii() else c for c in text)


class _Group:
    """What stands between brackets: its text, and as a condition its disjuncts (each a list of conjuncts)."""

    __slots__ = ("text", "query", "parts")

    def __init__(self, text: str, query: bool, parts: list[list[str]] | None):
        if len(text) > _LONG:  # stands for itself by its hash, so that deep brackets don't copy it level by level
            text = _SEP + hashlib.blake2b(text.encode("utf-8", "surrogatepass"), digest_size=16).hexdigest()
        self.text, self.query, self.parts = text, query, parts


def _tokens(sql: str) -> list[str]:
    out = []
    for t in _FAST.findall(sql):
        c = t[0]
        if c == "'" or (c in "nN" and t[1:2] == "'"):
            out.append(t)
        elif c == '"':
            out.append(fold(t[1:-1]) if _PLAIN_NAME.fullmatch(t) else t)
        elif t[:2] in ("--", "/*") or len(t) > 3 and (" " in t or "\t" in t):
            out.append(" ".join(fold(t).split()))  # a comment
        else:
            out.append(fold(t))
    return out


class _Reader:
    def __init__(self, toks: list[str]):
        self.t, self.i, self.n = toks, 0, len(toks)

    def group(self) -> _Group:
        """From behind an opening bracket to its closing one."""
        text, parts, query = self.body(True)
        return _Group(text, query, parts)

    def body(self, inside: bool) -> tuple[str, list[list[str]] | None, bool]:
        t = self.t
        query = self.i < self.n and t[self.i] in ("SELECT", "WITH")
        if inside and not query:
            parts = self.cond(True)
            if self.i < self.n and t[self.i] == ")":
                self.i += 1
                return _join(parts), parts, False
            # a list or something odd: take the rest as it comes
            rest = self.plain(True)
            return _join(parts) + _SEP + rest, None, False
        return self.plain(inside), None, query

    def plain(self, inside: bool) -> str:
        t, out = self.t, []
        insert: list[str] | None = None
        at_insert = updating = False
        while self.i < self.n:
            w = t[self.i]
            if w == ")" and inside:
                self.i += 1
                break
            self.i += 1
            if w == "(":
                if at_insert:
                    insert, at_insert = self.items(frozenset()), False
                    out.append(None)  # filled in when the values are known
                else:
                    out.append(f"({self.group().text})")
            elif w == "SELECT":
                out.append(w)
                while self.i < self.n and t[self.i] in ("DISTINCT", "UNIQUE", "ALL") or self.i < self.n and t[self.i].startswith("/*+"):
                    out.append(t[self.i])
                    self.i += 1
                items = self.items(_SELECT_END, inside)
                if insert is not None:
                    pairs = sorted(zip(items, insert)) if len(items) == len(insert) else list(zip(items, insert))
                    if len(items) == len(insert):
                        insert, items = [b for _, b in pairs], [a for a, _ in pairs]
                    out[out.index(None)] = "(" + ",".join(insert) + ")"
                    insert = None
                else:
                    items.sort()
                out.append(",".join(items))
            elif w == "VALUES" and insert is not None and self.i < self.n and t[self.i] == "(":
                self.i += 1
                items = self.items(frozenset())
                if len(items) == len(insert):
                    pairs = sorted(zip(insert, items))
                    insert, items = [a for a, _ in pairs], [b for _, b in pairs]
                out[out.index(None)] = "(" + ",".join(insert) + ")"
                insert = None
                out += ["VALUES", "(" + ",".join(items) + ")"]
            elif w in _COND:
                out += [w, _join(self.cond(inside))]
            elif w == "SET" and updating:
                items = self.items(_SET_END, inside)
                items.sort()
                out += [w, ",".join(items)]
                updating = False
            elif w == ";":
                if insert is not None:
                    out[out.index(None)] = "(" + ",".join(insert) + ")"
                    insert = None
                if out and out[-1] != ";":
                    out.append(";")
                updating = at_insert = False
            else:
                if w == "UPDATE":
                    updating = True
                elif w == "INTO" and out and out[-1] == "INSERT":
                    at_insert = True
                elif at_insert and w in ("VALUES",):
                    at_insert = False
                out.append(w)
        if insert is not None:
            out[out.index(None)] = "(" + ",".join(insert) + ")"
        while out and out[-1] == ";":
            out.pop()
        return _SEP.join(out)

    def items(self, ends: frozenset, inside: bool = True) -> list[str]:
        """Comma-separated items up to a closing bracket (taken where ``ends`` is empty) or one of ``ends`` (left)."""
        t, items, cur = self.t, [], []
        case = 0
        while self.i < self.n:
            w = t[self.i]
            if w == ")":
                if not ends:
                    self.i += 1
                break
            if w == ";" or not case and w in ends:
                break
            self.i += 1
            if w == "(":
                cur.append(f"({self.group().text})")
            elif w == "," and not case:
                items.append(_SEP.join(cur))
                cur = []
            else:
                case += (w == "CASE") - (w == "END" and case > 0)
                cur.append(w)
        items.append(_SEP.join(cur))
        return items

    def cond(self, inside: bool) -> list[list[str]]:
        """Disjuncts up to the end of the condition, each a sorted list of conjuncts."""
        t = self.t
        ors: list[list] = []
        ands: list = []  # a conjunct: its tokens, or one _Group alone
        cur: list = []
        between = case = 0
        while self.i < self.n:
            w = t[self.i]
            if w == ")" or w == ";" or w == "," and not inside:
                break
            if w in _END_COND and not case:
                break
            self.i += 1
            if w == "(":
                g = self.group()
                last = cur[-1] if cur else None
                if last is None:
                    cur.append(g)
                elif g.parts is not None and len(g.parts) == 1 and len(g.parts[0]) == 1 and _SEP not in g.text and isinstance(last, str) and not (last[-1:].isalnum() or last[-1:] in "_$#\"'") and "," not in g.text:
                    cur.append(g.text)  # brackets around one value
                else:
                    cur.append(f"({g.text})")
            elif case:
                case += (w == "CASE") - (w == "END")
                cur.append(w)
            elif w == "CASE":
                case = 1
                cur.append(w)
            elif w == "AND" and between:
                between -= 1
                cur.append(w)
            elif w == "AND":
                ands.append(cur)
                cur = []
            elif w == "OR":
                ands.append(cur)
                ors.append(ands)
                ands, cur, between = [], [], 0
            else:
                if w == "BETWEEN":
                    between += 1
                cur.append(w)
        ands.append(cur)
        ors.append(ands)
        return [self.conjuncts(a, len(ors) == 1) for a in ors] if not (len(ors) == 1 and len(ors[0]) == 1 and _single(ors[0][0])) else ors[0][0][0].parts

    @staticmethod
    def conjuncts(ands: list[list], alone: bool) -> list[str]:
        out = []
        for c in ands:
            if _single(c) and len(c[0].parts) == 1:
                out += c[0].parts[0]
            else:
                out.append(_SEP.join(x if isinstance(x, str) else f"({x.text})" for x in c))
        out.sort()
        return out


def _single(c: list) -> bool:
    return len(c) == 1 and isinstance(c[0], _Group) and c[0].parts is not None


def _join(parts: list[list[str]]) -> str:
    return (_SEP + "OR" + _SEP).join((_SEP + "AND" + _SEP).join(p) for p in parts)


def canonical(sql: str | None) -> str | None:
    """The canonical form; None for null, blank and punctuation-only scripts."""
    if not sql or sql.isspace():
        return None
    if "/" in sql:
        sql = _SLASH.sub(";", sql)
    toks = _tokens(sql)
    limit = sys.getrecursionlimit()
    # Brackets nest by calls: a level takes at most three of them.
    sys.setrecursionlimit(max(limit, 1000 + 4 * toks.count("(")))
    try:
        r = _Reader(toks)
        out = []
        while r.i < r.n:
            out.append(r.plain(False))
            if r.i < r.n and r.t[r.i] == ")":  # a bracket too many
                out.append(")")
                r.i += 1
    finally:
        sys.setrecursionlimit(limit)
    return _SEP.join(x for x in out if x) or None
