"""Tokens of SQL scripts in the Oracle flavour."""

from __future__ import annotations

import re
from typing import NamedTuple

_PATTERN = r"""
 (?P<space>\s+)
|(?P<line>--[^\n]*)
|(?P<block>/\*(?:[^*]|\*(?!/))*(?:\*/|\Z))
|(?P<remark>(?m:^)[ \t]*(?i:REM(?:ARK)?|PROMPT)\b[^\n]*)
|(?P<string>[nN]?'(?:[^']|'')*'|[nN]?[qQ]'(?:\[[^\]]*\]'|\{[^}]*\}'|\([^)]*\)'|<[^>]*>'|(?P<mark>[^\s\[{(<])[\s\S]*?(?P=mark)'))
|(?P<quoted>"[^"]*")
|(?P<number>(?:\d+(?:\.\d*)?|\.\d+)(?:[eE][+-]?\d+)?(?![\w$\#]))
|(?P<bind>:(?:\w[\w$\#]*))
|(?P<word>[^\W\d][\w$\#]*|\d[\w$\#]*)
|(?P<op><=|>=|<>|!=|\^=|\|\||:=|=>|\(\+\)|\*\*|\.\.|[\s\S])
"""
TOKEN = re.compile(_PATTERN, re.VERBOSE)


class Token(NamedTuple):
    kind: str  # line, block, remark, string, quoted, number, bind, word, op
    text: str
    start: int


class LexError(ValueError):
    """A quotation mark or comment is left open."""


def tokens(sql: str, comments: bool = False) -> list[Token]:
    """All tokens but white space; comments only where asked for. Never fails: an open quotation mark is an ``op``."""
    out = []
    new, skipped = tuple.__new__, ("space",) if comments else ("space", "line", "block", "remark")
    for m in TOKEN.finditer(sql):
        kind = m.lastgroup
        if kind not in skipped:
            out.append(new(Token, (kind if kind != "mark" else "string", m.group(), m.start())))
    return out


def is_open(toks: list[Token]) -> bool:
    return any(t.kind == "op" and t.text in "'\"" for t in toks)
