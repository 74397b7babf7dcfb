"""From pasted text to statements: character normalisation, client commands, blocks, semicolons."""

from __future__ import annotations

import re
import unicodedata
from bisect import bisect_left
from typing import NamedTuple

from sqlloom.sqlast.lexer import is_open, tokens

# Client commands that begin a line (CONNECT BY is a clause and stays).
CLIENT_COMMANDS = ("SPOOL", "PROMPT", "DEFINE", "UNDEFINE", "WHENEVER", "EXIT", "QUIT", "CONNECT", "DISCONNECT", "COLUMN", "TTITLE", "BTITLE", "CLEAR", "PAUSE", "SHOW", "DESCRIBE", "ACCEPT", "HOST", "REM", "REMARK")
_COMMAND = re.compile(r"^\s*(?:(?:" + "|".join(CLIENT_COMMANDS) + r")\b(?!(?<=CONNECT)\s+BY\b)|@@?\S)", re.I)
_SET_COMMAND = re.compile(r"^\s*SET\s+\w+(?:\s+[^=]*)?$", re.I)
_UPDATE_BEFORE = re.compile(r"\bUPDATE\s+\S+(?:\s+\w+)?\s*$|\bTHEN\s+UPDATE\s*$", re.I)
_BLOCK = re.compile(r"^\s*(?:DECLARE\b|BEGIN\b|CREATE\s+(?:OR\s+REPLACE\s+)?(?:EDITIONABLE\s+|NONEDITIONABLE\s+)?(?:PROCEDURE|FUNCTION|PACKAGE|TRIGGER|TYPE\s+BODY)\b)", re.I)
# Signs deleted, and signs replaced after NFKC.
_ZERO_WIDTH = dict.fromkeys((0x200B, 0x200C, 0x200D, 0xFEFF))
_MARKS = str.maketrans({
    "\u2018": "'", "\u2019": "'", "\u201a": "'", "\u201b": "'", "\u201c": '"', "\u201d": '"', "\u201e": '"', "\u201f": '"', "\u2032": "'", "\u2033": '"',
    "。": ".", "『": "'", "』": "'", "「": '"', "」": '"', "\u00a0": " ", "\u2007": " ", "\u202f": " ",
})


def normalize(text: str) -> str:
    """NFKC, no zero-width signs, plain quotation marks and blanks, line ends as LF. Idempotent."""
    if not text.isascii():
        text = unicodedata.normalize("NFKC", text).translate(_ZERO_WIDTH).translate(_MARKS)
    return text.replace("\r\n", "\n").replace("\r", "\n")


class Stripped(NamedTuple):
    sql: str
    commands: list[str]


def strip_commands(text: str) -> Stripped:
    """Lines of client commands apart from the SQL; ``SET`` lines only without ``=`` and outside UPDATE; a lone slash stays."""
    kept: list[str] = []
    commands: list[str] = []
    for line in text.split("\n"):
        is_set = _SET_COMMAND.match(line) and not _UPDATE_BEFORE.search("\n".join(kept[-3:]))
        if _COMMAND.match(line) or is_set:
            commands.append(line.strip())
        else:
            kept.append(line)
    return Stripped("\n".join(kept), commands)


def split_semicolons(text: str) -> list[str]:
    """Segments up to and with each semicolon outside quotation marks and comments."""
    toks = tokens(text, comments=True)
    if is_open(toks):
        cuts = [m.end() for m in re.finditer(";", text)]
        filled = lambda a, z: bool(tokens(text[a:z]))
    else:
        cuts = [t.start + 1 for t in toks if t.kind == "op" and t.text == ";"]
        starts = [t.start for t in toks if t.kind not in ("line", "block", "remark")]
        filled = lambda a, z: bisect_left(starts, a) < bisect_left(starts, z)
    out, at = [], 0
    for c in [*cuts, len(text)]:
        segment = text[at:c].strip()
        if segment and segment != ";" and filled(at, c):
            out.append(segment)
        at = c
    return out


def segments(text: str) -> tuple[list[tuple[str, bool]], list[str]]:
    """((segment, whether it is a PL/SQL block), ...) in order, and the client commands."""
    sql, commands = strip_commands(normalize(text))
    out: list[tuple[str, bool]] = []
    plain: list[str] = []
    block: list[str] | None = None

    def flush() -> None:
        out.extend((s, False) for s in split_semicolons("\n".join(plain)))
        plain.clear()

    for line in sql.split("\n"):
        alone = line.strip() == "/"
        if block is not None:
            if alone:
                out.append(("\n".join(block).strip(), True))
                block = None
            else:
                block.append(line)
        elif alone:
            flush()
        elif _BLOCK.match(line) and not "".join(plain[-1:]).strip().endswith(","):
            flush()
            block = [line]
        else:
            plain.append(line)
    if block is not None:
        out.append(("\n".join(block).strip(), True))
    flush()
    return out, commands
