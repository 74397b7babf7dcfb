"""Finding the step grid inside an execution-plan text and cutting it into records.

Pure functions over one text; the Spark operator on top is ``operators.plan_rows``.
A record is ``(line_no, raw)``: the line of the text on which the row begins (from 1,
lines end at LF) and the row's text without its line end.
"""

from __future__ import annotations

import csv
import re
from typing import NamedTuple

#: Roles of header cells; a count column must hold a number, Time a clock time.
COUNT_ROLES = ("rows", "e_rows", "a_rows", "cardinality", "bytes", "starts", "buffers", "reads", "cost")
TIME_ROLES = ("time", "a_time")

_RULER = re.compile(r"[-+|=\s]*-[-+|=\s]*")
_NOT_WORD = re.compile(r"[^a-z0-9]+")
#: A byte order mark, also one that was read in the wrong encoding.
_MARK = re.compile("^(?:\\ufeff|\\u00ef\\u00bb\\u00bf)")


class Grid(NamedTuple):
    layout: str  # pipe, comma or tab
    header_line: int
    roles: tuple[str, ...]
    records: list[tuple[int, str]]


def role(cell: str) -> str:
    """Name of a header cell: lower case, bracketed parts dropped, other signs to underscores."""
    cell = re.sub(r"\([^)]*\)", "", cell.strip().strip('"').lower()).replace("%", "cpu")
    return _NOT_WORD.sub("_", cell).strip("_")


def _pipe_cells(line: str) -> list[str]:
    return [c.strip() for c in line.strip().strip("|").split("|")]


def _header(line: str) -> tuple[str, list[str]] | None:
    if "peration" not in line and "PERATION" not in line:
        return None
    line = _MARK.sub("", line).rstrip("\r")
    if line.count("|") >= 3:
        layout, cells = "pipe", _pipe_cells(line)
    elif "\t" in line:
        layout, cells = "tab", next(csv.reader([line], delimiter="\t"), [])
    elif "," in line:
        layout, cells = "comma", next(csv.reader([line]), [])
    else:
        return None
    roles = [role(c) for c in cells]
    return (layout, roles) if "id" in roles and "operation" in roles else None


def is_ruler(line: str) -> bool:
    return bool(_RULER.fullmatch(line))


def find_grid(text: str | None) -> Grid | None:
    """The first grid of a text, or None.

    Pipe tables run to the ruler that closes them, other layouts to the first blank line.
    In comma and tab layouts a line that begins with a space continues the row above.
    """
    if not text:
        return None
    low = text.lower()
    if "operation" not in low:
        return None
    lines = text.split("\n")
    for at, line in enumerate(lines):
        if found := _header(line):
            break
    else:
        return None
    layout, roles = found
    records: list[tuple[int, str]] = []
    if layout == "pipe":
        for k in range(at + 1, len(lines)):
            line = lines[k].rstrip("\r")
            if is_ruler(line):
                if records:
                    break
                continue
            if line.strip():
                records.append((k + 1, line))
    else:
        for k in range(at + 1, len(lines)):
            line = lines[k].rstrip("\r")
            if not line.strip():
                break
            if line[0] == " " and records:
                records[-1] = (records[-1][0], records[-1][1] + "\n" + line)
            else:
                records.append((k + 1, line))
    return Grid(layout, at + 1, tuple(roles), records)
