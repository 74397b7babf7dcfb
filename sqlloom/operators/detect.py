"""SQL in free text: candidate blocks, fences, cells, and how many statements are valid."""

from __future__ import annotations

import csv
import io
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sqlloom.sqlast.facts import facts
from sqlloom.sqlast.split import segments

_START = re.compile(r"^\s*(?:SELECT|WITH|INSERT\s+INTO|UPDATE|DELETE(?:\s+FROM)?|MERGE\s+INTO|DECLARE|BEGIN|CREATE\s+(?:OR\s+REPLACE\s+)?(?:PROCEDURE|FUNCTION|PACKAGE|TRIGGER))\b", re.I)
_CONTINUES = re.compile(r"^\s*(?:FROM|WHERE|AND|OR|ON|LEFT|RIGHT|FULL|INNER|CROSS|JOIN|GROUP|ORDER|HAVING|UNION|MINUS|INTERSECT|EXCEPT|CONNECT|START|SET|VALUES|WHEN|THEN|ELSE|END|USING|FETCH|FOR|RETURNING|SELECT|\(|\)|,|--|/\*)", re.I)
_FENCE = re.compile(r"^```[ \t]*([\w/+-]*)[^\n]*\n(.*?)^```", re.M | re.S)
_SQL_FENCES = frozenset(("sql", "oracle", "plsql", "pl/sql"))
_CELL = re.compile(r"^\s*(?:SELECT|WITH|INSERT|UPDATE|DELETE|MERGE)\b", re.I)
_CELL_WORD = re.compile(r"\b(?:FROM|SET|INTO)\b", re.I)


_SIGN = re.compile(r"[()]|--|/\*|(?<![^\W_])[nN]?'")


class _Brackets:
    """Open brackets of a text fed line by line, outside literals and comments: each line is read once."""

    def __init__(self) -> None:
        self.depth, self.inside = 0, ""

    def feed(self, line: str) -> None:
        at = 0
        while True:
            if self.inside:
                end = line.find(self.inside, at)
                if end < 0:
                    return
                at, self.inside = end + len(self.inside), ""
                if line.startswith("'", at) and line[end] == "'":  # a doubled mark
                    at, self.inside = at + 1, "'"
                    continue
            m = _SIGN.search(line, at)
            if not m or m.group() == "--":
                return
            at = m.end()
            if m.group() in "()":
                self.depth += 1 if m.group() == "(" else -1
            else:
                self.inside = "*/" if m.group() == "/*" else "'"


def trim_prose(block: str) -> str:
    """Paragraphs of a block as long as they continue the statement or brackets are open."""
    parts = re.split(r"\n[ \t]*\n+", block)
    kept, brackets = [parts[0]], _Brackets()
    for line in parts[0].split("\n"):
        brackets.feed(line)
    for p in parts[1:]:
        if kept[-1].rstrip().endswith(";") and not _START.match(p):
            break
        if not _CONTINUES.match(p) and brackets.depth <= 0:
            break
        kept.append(p)
        for line in p.split("\n"):
            brackets.feed(line)
    return "\n\n".join(kept).strip()


_GOES_ON = re.compile(r"(?:\bUNION(?:\s+ALL)?|\bMINUS|\bINTERSECT|\bEXCEPT|\bTHEN)\s*$", re.I)


def candidates(text: str) -> list[str]:
    """Blocks that begin at a line with a statement keyword outside open brackets, without trailing prose."""
    blocks: list[list[str]] = []
    brackets, last, with_or_insert = _Brackets(), "", False
    for line in text.split("\n"):
        starts = bool(_START.match(line))
        # WITH .. SELECT, INSERT .. SELECT and set operations go on with another keyword.
        goes_on = not last.endswith(";") and (with_or_insert or bool(_GOES_ON.search(last)))
        if starts and blocks and (brackets.depth > 0 or goes_on and re.match(r"\s*(?:SELECT|UPDATE|DELETE)\b", line, re.I)):
            starts = False
        if starts:
            blocks.append([line])
            brackets, last, with_or_insert = _Brackets(), "", bool(re.match(r"\s*(?:WITH|INSERT)\b", line, re.I))
        elif blocks:
            blocks[-1].append(line)
        if blocks:
            brackets.feed(line)
            if line.strip():  # two lines, for UNION and ALL may stand apart
                last = f"{last.rpartition(chr(10))[2]}\n{line.strip()}"
    return [b for b in (trim_prose("\n".join(x)) for x in blocks) if b]


def joined(found: list[str]) -> str:
    if len(found) <= 1:
        return found[0] if found else ""
    return "\n\n".join(f if f.rstrip().endswith(";") else f.rstrip() + ";" for f in found)


def count_valid(sql: str) -> int:
    return sum(facts(s, block)[0]["statement_type"] != "UNKNOWN" for s, block in segments(sql)[0]) if sql.strip() else 0


def csv_cells(text: str) -> list[str]:
    try:
        return [c.strip() for row in csv.reader(io.StringIO(text)) for c in row if len(c.strip()) >= 8 and _CELL.match(c) and _CELL_WORD.search(c)]
    except csv.Error:
        return []


def detect(filename: str, text: str) -> tuple[str, int, bool, bool]:
    """(sql, statement count, needs confirmation, found) of an attachment's text."""
    ext = filename.lower().rpartition(".")[2] if "." in filename else ""
    sure = False
    if ext == "sql":
        sql, sure = text.strip(), True
    elif ext == "csv" and (cells := csv_cells(text)):
        sql = joined(cells)
    else:
        fences = _FENCE.findall(text) if ext in ("md", "markdown") else []
        named = [b.strip() for lang, b in fences if lang.lower() in _SQL_FENCES]
        other = [b.strip() for lang, b in fences if lang.lower() not in _SQL_FENCES and any(_START.match(line) for line in b.split("\n"))]
        if named:
            sql, sure = joined(named), True
        elif other:
            sql = other[0]
        else:
            sql = joined(candidates(text)) or text.strip()
    n = count_valid(sql)
    return (sql, n, not sure or n > 1, True) if n else ("", 0, False, False)


def detected(df: DataFrame, key: str = "path", filename: str = "filename", text: str = "text") -> DataFrame:
    """``key, sql, statement_count, needs_confirmation, found`` of each text; null texts are not found."""
    kind = df.schema[key].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = []
            for f, t in zip(b.column(1).to_pylist(), b.column(2).to_pylist()):
                try:
                    rows.append(detect(f or "", t or ""))
                except Exception:  # noqa: BLE001 - one text must not fail the task
                    rows.append(("", 0, False, False))
            columns = list(zip(*rows)) if rows else [[], [], [], []]
            types = (pa.string(), pa.int32(), pa.bool_(), pa.bool_())
            yield pa.RecordBatch.from_arrays([b.column(0), *(pa.array(c, t) for c, t in zip(columns, types))], [key, "sql", "statement_count", "needs_confirmation", "found"])

    return df.select(key, filename, text).mapInArrow(run, f"`{key}` {kind}, sql string, statement_count int, needs_confirmation boolean, found boolean")
