"""Line and word differences of two texts, and the line of a text that a fragment is about."""

from __future__ import annotations

import difflib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

_WORD = re.compile(r"\w+|\s+|[^\w\s]")


def line_tags(left: str, right: str) -> list[tuple[str, int | None, int | None]]:
    """(kind, left line, right line) from 1: same, changed, added or removed."""
    a, b = left.split("\n"), right.split("\n")
    out: list[tuple[str, int | None, int | None]] = []
    for op, i1, i2, j1, j2 in difflib.SequenceMatcher(None, a, b, autojunk=False).get_opcodes():
        if op == "equal":
            out += [("same", i + 1, j1 + i - i1 + 1) for i in range(i1, i2)]
        else:
            n = min(i2 - i1, j2 - j1)
            out += [("changed", i1 + k + 1, j1 + k + 1) for k in range(n)]
            out += [("removed", i + 1, None) for i in range(i1 + n, i2)] + [("added", None, j + 1) for j in range(j1 + n, j2)]
    return out


def word_diff(left: str, right: str) -> list[tuple[str, str]]:
    """(kind, text) of words, letter case aside."""
    a, b = _WORD.findall(left), _WORD.findall(right)
    out = []
    for op, i1, i2, j1, j2 in difflib.SequenceMatcher(None, [x.lower() for x in a], [x.lower() for x in b], autojunk=False).get_opcodes():
        if op == "equal":
            out.append(("same", "".join(b[j1:j2])))
        else:
            out += [("removed", "".join(a[i1:i2]))] * (i2 > i1) + [("added", "".join(b[j1:j2]))] * (j2 > j1)
    return out


def rows(df: DataFrame, key: str, left: str, right: str) -> DataFrame:
    """Aligned rows ``key, n, kind, left_no, right_no, left_line, right_line``; null texts count as empty."""
    kind = df.schema[key].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            for k, x, y in zip(*(b.column(i).to_pylist() for i in range(3))):
                x, y = x or "", y or ""
                a, c = x.split("\n"), y.split("\n")
                out += [(k, n, t, i, j, a[i - 1] if i else None, c[j - 1] if j else None) for n, (t, i, j) in enumerate(line_tags(x, y))]
            columns = list(zip(*out)) if out else [[]] * 7
            types = (b.schema.field(0).type, pa.int32(), pa.string(), pa.int32(), pa.int32(), pa.string(), pa.string())
            yield pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(columns, types)], [key, "n", "kind", "left_no", "right_no", "left_line", "right_line"])

    return df.select(key, left, right).mapInArrow(run, f"`{key}` {kind}, n int, kind string, left_no int, right_no int, left_line string, right_line string")


def best_line(text: Column, fragment: Column) -> Column:
    """The number (from 1) of the line that shares most words with a fragment, at least two; the first of equals, else null."""
    words = lambda c: F.array_distinct(F.regexp_extract_all(F.upper(c), F.lit(r"([A-Z0-9_$#]+)"), F.lit(1)))
    wanted = words(fragment)
    scored = F.transform(F.split(text, "\n"), lambda line, i: F.struct(F.size(F.array_intersect(words(line), wanted)).alias("n"), (-i).alias("at")))
    best = F.array_max(scored)
    return F.when(best["n"] >= 2, 1 - best["at"])
