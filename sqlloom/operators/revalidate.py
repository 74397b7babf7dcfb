"""Whether a suggested statement is the original one rewritten provably: an ordered gate over the facts of both."""

from __future__ import annotations

from collections.abc import Iterator
from typing import Any

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sqlloom.sqlast import rewrites
from sqlloom.sqlast.facts import facts
from sqlloom.sqlast.nodes import render
from sqlloom.sqlast.parser import ParseError, parse
from sqlloom.sqlast.split import segments

_SIGNATURE = ("select_count", "distinct", "group_by_count", "having", "order_by", "agg_funcs", "join_sides")


def _notices(f: dict[str, Any]) -> int:
    """Findings of the notice rules that a rewrite can change; those on tables (R007) are equal with the tables."""
    return len(f["like_hits"]) + len(f["function_hits"]) + (f["or_count"] > 0)


def rewritten(sql: str | None) -> str | None:
    """A single statement with all its provable rewrites applied; None where there are none."""
    parts = segments(sql)[0] if sql else []
    if len(parts) != 1 or parts[0][1]:
        return None
    try:
        tree = parse(parts[0][0])
    except ParseError:
        return None
    text = before = render(tree)
    for _, old, new in rewrites.find(tree):
        text = text.replace(old, new)
    return None if text == before else text


def reason(original: str | None, suggested: str | None) -> str | None:
    """The first failing check, or None for a proved rewrite.

    In this order: missing, identical, more than one statement, unreadable, type, tables, hint,
    ROWNUM, structure flags, each part of the signature, WHERE present on both sides, skeleton,
    no restriction at all, more findings than before, predicates.
    """
    if not original or not suggested or not original.strip() or not suggested.strip():
        return "missing"
    if " ".join(original.split()).upper() == " ".join(suggested.split()).upper():
        return "identical"
    parts = [segments(original)[0], segments(suggested)[0]]
    if any(len(p) != 1 for p in parts):
        return "not_one_statement"
    a, b = (facts(*p[0])[0] for p in parts)
    if a["parse_status"] != "ok" or b["parse_status"] != "ok":
        return "unreadable"
    if a["statement_type"] != b["statement_type"] or a["statement_type"] != "SELECT":
        return "type"
    if a["tables"] != b["tables"]:
        return "tables"
    if b["hint"] is not None:
        return "hint"
    if "rownum" in a["flags"] or "rownum" in b["flags"]:
        return "rownum"
    for flag in rewrites.STRUCTURE_FLAGS:
        if (flag in a["flags"]) != (flag in b["flags"]):
            return f"structure:{flag}"
    for part in _SIGNATURE:
        if a["signature"][part] != b["signature"][part]:
            return f"signature:{part}"
    if a["has_where"] != b["has_where"]:
        return "where"
    if a["skeleton"] != b["skeleton"]:
        return "skeleton"
    if b["where_applicable"] and not b["has_where"] and b["restriction_kind"] is None:
        return "blocks"
    if _notices(b) > _notices(a):
        return "more_findings"
    try:
        return rewrites.explain_change(parse(parts[0][0][0]), parse(parts[1][0][0]))
    except ParseError:
        return "unreadable"


def own_rewrites(df: DataFrame, key: str, original: str) -> DataFrame:
    """``key``, ``original`` and ``suggested``, each statement's own provable rewrites (null: none)."""
    kind = df.schema[key].dataType.simpleString()

    def one(x: str | None) -> str | None:
        try:
            return rewritten(x)
        except RecursionError:
            return None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array([one(x) for x in b.column(1).to_pylist()], pa.string())], [key, original, "suggested"])

    return df.select(F.col(key), F.col(original).cast("string")).mapInArrow(run, f"`{key}` {kind}, `{original}` string, suggested string")


def revalidated(df: DataFrame, key: str, original: str, suggested: str) -> DataFrame:
    """``key`` and ``reason`` (null: proved) of each pair of statements; null and blank texts are missing."""
    kind = df.schema[key].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            for x, y in zip(b.column(1).to_pylist(), b.column(2).to_pylist()):
                try:
                    out.append(reason(x, y))
                except RecursionError:
                    out.append("unreadable")
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(out, pa.string())], [key, "reason"])

    return df.select(F.col(key), F.col(original).cast("string"), F.col(suggested).cast("string")).mapInArrow(run, f"`{key}` {kind}, reason string")
