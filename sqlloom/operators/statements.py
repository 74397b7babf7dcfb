"""Statements of submissions with their facts: the one parse stage that all analyses share."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from sqlloom.sources.once import once
from sqlloom.sqlast import rewrites
from sqlloom.sqlast.facts import facts
from sqlloom.sqlast.split import segments

SCHEMA = (
    "submission_id long, idx int, raw_sql string, statement_type string, parse_status string, parse_error string, tables array<string>, base_tables array<string>, "
    "where_applicable boolean, has_where boolean, restriction_kind string, source_evidence_kind string, hint string, or_count int, like_hits array<string>, function_hits array<string>, flags array<string>, "
    "signature struct<select_count:int, distinct:boolean, group_by_count:int, having:boolean, order_by:boolean, agg_funcs:array<string>, join_sides:array<string>>, skeleton string, "
    "rewrites array<struct<rule:string, before:string, after:string>>, rewrite_rules array<string>, client_commands int, n_statements int"
)


def analyse(sql: str) -> list[dict]:
    """Fact rows of a script, one for each statement in order."""
    found, commands = segments(sql)
    rows = []
    for idx, (segment, block) in enumerate(found):
        row, tree = facts(segment, block)
        select = tree is not None and row["statement_type"] == "SELECT"
        try:
            row["rewrites"] = [dict(zip(("rule", "before", "after"), r)) for r in rewrites.find(tree)] if select else []
            row["rewrite_rules"] = sorted(rewrites.anywhere(tree)) if tree is not None else []
        except RecursionError:
            row["rewrites"], row["rewrite_rules"] = [], []
        rows.append(row | {"idx": idx, "raw_sql": segment, "client_commands": len(commands), "n_statements": len(found)})
    return rows


def statements(df: DataFrame, key: str = "submission_id", text: str = "sql") -> DataFrame:
    """One row for each statement of each submission; a key counts once, with the least of its texts.

    Only keys that may be delivered twice are shuffled; the others are parsed where they are read.

    Null, blank and comment-only texts give no rows. A statement that can't be parsed has
    ``parse_status`` failed, facts unknown and table names guessed from its text. A bad row never
    ends the task: what goes wrong beyond parsing is a failed statement too.
    """
    schema = to_arrow_schema(StructType.fromDDL(SCHEMA))
    names = schema.names

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = []
            for k, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                try:
                    found = analyse(t)
                except Exception as e:  # noqa: BLE001 - one text must not fail the task
                    found = [{n: None for n in names} | {"idx": 0, "raw_sql": t, "statement_type": "UNKNOWN", "parse_status": "failed", "parse_error": type(e).__name__, "tables": [], "base_tables": [], "where_applicable": True, "or_count": 0, "like_hits": [], "function_hits": [], "flags": [], "rewrites": [], "rewrite_rules": [], "client_commands": 0, "n_statements": 1}]
                rows += [{"submission_id": k} | r for r in found]
            for s in range(0, len(rows), 5000):
                yield pa.RecordBatch.from_pylist([{n: r.get(n) for n in names} for r in rows[s : s + 5000]], schema=schema)

    rows = df.select(F.col(key).cast("long").alias("k"), F.col(text).alias("t")).where("t IS NOT NULL AND t RLIKE '\\\\S'")
    return once(rows, "k").mapInArrow(run, SCHEMA)
