"""Loading the rows of plan grids: typed valid rows, and rejected rows with their reason.

Each Python worker takes the grids of one Arrow batch, groups their rows by layout and
header into CSV files in its scratch folder and reads every file with DuckDB's CSV reader
and reject tables, first with typed columns (Id a whole number, Time and A-Time an interval),
then as text. Errors of both, in columns, quoting and values, are joined back to the raw
records; the remaining rows are checked and typed by one SQL statement per file, for counts
and costs, with suffixes, thousands commas and percentages, are of no type the reader has, and
its types allow a little more (fractions, signs). There is no shuffle: a row depends on its
own text alone. The scratch folder belongs to a task and goes with it.
"""

from __future__ import annotations

import os
import re
import tempfile
from collections import defaultdict
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sqlloom.plans.grid import COUNT_ROLES, TIME_ROLES, find_grid

#: Typed columns of a step, in this order.
LONG_COLUMNS = ("estimated_rows", "actual_rows", "starts", "cost", "buffers", "reads", "bytes")
TEXT_COLUMNS = ("id_text", "operation", "options", "object_name", "actual_time", "access_predicates", "filter_predicates")
_SCHEMA = "key long, line_no long, seq int, layout string, reason string, raw string, step_id long, " + ", ".join([f"{c} string" for c in TEXT_COLUMNS] + [f"{c} long" for c in LONG_COLUMNS])

#: Which header role feeds which typed column.
_FEEDS = {
    "operation": "operation", "options": "options", "name": "object_name", "object_name": "object_name", "object": "object_name",
    "rows": "estimated_rows", "e_rows": "estimated_rows", "cardinality": "estimated_rows", "a_rows": "actual_rows", "starts": "starts",
    "cost": "cost", "buffers": "buffers", "reads": "reads", "bytes": "bytes", "time": "actual_time", "a_time": "actual_time",
    "access_predicates": "access_predicates", "filter_predicates": "filter_predicates",
}
_NUMBER = r"(\d{1,3}(,\d{3})+|\d+)(\.\d+)?[KMGT]?"
_CLOCK = r"\d+:[0-5]\d:[0-5]\d(\.\d+)?"
_BREAK = "\x1f"  # stands for a line end inside a quoted cell


def _number_sql(cell: str) -> str:
    plain = f"regexp_replace({cell}, '\\s*\\(.*\\)$', '')"
    digits = f"try_cast(replace(regexp_replace({plain}, '[KMGT]$', ''), ',', '') AS DECIMAL(30, 6))"
    factor = f"CASE right({plain}, 1) WHEN 'K' THEN 1000 WHEN 'M' THEN 1000000 WHEN 'G' THEN 1000000000 WHEN 'T' THEN 1000000000000 ELSE 1 END"
    return f"try_cast(trunc({digits} * {factor}) AS BIGINT)"


def _checks(layout: str, roles: tuple[str, ...]) -> str:
    """One CASE that names the first failing column, or NULL."""
    parts = []
    for k, r in enumerate(roles):
        c = f"trim(c{k})"
        if r == "id":
            star = r"(\*\s*)?" if layout == "pipe" and k else ""  # that of a first cell is off by now
            parts.append(f"WHEN NOT regexp_full_match({c}, '{star}\\d+') THEN 'id_not_whole'")
        elif r in COUNT_ROLES:
            percent = r"(\s*\(\d+(\.\d+)?%?\))?" if r == "cost" else ""
            parts.append(f"WHEN {c} <> '' AND {c} <> '-' AND NOT regexp_full_match({c}, '{_NUMBER}{percent}') THEN 'bad_number:{r}'")
        elif r in TIME_ROLES:
            parts.append(f"WHEN {c} <> '' AND NOT regexp_full_match({c}, '{_CLOCK}') THEN 'bad_time:{r}'")
    return f"CASE {' '.join(parts)} END"


def _projection(roles: tuple[str, ...]) -> str:
    done: dict[str, str] = {}
    for k, r in enumerate(roles):
        if (to := _FEEDS.get(r)) and to not in done:
            cell = f"replace(trim(c{k}), '{_BREAK}', chr(10))"
            done[to] = _number_sql(f"trim(c{k})") if to in LONG_COLUMNS else f"nullif({cell}, '')"
    at = roles.index("id")
    done["id_text"] = f"trim(c{at})"
    columns = [f"{done.get(c, 'NULL')} AS {c}" for c in (*TEXT_COLUMNS, *LONG_COLUMNS)]
    return f"try_cast(regexp_replace(trim(c{at}), '^\\*\\s*', '') AS BIGINT) AS step_id, " + ", ".join(columns)


def _types(layout: str, roles: tuple[str, ...]) -> list[str]:
    """The reader's types of the columns whose values are of one."""
    return ["BIGINT" if r == "id" and (k == 0 or layout != "pipe") else "INTERVAL" if r in TIME_ROLES else "VARCHAR" for k, r in enumerate(roles)]


def _read(con, name: str, files: list[str], layout: str, types: list[str]) -> dict[tuple[str, int], tuple[str, int | None]]:
    """Loads the files into table ``name``; returns the first reject entry (error, column) by file and line."""
    columns = ", ".join(["'rid': 'VARCHAR'", *(f"'c{k}': '{t}'" for k, t in enumerate(types))])
    delim = {"pipe": "|", "comma": ",", "tab": "\\t"}[layout]
    quoting = "quote='', escape=''" if layout == "pipe" else "quote='\"', escape='\"'"
    con.execute(f"DROP TABLE IF EXISTS {name}; DROP TABLE IF EXISTS bad; DROP TABLE IF EXISTS bad_scans")
    con.execute(
        f"CREATE TEMP TABLE {name} AS SELECT * FROM read_csv({files!r}, auto_detect=false, header=false, delim=E'{delim}', {quoting}, strict_mode=true, "
        f"columns={{{columns}}}, nullstr={['', ' '] if name == 'typed' else chr(2)!r}, store_rejects=true, rejects_table='bad', rejects_scan='bad_scans', rejects_limit=0, "
        "max_line_size=33554432, parallel=false, encoding='utf-8')"
    )
    rows = con.execute("SELECT s.file_path, e.line, min((e.error_type::VARCHAR, coalesce(e.column_name, ''))) FROM bad e JOIN bad_scans s USING (scan_id, file_id) GROUP BY ALL").fetchall()
    return {(path, line): (error[0], int(error[1][1:]) if error[1][:1] == "c" and error[1][1:].isdigit() else None) for path, line, error in rows}


_REASONS = {"MISSING COLUMNS": "missing_columns", "TOO MANY COLUMNS": "too_many_columns", "UNQUOTED VALUE": "broken_quoting", "CAST": "bad_value"}


_STAR = re.compile(r"^\s*\*\s*")


def _value_reason(role: str) -> str:
    return "id_not_whole" if role == "id" else f"bad_time:{role}"


def _group(con, folder: str, layout: str, roles: tuple[str, ...], records: list[tuple[int, int, int, str]]) -> list[tuple]:
    """records: (key, line_no, seq, raw) that share layout and header."""
    main, alone, out, preset = [], [], [], {}
    delim = {"pipe": "|", "comma": ",", "tab": "\t"}[layout]
    for rid, (_, _, _, raw) in enumerate(records):
        line = raw.replace("\n", _BREAK).replace("\r", " ").replace("\x00", " ")
        if layout == "pipe":
            line = line.strip()
            if not (line.startswith("|") and line.endswith("|") and len(line) > 1):
                preset[rid] = "missing_columns"
                continue
            line = line[1:-1]
            if roles[0] == "id":
                line = _STAR.sub("", line)
        # A mark left open would run on into the next record: such a record gets its own file.
        (alone if layout != "pipe" and line.count('"') % 2 else main).append((rid, f"{rid}{delim}{line}"))
    at: dict[tuple[str, int], int] = {}
    files = []
    for rows in ([main] if main else []) + [[x] for x in alone]:
        files.append(path := os.path.join(folder, f"{len(files)}.csv"))
        with open(path, "w", encoding="utf-8", errors="replace", newline="") as f:
            for n, (rid, line) in enumerate(rows, 1):
                at[path, n] = rid
                f.write(line + "\n")
    reasons = dict(preset)
    if files:
        text = ["VARCHAR"] * len(roles)
        shape = _read(con, "loaded", files, layout, text)
        values = _read(con, "typed", files, layout, types) if (types := _types(layout, roles)) != text else {}
        for where, (error, column) in (*shape.items(), *values.items()):
            if where in at:
                cast = error == "CAST" and column is not None
                reasons.setdefault(at[where], _value_reason(roles[column]) if cast else _REASONS.get(error, "bad_value"))
        typed = con.execute(f"SELECT rid::BIGINT, {_checks(layout, roles)}, {_projection(roles)} FROM loaded").fetchall()
    else:
        typed = []
    seen = set()
    for rid, why, *values in typed:
        if rid in seen or rid in reasons:
            continue
        seen.add(rid)
        key, line_no, seq, raw = records[rid]
        if layout == "pipe" and roles[0] == "id":
            values[1] = raw.strip()[1:].partition("|")[0].strip()  # with its star
        out.append((key, line_no, seq, layout, why, raw, *values) if why is None else (key, line_no, seq, layout, why, raw, *[None] * len(values)))
    blank = [None] * (1 + len(TEXT_COLUMNS) + len(LONG_COLUMNS))
    for rid, (key, line_no, seq, raw) in enumerate(records):
        if rid not in seen:  # neither loaded nor reported: the reader met the end inside a quoted cell
            out.append((key, line_no, seq, layout, reasons.get(rid, "broken_quoting"), raw, *blank))
    for path in files:
        os.unlink(path)
    return out


def _arrow_schema() -> pa.Schema:
    kinds = {"long": pa.int64(), "int": pa.int32(), "string": pa.string()}
    return pa.schema([(n, kinds[t]) for n, t in (x.strip().split(" ") for x in _SCHEMA.split(","))])


def _load(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    import duckdb

    schema = _arrow_schema()
    con = duckdb.connect(config={"threads": 1, "memory_limit": "512MB"})
    try:
        with tempfile.TemporaryDirectory() as folder:
            for batch in batches:
                groups: dict[tuple, list] = defaultdict(list)
                for key, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                    if grid := find_grid(text):
                        groups[grid.layout, grid.roles] += [(key, n, k, raw) for k, (n, raw) in enumerate(grid.records)]
                rows = [r for (layout, roles), records in groups.items() for r in _group(con, folder, layout, roles, records)]
                for start in range(0, len(rows), 20_000):
                    columns = list(zip(*rows[start : start + 20_000]))
                    yield pa.RecordBatch.from_arrays([pa.array(c, t.type) for c, t in zip(columns, schema)], schema=schema)
    finally:
        con.close()


def plan_rows(df: DataFrame, key: str = "plan_id", text: str = "plan_text") -> DataFrame:
    """Every row of every grid, with ``reason`` null for valid rows.

    Columns: ``key``, ``line_no``, ``seq`` (place in the grid from 0), ``layout``, ``reason``, ``raw``
    and the typed step columns, which are null for rejected rows. Reasons: ``missing_columns``,
    ``too_many_columns``, ``broken_quoting``, ``id_not_whole``, ``bad_number:<column>``,
    ``bad_time:<column>``. Null, blank and header-less texts give no rows, an empty table none;
    texts delivered twice give equal rows, which callers drop by ``key`` and ``line_no``.
    Other columns of ``df`` are not read.
    """
    return df.select(F.col(key).cast("long"), F.col(text)).where(F.col(text).isNotNull()).mapInArrow(_load, _SCHEMA)


def plan_steps(df: DataFrame, key: str = "plan_id", text: str = "plan_text") -> DataFrame:
    """The valid rows, one for each ``key`` and ``line_no``."""
    return plan_rows(df, key, text).where("reason IS NULL").drop("reason", "raw").dropDuplicates(["key", "line_no"])


def plan_rejects(df: DataFrame, key: str = "plan_id", text: str = "plan_text") -> DataFrame:
    """The failing rows with reason and raw text, one for each ``key`` and ``line_no``."""
    return plan_rows(df, key, text).where("reason IS NOT NULL").select("key", "line_no", "layout", "reason", "raw").dropDuplicates(["key", "line_no"])
