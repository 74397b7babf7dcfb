"""Literal masking with numbered placeholders, hints about the literals, and the way back."""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sqlloom.sources.once import once
from sqlloom.sqlast.lexer import is_open, tokens

_SHORT = re.compile(r"[A-Za-z0-9%_]*")
_MASKED = "struct<masked_sql:string, reverse_map:map<string,string>, hints:map<string,struct<kind:string,length:int,wildcard:string,shape:string,literal_type:string>>>"
_LOOSE = re.compile(r"'(?:[^']|'')*'|(?<![\w:.])\d{6,}(?![\w.])")


def _hint(kind: str, value: str, typed: str | None) -> dict:
    wild = {(True, True): "both", (True, False): "leading", (False, True): "trailing"}.get((value[:1] in ("%", "_") and kind == "string", value[-1:] in ("%", "_") and kind == "string"), "none")
    core = value.strip("%_")
    shape = "digits" if core.isdigit() else "alnum" if core.isascii() and core.isalnum() else "text"
    return {"kind": kind, "length": len(value), "wildcard": wild, "shape": shape, "literal_type": typed}


def mask(sql: str, keep: int = 4) -> tuple[str, dict[str, str], dict[str, dict]]:
    """Strings become ``:STR_nnn`` and numbers of six digits and more ``:NUM_nnn``, numbered as first seen.

    Short ASCII strings of at most ``keep`` characters stay. Where quotation marks are left open,
    literals are found by pattern instead of by token.
    """
    names: dict[tuple[str, str], str] = {}
    hints: dict[str, dict] = {}
    counts = {"STR": 0, "NUM": 0}

    def placeholder(text: str, typed: str | None = None) -> str:
        kind = "STR" if text[0] in "'nNqQ" else "NUM"
        value = text[text.index("'") + 1 : -1].replace("''", "'") if kind == "STR" else text
        if kind == "STR" and len(value) <= keep and _SHORT.fullmatch(value):
            return text
        if (kind, text) not in names:
            counts[kind] += 1
            names[kind, text] = f":{kind}_{counts[kind]:03d}"
            hints[names[kind, text]] = _hint("string" if kind == "STR" else "number", value, typed)
        return names[kind, text]

    toks = tokens(sql, comments=True)
    out, at = [], 0
    if is_open(toks):
        for m in _LOOSE.finditer(sql):
            out += [sql[at : m.start()], placeholder(m.group())]
            at = m.end()
    else:
        before = None
        for t in toks:
            if t.kind == "string" or t.kind == "number" and t.text.isdigit() and len(t.text) >= 6 and (before is None or before.text != ":"):
                typed = before.text.upper() if before is not None and before.kind == "word" and before.text.upper() in ("DATE", "TIMESTAMP") else None
                out += [sql[at : t.start], placeholder(t.text, typed)]
                at = t.start + len(t.text)
            before = t
    return "".join([*out, sql[at:]]), {v: text for (_, text), v in names.items()}, hints


def _mask_frame(sqls: pd.Series) -> pd.DataFrame:
    rows = [mask(s) if s is not None else (None, None, None) for s in sqls]
    return pd.DataFrame(rows, columns=["masked_sql", "reverse_map", "hints"])


def _mask_years_frame(sqls: pd.Series) -> pd.DataFrame:
    rows = [mask_years(mask(s)) if s is not None else (None, None, None) for s in sqls]
    return pd.DataFrame(rows, columns=["masked_sql", "reverse_map", "hints"])


def mask_udf(sql: Column | str, years: bool = False) -> Column:
    """``mask`` of a column as a struct; with ``years`` what a model sees, years hidden as well."""
    return F.pandas_udf(_mask_years_frame if years else _mask_frame, _MASKED)(sql)


def unmask(masked: Column, reverse: Column) -> Column:
    """Known placeholders replaced by their literals, longest names first."""
    entries = F.reverse(F.array_sort(F.map_entries(reverse)))
    return F.aggregate(entries, masked, lambda acc, e: F.replace(acc, e["key"], e["value"]))


def scrub_invented(text: Column, known: Column) -> Column:
    """Placeholders that the masking didn't make become ``:VALUE``; ``known``: array of names."""
    found = F.array_distinct(F.regexp_extract_all(text, F.lit(r"(:(?:STR|NUM)_\d+)"), F.lit(1)))
    return F.aggregate(F.array_except(found, known), text, lambda acc, name: F.replace(acc, name, F.lit(":VALUE")))


_YEAR = re.compile(r"(\bTO_CHAR\s*\([^)]*,\s*'YYYY'\s*\)\s*=\s*)('[0-9]{4}')", re.I)


def mask_years(masked: tuple[str, dict[str, str], dict[str, dict]]) -> tuple[str, dict[str, str], dict[str, dict]]:
    """``mask``'s result with the year in ``TO_CHAR(.., 'YYYY') = 'dddd'`` hidden too, under the next free string number, and reversible."""
    sql, reverse, hints = masked
    last = max((int(k[5:]) for k in reverse if k.startswith(":STR_")), default=0)
    reverse, hints = dict(reverse), dict(hints)

    def hide(m: re.Match[str]) -> str:
        nonlocal last
        last += 1
        name = f":STR_{last:03d}"
        reverse[name] = m.group(2)
        hints[name] = {"kind": "string", "length": 4, "wildcard": "none", "shape": "digits", "literal_type": "year_value"}
        return m.group(1) + name

    return _YEAR.sub(hide, sql), reverse, hints


def masked(df: DataFrame, key: str = "submission_id", text: str = "sql") -> DataFrame:
    """``key, masked_sql, reverse_map, hints`` of each key, of several rows the least text; null texts give nulls."""
    return once(df.select(F.col(key), F.col(text).alias("_t")), key).select(F.col(key), mask_udf("_t").alias("m")).select(key, "m.*")

