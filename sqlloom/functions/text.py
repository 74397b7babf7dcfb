"""Text functions made of built-in expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

REDACTED = "[REDACTED]"


def strip_comments(c: Column) -> Column:
    """Without comments, but with hints: block comments become a blank, line comments vanish."""
    return F.regexp_replace(F.regexp_replace(c, r"(?s)/\*(?!\+).*?\*/", " "), r"--(?!\+)[^\n]*", "")


def deidentify(c: Column) -> Column:
    """Identity numbers, e-mail addresses and runs of 8 and more digits replaced; letters and digits of every script count, as in the reference."""
    before, after = r"(?<![\p{L}\p{N}_])", r"(?![\p{L}\p{N}_])"  # \b of Java depends on its version
    out = F.regexp_replace(c, before + r"[A-Za-z][12]\p{Nd}{8}" + after, REDACTED)
    out = F.regexp_replace(out, r"[\p{L}\p{N}._%+-]+@[\p{L}\p{N}.-]+\.\p{L}{2,}", REDACTED)
    return F.regexp_replace(out, before + r"\p{Nd}{8,}" + after, REDACTED)


def fingerprint(c: Column) -> Column:
    """16 hexadecimal digits of the text's upper case with single blanks."""
    return F.substring(F.sha2(F.upper(F.trim(F.regexp_replace(c, r"[\s\x85\xA0\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]+", " "))), 256), 1, 16)


def parallel_hint(c: Column) -> Column:
    """The first hint that asks for parallel execution, of block hints before line hints; null without."""
    blank = F.regexp_replace(c, r"'(?:[^']|'')*'", "''")
    hits = lambda p: F.filter(F.regexp_extract_all(blank, F.lit(p), F.lit(0)), lambda h: h.rlike(r"(?i)\bPARALLEL(_INDEX)?\b"))
    return F.coalesce(F.get(hits(r"(?s)/\*\+.*?\*/"), 0), F.get(hits(r"--\+[^\n]*"), 0))


def token_estimate(c: Column) -> Column:
    """Chinese characters count whole, four others one; plus one."""
    han = F.regexp_count(c, F.lit("[\\x{3400}-\\x{9FFF}]"))
    return (han + F.floor((F.length(c) - han) / 4) + 1).cast("long")


def context_tier(tokens: Column, base: int = 16384, most: int = 32768, reply: int = 3072) -> Column:
    """The smallest doubling of ``base`` that holds the tokens and the reply, at most ``most``."""
    out, size = F.lit(most), base
    steps = []
    while size < most:
        steps.append(size)
        size *= 2
    for s in reversed(steps):
        out = F.when(tokens + reply <= s, s).otherwise(out)
    return out


def sql_looking(c: Column) -> Column:
    """Whether a fragment is SQL rather than prose: no Chinese characters or full-width signs outside literals."""
    return ~F.regexp_replace(c, r"'(?:[^']|'')*'", "''").rlike("[\\x{3400}-\\x{9FFF}\\x{FF00}-\\x{FFEF}\\x{3000}-\\x{303F}]")


def confidence_band(c: Column) -> Column:
    return F.when(c >= 80, "high").when(c >= 60, "medium").when(c.isNotNull(), "low")


def digits_only(c: Column) -> Column:
    """The stricter cost check: digits after removing commas and blanks."""
    return F.regexp_replace(c, r"[,\s]", "").rlike(r"^\d+$")


def assumption_prefix(c: Column) -> Column:
    """A leading conditional clause of at most 80 characters before a colon, else empty."""
    return F.regexp_extract(c, r"^((?:If|When|Assuming|Provided|若|如果|假設|當)[^:：]{0,80})[:：]", 1)
