"""Findings, rule rows and compliance: built-in expressions over statements."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sqlloom.config import RESTRICTION_VERDICTS, RULES, Settings, glob_to_regex


def cost(raw: Column) -> Column:
    """A cost text as a whole number, null unless it is digits after removing commas and blanks (a leading minus makes it invalid too)."""
    plain = F.regexp_replace(raw, "[, ]", "")
    return F.when(plain.rlike("^[0-9]+$"), plain.try_cast("long"))


def requests(df: DataFrame) -> DataFrame:
    """``submission_id, application_no, cost, include_ai, error_code`` of each key; ``error_code`` is null for valid rows.

    The texts are only looked at. Of several rows of a key the least by these columns counts, a
    valid one before others.
    """
    c = cost(F.col("cost_raw"))
    code = (
        F.when(F.col("application_no").isNull() | ~F.col("application_no").rlike(r"\S") | (F.length(F.trim("application_no")) > 50), "bad_application_no")
        .when(F.col("sql").isNull() | ~F.col("sql").rlike(r"\S"), "empty_sql")
        .when(c.isNull(), "bad_cost")
        .when(F.length("plan_text") > 300_000, "plan_too_long")
    )
    rows = df.select("submission_id", F.struct(code.alias("error_code"), "application_no", c.alias("cost"), F.coalesce("include_ai", F.lit(False)).alias("include_ai")).alias("r"))
    return rows.groupBy("submission_id").agg(F.min("r").alias("r")).select("submission_id", "r.application_no", "r.cost", "r.include_ai", "r.error_code")


def _watch(tables: Column, entries: tuple[tuple[str, str], ...]) -> Column:
    """(table, message) of each table that an entry matches, the first entry winning."""
    message = F.lit(None).cast("string")
    return F.filter(
        F.transform(tables, lambda t: F.struct(t.alias("table"), _first(t, entries, message).alias("message"))), lambda s: s["message"].isNotNull()
    )


def _first(t: Column, entries: tuple[tuple[str, str], ...], none: Column) -> Column:
    out = none
    for pattern, message in reversed(entries):
        hit = t.rlike(glob_to_regex(pattern)) if "*" in pattern else t == pattern.upper()
        out = F.when(hit, message).otherwise(out)
    return out


def where_verdict() -> Column:
    """R002 of a statement: na, pass, review or block."""
    mapped = F.lit("review")
    for kind, verdict in RESTRICTION_VERDICTS.items():
        mapped = F.when(F.col("restriction_kind") == kind, verdict).otherwise(mapped)
    return F.when(~F.col("where_applicable"), "na").when(F.col("has_where"), "pass").when(F.col("has_where").isNull(), "review").when(F.col("restriction_kind").isNull(), "block").otherwise(mapped)


def findings(statements: DataFrame, requests_: DataFrame, settings: Settings = Settings()) -> DataFrame:
    """``submission_id, rule_id, status, fact, statement_index, table_name, message, evidence``; index -1 is the whole request.

    ``message`` is that of the watched table, ``evidence`` the fact with the number of its
    statement where there are several (R11). A WHERE that couldn't be judged is reviewed without a finding; OR gives one finding a statement
    whatever the count, LIKE and functions one for each hit.
    """
    s = statements.withColumn("where_verdict", where_verdict())

    none = F.lit(None).cast("string")

    def rule(name: str, status: str | Column, fact: Column, table: Column = none, message: Column = none):
        state = F.lit(status) if isinstance(status, str) else status
        return F.struct(F.lit(name).alias("rule_id"), state.alias("status"), fact.cast("string").alias("fact"), table.alias("table_name"), message.alias("message"))

    empty = F.array().cast("array<struct<rule_id:string,status:string,fact:string,table_name:string,message:string>>")
    parts = [
        F.when((F.col("where_verdict") == "block") | ((F.col("where_verdict") == "review") & F.col("has_where").isNotNull()), F.array(rule("R002", F.upper("where_verdict"), F.coalesce("restriction_kind", F.lit("no_where"))))).otherwise(empty),
        F.when(F.col("hint").isNotNull(), F.array(rule("R003", "BLOCK", F.col("hint")))).otherwise(empty),
        F.transform("like_hits", lambda x: rule("R004", "NOTICE", x)),
        F.transform("function_hits", lambda x: rule("R005", "NOTICE", x)),
        F.when(F.col("or_count") > 0, F.array(rule("R006", "NOTICE", F.col("or_count")))).otherwise(empty),
        F.transform(_watch(F.col("tables"), settings.watched), lambda x: rule("R007", "NOTICE", x["table"], x["table"], x["message"])),
    ]
    if "R008" not in settings.disabled and settings.forbidden:
        for pattern, types in settings.forbidden:
            regex = glob_to_regex(pattern)
            hits = F.filter("tables", lambda t: t.rlike(regex))  # noqa: B023 - used at once
            allowed = F.col("statement_type").isin(*types) if types else F.lit(True)
            parts.append(F.when(allowed, F.transform(hits, lambda t: rule("R008", "BLOCK", t, t))).otherwise(empty))
    number = F.when(F.col("n_statements") > 1, F.concat(F.lit("statement "), F.col("idx") + 1, F.lit(": "))).otherwise("")
    whole = s.select("submission_id", F.explode(F.concat(*parts)).alias("f"), F.col("idx").alias("statement_index"), number.alias("_n"))
    whole = whole.select("submission_id", "f.rule_id", "f.status", "f.fact", "statement_index", "f.table_name", "f.message", F.concat("_n", "f.fact").alias("evidence"))
    over = requests_.where(F.col("cost") >= settings.cost_threshold)
    relation = F.when(F.col("cost") == settings.cost_threshold, "equal").otherwise("above")
    costs = over.select("submission_id", F.lit("R001").alias("rule_id"), F.lit("BLOCK").alias("status"), relation.alias("fact"), F.lit(-1).alias("statement_index"), none.alias("table_name"), none.alias("message"), relation.alias("evidence"))
    found = whole.unionByName(costs)
    return found.where(~F.col("rule_id").isin(*settings.disabled)) if settings.disabled else found


def rule_rows(requests_: DataFrame, statements: DataFrame, found: DataFrame, settings: Settings = Settings()) -> DataFrame:
    """Eight rows a request: status of each rule (NA where disabled or not applicable), number of findings, evidence and note.

    ``evidence`` joins the facts by statement, each statement with its number where there are
    several; ``note`` the different messages of watched tables, of which a statement gives that
    of its last one.
    """
    rules = F.array(*(F.struct(F.lit(i).alias("pos"), F.lit(r[0]).alias("rule_id")) for i, r in enumerate(RULES)))
    # Facts of one statement first, then statements: a request has as many as its text holds.
    each = found.groupBy("submission_id", "rule_id", "statement_index").agg(
        F.count("*").alias("n"), F.max(F.col("status") == "BLOCK").alias("block"), F.max(F.col("status") == "REVIEW").alias("review"), F.array_join(F.array_sort(F.collect_list("fact")), ", ").alias("facts"),
        F.max(F.substring_index("evidence", ": ", 1)).alias("_number"), F.max(F.col("evidence") != F.col("fact")).alias("_many"), F.max_by("message", "table_name").alias("message"),
    )
    text = F.when(F.col("_many"), F.concat(F.col("_number"), F.lit(": "), F.col("facts"))).otherwise(F.col("facts"))
    joined = lambda c: F.transform(F.array_sort(F.collect_list(F.when(c.isNotNull(), F.struct("statement_index", c.alias("t"))))), lambda x: x["t"])
    counts = each.groupBy("submission_id", "rule_id").agg(
        F.sum("n").alias("n_findings"), F.max("block").alias("block"), F.max("review").alias("review"),
        F.array_join(joined(text), "; ").alias("evidence"), F.array_join(F.array_distinct(joined(F.col("message"))), "; ").alias("note"),
    )
    where = statements.select("submission_id", where_verdict().alias("v")).groupBy("submission_id").agg(F.max(F.col("v") == "review").alias("unclear"), F.max(F.col("v") != "na").alias("applicable"))
    base = requests_.select("submission_id").join(where, "submission_id", "left").select("*", F.inline(rules))  # eight rows each
    status = (
        F.when(F.col("rule_id").isin(*settings.disabled) if settings.disabled else F.lit(False), "NA")
        .when(F.col("block"), "BLOCK")
        .when((F.col("rule_id") == "R002") & (F.col("review") | F.col("unclear")), "REVIEW")
        .when((F.col("rule_id") == "R002") & ~F.coalesce("applicable", F.lit(False)), "NA")
        .when(F.col("n_findings").isNotNull(), "NOTICE")
        .otherwise("PASS")
    )
    return base.join(counts, ["submission_id", "rule_id"], "left").select("submission_id", "pos", "rule_id", status.alias("status"), F.coalesce("n_findings", F.lit(0)).alias("n_findings"), F.coalesce("evidence", F.lit("")).alias("evidence"), F.coalesce("note", F.lit("")).alias("note"))


def compliance(rows: DataFrame) -> DataFrame:
    """BLOCK if a blocking rule blocks, else REVIEW if one is in review, else PASS; with counts of blocking and noticing rows."""
    hard = F.col("rule_id").isin("R001", "R002", "R003", "R008")
    blocks, reviews = F.sum(F.when(hard & (F.col("status") == "BLOCK"), 1).otherwise(0)), F.sum(F.when(hard & (F.col("status") == "REVIEW"), 1).otherwise(0))
    return rows.groupBy("submission_id").agg(blocks.alias("block_count"), F.sum(F.when(F.col("status") == "NOTICE", 1).otherwise(0)).alias("notice_count"), reviews.alias("_r")).select(
        "submission_id", F.when(F.col("block_count") > 0, "BLOCK").when(F.col("_r") > 0, "REVIEW").otherwise("PASS").alias("status"), "block_count", "notice_count"
    )
