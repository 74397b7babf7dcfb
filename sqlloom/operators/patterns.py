"""Catalog patterns of statements, their evidence, and bounded context packing."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sqlloom.config import GUIDANCE, Settings, evidence_frame, patterns_frame

CLASS_ORDER = {"VERIFIED_REWRITE": 0, "ADVICE_ONLY": 1, "INFORMATIONAL": 2, "OUT_OF_SCOPE": 3}


def signals(statements: DataFrame, found: DataFrame, settings: Settings = Settings()) -> DataFrame:
    """(submission_id, statement_index, signal): flags, derivable rewrites, many tables, and rules that fired."""
    many = F.when(F.size("tables") >= settings.many_tables, F.array(F.lit("many_tables"))).otherwise(F.array().cast("array<string>"))
    own = statements.select("submission_id", F.col("idx").alias("statement_index"), F.explode(F.concat("flags", "rewrite_rules", many)).alias("signal"))
    return own.unionByName(found.select("submission_id", "statement_index", F.col("rule_id").alias("signal"))).dropDuplicates()


def matches(statements: DataFrame, found: DataFrame, settings: Settings = Settings()) -> DataFrame:
    """``submission_id, pos, pattern_id, classification, match_kind, statement_indexes``: exact matches, and family matches of patterns without one."""
    catalog = F.broadcast(patterns_frame(statements.sparkSession))
    hits = signals(statements, found, settings).join(catalog, "signal").groupBy("submission_id", "pos", "pattern_id", "classification", "how").agg(F.array_sort(F.collect_set("statement_index")).alias("statement_indexes"))
    exact = hits.where("how = 'exact'")
    family = hits.where("how = 'family'").join(exact.select("submission_id", "pattern_id"), ["submission_id", "pattern_id"], "left_anti")
    return exact.unionByName(family.select(exact.columns)).withColumnRenamed("how", "match_kind")


def evidence(matched: DataFrame, statements: DataFrame) -> DataFrame:
    """``submission_id, evidence_id, pattern_id, statement_indexes, variant`` of exact matches in scope.

    ``variant`` is ``default``; a SUBSTR rewrite has evidence of its own besides: ``fixed_prefix``
    where the pattern of its LIKE begins with a letter, ``leading_wildcard`` where it doesn't.
    Clean-ups that only change the writing have none. The four columns besides the submission are
    a key.
    """
    refs = F.broadcast(evidence_frame(matched.sparkSession).select("pattern_id", "evidence_id"))
    chosen = matched.where("match_kind = 'exact' AND classification <> 'OUT_OF_SCOPE' AND pattern_id <> 'OR_SAME_COLUMN_TO_IN'")
    columns = ["submission_id", "evidence_id", "pattern_id", "statement_indexes", "variant"]
    usual = chosen.join(refs, "pattern_id").withColumn("variant", F.lit("default")).select(columns)
    first = F.substring(F.regexp_extract("r.after", r"LIKE\s+N?'((?:[^']|'')*)'", 1), 1, 1)
    likes = statements.select("submission_id", "idx", F.explode("rewrites").alias("r")).where("r.rule = 'substr_eq_to_like'").select("submission_id", "idx", first.alias("first")).where("first <> ''")
    likes = likes.select("submission_id", "idx", F.when(F.col("first").isin("%", "_"), "leading_wildcard").otherwise("fixed_prefix").alias("variant")).dropDuplicates()
    own = chosen.where("pattern_id = 'SUBSTR_EQ_TO_LIKE'").withColumn("idx", F.explode("statement_indexes")).join(likes, ["submission_id", "idx"])
    own = own.withColumn("evidence_id", F.when(F.col("variant") == "fixed_prefix", "ORACLE11G_PREFIX_LIKE_RANGE_SCAN").otherwise("ORACLE11G_LEADING_WILDCARD_RANGE_LIMIT"))
    return usual.unionByName(own.select(columns)).dropDuplicates()


HARD_ITEMS, HARD_CHARS = 8, 6000  # beyond these no setting goes


def packed(matched: DataFrame, items: int = 4, chars: int = 1800) -> DataFrame:
    """``submission_id, statement_index, patterns, chars``: the catalog items that fit a statement's context.

    By class, then catalog order, greedily; one that is too big is skipped and uses nothing up. The
    size of an item is that of its compact JSON.
    """
    items, chars = (min(max(x, 0), most) for x, most in ((items, HARD_ITEMS), (chars, HARD_CHARS)))
    order = F.create_map(*[F.lit(x) for kv in CLASS_ORDER.items() for x in kv])
    guidance = F.create_map(*[F.lit(x) for kv in GUIDANCE.items() for x in kv])
    name = F.replace(F.lower("pattern_id"), F.lit("_"), F.lit(" "))
    size = F.length(F.to_json(F.struct("pattern_id", "classification", name.alias("name"), guidance[F.col("pattern_id")].alias("guidance"))))
    rows = matched.where("match_kind = 'exact' AND classification <> 'OUT_OF_SCOPE'").withColumn("statement_index", F.explode("statement_indexes")).where("statement_index >= 0")
    lists = rows.groupBy("submission_id", "statement_index").agg(F.array_sort(F.collect_list(F.struct(order[F.col("classification")].alias("c"), "pos", "pattern_id", size.alias("n")))).alias("ps"))  # at most one of each catalog pattern
    zero = F.struct(F.array().cast("array<string>").alias("taken"), F.lit(0).alias("used"))

    def step(acc, p):
        fits = (F.size(acc["taken"]) < items) & (acc["used"] + p["n"] <= chars)
        return F.when(fits, F.struct(F.concat(acc["taken"], F.array(p["pattern_id"])).alias("taken"), (acc["used"] + p["n"]).cast("int").alias("used"))).otherwise(acc)

    return lists.select("submission_id", "statement_index", F.aggregate("ps", zero, step).alias("a")).select("submission_id", "statement_index", F.col("a.taken").alias("patterns"), F.col("a.used").alias("chars"))
