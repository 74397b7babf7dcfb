"""The review-priority score: decayed rule weights, structure weights, cost band, floors."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sqlloom.config import COST_BANDS, RULE_WEIGHTS, RULES, STRUCTURE_WEIGHTS, Settings


def decayed(n: Column, weight: Column, decay: tuple[float, ...]) -> Column:
    """Weight of n repeats: the k-th counts decay[k], beyond the list its last value."""
    out = F.lit(0.0)
    for k, d in enumerate(decay[:-1]):
        out = out + F.when(n > k, F.lit(d)).otherwise(0.0)
    return weight * (out + F.greatest(n - (len(decay) - 1), F.lit(0)) * decay[-1])


def cost_band(cost: Column, threshold: int) -> Column:
    ratio = cost / float(max(threshold, 1))
    out = F.lit(COST_BANDS[-1][1])
    for most, score in reversed(COST_BANDS[:-1]):
        out = F.when(ratio <= most, score).otherwise(out)
    return F.when(cost.isNull(), 0.0).otherwise(out)


def rule_weights(found: DataFrame, settings: Settings = Settings()) -> DataFrame:
    """Decayed weight sum of each submission and statement index, before caps."""
    weights = {r: float(RULE_WEIGHTS[k]) for r, _, _, k in RULES}
    table = F.create_map(*[F.lit(x) for kv in weights.items() for x in kv])
    counts = found.groupBy("submission_id", "statement_index", "rule_id").agg(F.count("*").alias("n"))
    return counts.groupBy("submission_id", "statement_index").agg(F.sum(decayed(F.col("n"), table[F.col("rule_id")], settings.decay)).alias("weight"))


def structure(settings: Settings = Settings()) -> Column:
    """Weights of the complexity flags present, and of many tables, capped."""
    out = F.lit(0.0)
    for flag, w in STRUCTURE_WEIGHTS.items():
        out = out + F.when(F.array_contains("flags", flag), float(w)).otherwise(0.0)
    return F.least(out + F.when(F.size("tables") >= settings.many_tables, settings.many_tables_weight).otherwise(0.0), F.lit(settings.structure_cap))


def scores(requests_: DataFrame, statements: DataFrame, found: DataFrame, settings: Settings = Settings()) -> DataFrame:
    """``submission_id, base_index, rule_score, structure_score, cost_score, score, level, breakdown``.

    The base is the statement with the largest rule and structure weight, the earliest among
    equals; weights of the whole request add to every statement, and stand alone as a virtual
    last row. Half points round to even. ``breakdown`` holds the three components, rounded to one
    decimal, and a row for each floor that raised the score.
    """
    weights = rule_weights(found, settings)
    whole = weights.where("statement_index = -1").select("submission_id", F.least("weight", F.lit(settings.rule_cap)).alias("g"))
    own = weights.where("statement_index >= 0").select("submission_id", F.col("statement_index").alias("idx"), F.col("weight").alias("w"))
    rows = statements.select("submission_id", "idx", structure(settings).alias("s"), F.array_contains("flags", "cartesian_join").alias("cartesian")).join(own, ["submission_id", "idx"], "left")
    virtual = requests_.select("submission_id", F.lit(1 << 30).alias("idx"), F.lit(0.0).alias("s"), F.lit(False).alias("cartesian"), F.lit(0.0).alias("w"))
    every = rows.unionByName(virtual).join(whole, "submission_id", "left").na.fill(0.0, ["w", "g"])
    f = F.least(F.col("w") + F.col("g"), F.lit(settings.rule_cap))
    best = every.withColumn("f", f).groupBy("submission_id").agg(
        F.max_by(F.struct("idx", "f", "s"), F.struct(F.col("f") + F.col("s"), -F.col("idx"))).alias("b"), F.max("cartesian").alias("cartesian")
    )
    blocks = found.where("status = 'BLOCK'").select("submission_id", F.lit(True).alias("blocked")).dropDuplicates()
    joined = requests_.select("submission_id", "cost").join(best, "submission_id").join(blocks, "submission_id", "left")
    band = cost_band(F.col("cost"), settings.cost_threshold)
    raw = F.greatest(F.lit(0.0), F.least(F.lit(100.0), F.bround(F.col("b.f") + F.col("b.s") + F.col("c"), 0)))
    structural = F.when(F.col("cartesian") & (F.col("raw") < settings.cartesian_floor), settings.cartesian_floor)
    blocking = F.when(F.col("blocked") & (F.coalesce(structural, F.col("raw")) < settings.block_floor), settings.block_floor)
    out = joined.withColumn("c", band).withColumn("raw", raw).withColumn("score", F.coalesce(blocking, structural, F.col("raw")).cast("int"))
    part = lambda name, c: F.struct(F.lit(name).alias("component"), F.bround(c, 1).alias("score"))
    floors = F.filter(F.array(part("structure_floor", structural), part("block_floor", blocking)), lambda x: x["score"].isNotNull())
    breakdown = F.concat(F.array(part("rule_findings", F.col("b.f")), part("structure", F.col("b.s")), part("cost_ratio", F.col("c"))), floors)
    level = F.when(F.col("score") >= 80, "PRIORITY").when(F.col("score") >= 60, "IMPROVE").otherwise("GOOD")
    index = F.when(F.col("b.idx") == 1 << 30, -1).otherwise(F.col("b.idx"))
    return out.select("submission_id", index.cast("int").alias("base_index"), F.col("b.f").alias("rule_score"), F.col("b.s").alias("structure_score"), F.col("c").alias("cost_score"), "score", level.alias("level"), breakdown.alias("breakdown"))
