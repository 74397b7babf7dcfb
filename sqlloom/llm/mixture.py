"""Mixing sources to target shares by Pareto order sampling.

Every source gets a number of tokens: its target share of the total, at most ``max_repeats``
times its size; what a capped source can't take goes to the others in proportion to their
targets. Within a source a document's expected number of uses grows with the square root of
its size, ``min(max_repeats, c * sqrt(n_tokens))``, with ``c`` such that the expected tokens are
the source's. Its whole part are copies taken with certainty, its fraction is the inclusion
probability of one more. These are drawn by Pareto order sampling: documents are ranked by the
odds of a uniform number over their inclusion odds, and the first ones that fill what the
certain copies leave of the source's tokens are taken.

The ranking is never a sort of a source, and documents are never shuffled: token sums of
``BINS`` bins of the ranking are pre-aggregated, the bin in which the target falls is cut into
bins again, until few documents are left. Their order gives one threshold a source, and every
document is compared with the broadcast threshold.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

BINS = 1 << 10
EDGE = 4096  # a bin of so few documents is ordered instead of cut again
LEVELS = 4  # 2**40 places of a ranking; beyond that equal places are ordered by doc_id
SEED = 20250106
MAX_TARGETS = 100_000  # more are an error: the targets and their bins are held by the driver


def allocation(sizes: dict[str, int], targets: list[tuple[str, float, int]], total: int) -> dict[str, float]:
    """Tokens of each source. ``targets``: (source, share, most repeats)."""
    cap = {s: float(sizes.get(s, 0) * most) for s, _, most in targets}
    share = {s: x for s, x, _ in targets}
    got: dict[str, float] = {}
    open_, rest = {s for s in share if share[s] > 0 and cap[s] > 0}, float(total)
    while open_:
        whole = sum(share[s] for s in open_)
        full = {s for s in open_ if rest * share[s] / whole >= cap[s]}
        if not full:
            got |= {s: rest * share[s] / whole for s in open_}
            break
        got |= {s: cap[s] for s in full}
        rest -= sum(cap[s] for s in full)
        open_ -= full
    return {s: got.get(s, 0.0) for s in share}


def factor(sizes: list[tuple[int, float]], most: int, tokens: float) -> float:
    """The ``c`` for which ``min(most, c * g) * n``, summed over groups ``(n, n * g)`` of like documents, is ``tokens``."""
    if tokens >= most * sum(n for n, _ in sizes) * (1 - 1e-12):
        return float("inf")
    rest, weight = tokens, sum(ng for _, ng in sizes)
    for n, ng in sorted(sizes, key=lambda x: x[0] / x[1]):  # largest documents first: those reach ``most`` first
        if rest * ng < most * n * weight:
            break
        rest -= most * n
        weight -= ng
    return rest / weight if weight > 0 else 0.0


def _with_plan(docs: DataFrame, plan: list[tuple[str, int, float]], seed: int) -> DataFrame:
    """``whole`` copies, and the ``place`` in (0, 1) of each document in the ranking for one more; null without a chance."""
    rates = F.broadcast(docs.sparkSession.createDataFrame(plan or [("", 0, 0.0)], "source string, most int, c double"))
    rate = F.when(F.col("n_tokens") > 0, F.least(F.col("most").cast("double"), F.col("c") * F.sqrt("n_tokens"))).otherwise(0.0)
    uniform = ((F.xxhash64(F.lit(seed), "doc_id").bitwiseAND(F.lit((1 << 53) - 1))).cast("double") + 0.5) / float(1 << 53)
    pi, u = F.col("rate") - F.col("whole"), F.col("u")
    odds = (u / (1 - u)) / (pi / (1 - pi))
    rows = docs.join(rates, "source", "left").withColumn("rate", F.coalesce(rate, F.lit(0.0))).withColumn("whole", F.floor(F.col("rate") + 1e-9).cast("int")).withColumn("u", uniform)
    return rows.withColumn("place", F.when(pi > 1e-9, odds / (1 + odds))).drop("rate", "u", "most", "c")


def _thresholds(drawn: DataFrame, tokens: dict[str, float]) -> list[tuple[str, float, int | None]]:
    """For each source the place, and there the doc_id, up to which documents get one more copy."""
    spark = drawn.sparkSession
    whole = {r[0]: int(r[1] or 0) for r in drawn.groupBy("source").agg(F.sum(F.col("whole") * F.col("n_tokens"))).where("source IS NOT NULL").collect() if r[0] in tokens}
    # What is still to fill from the open interval of each source: (low, width, tokens).
    opened = {s: (0.0, 1.0, tokens[s] - whole[s]) for s in whole if tokens[s] - whole[s] > 0.5}
    done: dict[str, tuple[float, int | None]] = {}
    order: set[str] = set()

    def within(names: set[str]) -> DataFrame:
        edges = spark.createDataFrame([(s, *opened[s]) for s in sorted(names)], "source string, low double, width double, need double")
        return drawn.where("place IS NOT NULL").join(F.broadcast(edges), "source").where("place >= low AND place < low + width")

    for _ in range(LEVELS):
        left = set(opened) - set(done) - order
        if not left:
            break
        at = F.floor((F.col("place") - F.col("low")) / F.col("width") * BINS).cast("int")
        bins: dict[str, list[tuple[int, int, int]]] = {s: [] for s in left}
        for r in within(left).groupBy("source", at.alias("bin")).agg(F.sum("n_tokens").alias("n"), F.count("*").alias("rows")).collect():  # BINS rows a source
            bins[r.source].append((r.bin, r.n, r.rows))
        for s, found in bins.items():
            low, width, need = opened[s]
            done[s] = (low + width, None)  # unless a bin holds the target, all are taken
            for b, n, rows in sorted(found):
                if n > need:
                    del done[s]
                    opened[s] = (low + b * width / BINS, width / BINS, need)
                    if rows <= EDGE:
                        order.add(s)
                    break
                need -= n
    order |= set(opened) - set(done)
    if order:
        one = within(order).groupBy("source", "need", "place", "doc_id").agg(F.sum("n_tokens").alias("n"))
        w = Window.partitionBy("source").orderBy("place", "doc_id").rowsBetween(Window.unboundedPreceding, 0)
        ranked = one.withColumn("upto", F.sum("n").over(w))
        # The document that crosses the target is taken if that comes nearer to it.
        taken = ranked.where((F.col("upto") <= F.col("need")) | (F.col("upto") - F.col("need") < F.col("n") / 2))
        last = {r.source: r.last for r in taken.groupBy("source").agg(F.max(F.struct("place", "doc_id")).alias("last")).collect()}
        for s in order:
            done[s] = (last[s].place, last[s].doc_id) if s in last else (opened[s][0], None)
    return [(s, *x) for s, x in sorted(done.items())]


def _reached() -> Column:
    return F.coalesce((F.col("place") < F.col("last_place")) | (F.col("place") == F.col("last_place")) & (F.col("doc_id") <= F.col("last_doc")), F.lit(False))


def mixed(docs: DataFrame, targets: DataFrame, seed: int = SEED) -> DataFrame:
    """``doc_id, source, n_tokens, uses`` of every document of ``docs`` (doc_id, source, n_tokens).

    ``docs`` should be a written table, for it is read several times. Documents of null or unlisted
    sources and those without tokens are used 0 times; repeated rows of a document share one draw.
    No targets or no tokens give 0 uses. A source listed twice counts with its first share by name.
    """
    spark = docs.sparkSession
    wanted_rows = [(r[0], float(r[1] or 0.0), int(r[2] or 0)) for r in targets.select("source", "target_share", "max_repeats").where("source IS NOT NULL").limit(MAX_TARGETS + 1).collect()]
    if len(wanted_rows) > MAX_TARGETS:
        raise ValueError(f"more than {MAX_TARGETS} targets")
    wanted = sorted({s: (s, x, m) for s, x, m in sorted(wanted_rows, reverse=True)}.values())
    names = F.broadcast(spark.createDataFrame([(s,) for s, _, _ in wanted] or [("",)], "source string"))
    # Groups of like size, 32 an octave, at most some 2000 a source.
    size = F.floor(F.log2("n_tokens") * 32).cast("int")
    groups: dict[str, list[tuple[int, float]]] = {}
    if wanted:
        for r in docs.where("n_tokens > 0").join(names, "source", "left_semi").groupBy("source", size.alias("size")).agg(F.sum("n_tokens").alias("n"), F.sum(F.col("n_tokens") * F.sqrt("n_tokens")).alias("ng")).collect():
            groups.setdefault(r.source, []).append((r.n, r.ng))
    sizes = {s: sum(n for n, _ in g) for s, g in groups.items()}
    tokens = allocation(sizes, wanted, sum(sizes.values()))
    plan = [(s, most, factor(groups[s], most, tokens[s])) for s, _, most in wanted if s in groups and tokens[s] > 0]
    drawn = _with_plan(docs, plan, seed)
    last = _thresholds(drawn, {s: tokens[s] for s, _, _ in plan}) if plan else []
    limits = F.broadcast(spark.createDataFrame(last or [("", 0.0, None)], "source string, last_place double, last_doc long"))
    out = drawn.join(limits, "source", "left").withColumn("uses", (F.col("whole") + _reached().cast("int")).cast("int"))
    return out.select("doc_id", "source", "n_tokens", "uses")


def shares(uses: DataFrame, targets: DataFrame) -> DataFrame:
    """For each listed source its target share, tokens and actual share of the mixture."""
    used = uses.where("uses > 0").groupBy("source").agg(F.sum(F.col("n_tokens") * F.col("uses")).alias("used_tokens"))
    out = targets.select("source", "target_share", "max_repeats").join(used, "source", "left").na.fill(0, ["used_tokens"])
    whole = out.agg(F.sum("used_tokens").alias("total"), F.collect_list(F.struct(*out.columns)).alias("rows"))  # as many as targets
    share = F.when(F.col("total") > 0, F.col("used_tokens") / F.col("total")).otherwise(0.0)
    return whole.select("total", F.inline("rows")).select("source", "target_share", "max_repeats", "used_tokens", share.alias("actual_share"))
