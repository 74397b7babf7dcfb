"""Analysis of execution plans on top of their typed rows."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Runtime statistics by their name in the text, and functions looked for in filters.
METRICS = {
    "recursive calls": "recursive_calls", "db block gets": "db_block_gets", "consistent gets": "consistent_gets", "physical reads": "physical_reads", "redo size": "redo_size",
    "bytes sent via sql*net to client": "sqlnet_bytes_sent", "bytes received via sql*net from client": "sqlnet_bytes_received", "sql*net roundtrips to/from client": "sqlnet_roundtrips",
    "sorts (memory)": "sorts_memory", "sorts (disk)": "sorts_disk", "rows processed": "rows_processed",
}
FILTER_FUNCTIONS = r"(?i)\b(SUBSTR|TRUNC|NVL|TO_CHAR|UPPER|LOWER|TRIM)\s*\("
SUMMARY_FUNCTIONS = r"(?i)\b(SUBSTR|TRUNC|NVL|TO_CHAR|TO_DATE|TO_NUMBER|UPPER|LOWER|TRIM)\s*\("
# Operation labels, tested in this order.
OPERATIONS = (
    ("TABLE ACCESS FULL", "TABLE_ACCESS_FULL"), ("TABLE ACCESS", "TABLE_ACCESS"), ("INDEX", "INDEX_ACCESS"), ("HASH JOIN", "HASH_JOIN"), ("NESTED LOOPS", "NESTED_LOOPS"), ("MERGE JOIN", "MERGE_JOIN"),
    ("SORT ORDER BY", "SORT_ORDER_BY"), ("GROUP BY", "GROUP_BY"), ("HASH UNIQUE", "DEDUPLICATE"), ("SORT UNIQUE", "DEDUPLICATE"), ("FILTER", "FILTER"), ("VIEW", "VIEW"), ("WINDOW", "WINDOW"), ("UNION-ALL", "UNION_ALL"), ("UNION ALL", "UNION_ALL"),
)
_HEADINGS = ("Note", "Statistics", "Column Projection", "Outline Data", "Query Block", "Plan hash", "Hint Report", "Remote SQL")


def label(operation: Column, options: Column) -> Column:
    return F.upper(F.trim(F.concat_ws(" ", operation, options)))


def operation_kind(operation: Column, options: Column) -> Column:
    text = label(operation, options)
    out = F.lit("OTHER")
    for word, kind in reversed(OPERATIONS):
        out = F.when(text.contains(word), kind).otherwise(out)
    return out


def predicate_entries(text: str) -> list[tuple[int, str, str]]:
    """(step id, access or filter, predicate) of the predicate section; continued lines are joined until brackets close."""
    import re

    at = text.find("Predicate Information")
    if at < 0:
        return []
    out: list[tuple[int, str, str]] = []
    current: list | None = None
    depth = 0

    def close() -> None:
        nonlocal current
        if current:
            body = " ".join(current[2]).strip()
            out.append((current[0], current[1], body[:-1] if body.endswith(")") else body))
        current = None

    step = None
    for line in text[at:].split("\n")[1:]:
        line = line.rstrip("\r")
        bare = line.strip()
        if not bare:
            continue
        if not bare.strip("-"):
            continue
        if bare.startswith(_HEADINGS):
            break
        m = re.match(r"\s*(?:(\d+)\s*-\s*)?(access|filter)\(", line)
        if m and (m.group(1) is not None or step is not None) and depth <= 0:
            close()
            step = int(m.group(1)) if m.group(1) is not None else step
            rest = line[m.end() :].strip()
            current, depth = [step, m.group(2), [rest]], 1 + rest.count("(") - rest.count(")")
        elif current is not None and depth > 0:
            current[2].append(bare)
            depth += bare.count("(") - bare.count(")")
        elif re.match(r"\s*\d+\s*-\s*\S", line):
            close()
            step = None
    close()
    return out


def predicates(df: DataFrame, key: str = "plan_id", text: str = "plan_text") -> DataFrame:
    """``key, step_id, kind, predicate, pos`` of the predicate sections."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = [(k, *e, i) for k, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist()) for i, e in enumerate(predicate_entries(t))]
            columns = list(zip(*rows)) if rows else [[], [], [], [], []]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int32()))], ["key", "step_id", "kind", "predicate", "pos"])

    rows = df.select(F.col(key).cast("long").alias("key"), F.col(text).alias("text")).where(F.col("text").contains("Predicate Information"))
    return rows.mapInArrow(run, "key long, step_id long, kind string, predicate string, pos int").dropDuplicates(["key", "pos"])


def with_predicates(steps: DataFrame, section: DataFrame) -> DataFrame:
    """Steps with ``access`` and ``filter`` lists: the row's own predicates, then those of the section, without repeats."""
    lists = section.groupBy("key", "step_id").agg(
        *(F.transform(F.array_sort(F.collect_list(F.when(F.col("kind") == k, F.struct("pos", "predicate")))), lambda x: x["predicate"]).alias(f"_{k}") for k in ("access", "filter"))
    )
    out = steps.join(lists, ["key", "step_id"], "left")
    none = F.array().cast("array<string>")
    for k in ("access", "filter"):
        own = F.col(f"{k}_predicates")
        out = out.withColumn(k, F.array_union(F.when(own.isNotNull(), F.array(own)).otherwise(none), F.coalesce(F.col(f"_{k}"), none))).drop(f"_{k}")
    return out


def metrics(df: DataFrame, key: str = "plan_id", text: str = "plan_text") -> DataFrame:
    """``key, metric, value`` of known runtime statistics, the first line of each counting."""
    lines = df.select(F.col(key).cast("long").alias("key"), F.posexplode(F.split(F.col(text), "\r?\n")).alias("pos", "line")).where(r"line RLIKE '^\\s*[0-9][0-9,]*\\s+[A-Za-z]'")
    name = F.lower(F.trim(F.regexp_extract("line", r"^\s*[0-9][0-9,]*\s+(.*)$", 1)))
    known = F.create_map(*[F.lit(x) for kv in METRICS.items() for x in kv])
    found = lines.select("key", "pos", known[name].alias("metric"), F.regexp_replace(F.regexp_extract("line", r"^\s*([0-9][0-9,]*)", 1), ",", "").try_cast("long").alias("value")).where("metric IS NOT NULL")
    return found.groupBy("key", "metric").agg(F.min_by("value", "pos").alias("value"))


def plans(df: DataFrame, steps: DataFrame, measured: DataFrame, key: str = "plan_id", expected: str | None = "expected_cost") -> DataFrame:
    """One row a plan: ``key, recognized, n_steps, source, root_cost, cost_matches``; texts without a grid are unrecognised."""
    runtime = F.max(F.greatest(*(F.col(c).isNotNull() for c in ("actual_rows", "starts", "buffers", "reads", "actual_time"))))
    grid = steps.groupBy("key").agg(
        F.count("*").alias("n_steps"), runtime.alias("runtime"), F.min_by("cost", F.when(F.col("step_id") == 0, F.col("seq"))).alias("zero"), F.min_by(F.struct("cost"), "seq").alias("first")
    )
    stats = measured.select("key").dropDuplicates().withColumn("measured", F.lit(True))
    base = df.select(F.col(key).cast("long").alias("key"), (F.col(expected) if expected else F.lit(None)).cast("long").alias("expected")).groupBy("key").agg(F.max("expected").alias("expected"))
    root = F.coalesce("zero", "first.cost")
    return base.join(grid, "key", "left").join(stats, "key", "left").select(
        "key", F.col("n_steps").isNotNull().alias("recognized"), F.coalesce("n_steps", F.lit(0)).alias("n_steps"),
        F.when(F.col("n_steps").isNull(), None).when(F.coalesce("measured", F.lit(False)) | F.coalesce("runtime", F.lit(False)), "actual").otherwise("estimated").alias("source"),
        root.alias("root_cost"), F.when(root.isNotNull() & F.col("expected").isNotNull(), root == F.col("expected")).alias("cost_matches"),
    )


def cardinality_ratio(estimated: Column, actual: Column, starts: Column) -> Column:
    """How far the estimate is off, at least 1: actual rows a start against estimated rows; zero against more is infinite."""
    each = actual / F.greatest(F.coalesce(starts, F.lit(1)), F.lit(1))
    low, high = F.least(estimated.cast("double"), each), F.greatest(estimated.cast("double"), each)
    return F.when(high == 0, 1.0).when(low == 0, float("inf")).otherwise(high / low)


def observations(steps: DataFrame, plan: DataFrame, substr_keys: DataFrame | None = None) -> DataFrame:
    """``key, n, code, level, step_id, detail`` from steps with predicate lists and the plan rows.

    ``n`` numbers the observations of a plan from 1: cost first, then by step (full scan, functions
    in filter order, cardinality, the last only where the plan has runtime statistics), at the end
    the first step that filters by SUBSTR, for plans in ``substr_keys`` (key), whose statement has
    a provable SUBSTR rewrite.
    """
    actual = plan.where("source = 'actual'").select("key")
    wrong = plan.where("NOT cost_matches").select("key", F.lit("COST_MISMATCH").alias("code"), F.lit("review").alias("level"), F.lit(None).cast("long").alias("step_id"), F.col("root_cost").cast("string").alias("detail"), F.lit(-1).alias("seq"), F.lit(0).alias("part"))
    columns = wrong.columns
    full = steps.where(label(F.col("operation"), F.col("options")).contains("TABLE ACCESS FULL")).select("key", F.lit("TABLE_ACCESS_FULL").alias("code"), F.lit("fact").alias("level"), "step_id", F.col("object_name").alias("detail"), "seq", F.lit(0).alias("part"))
    function = F.upper(F.regexp_extract("p", FILTER_FUNCTIONS, 1))
    filters = steps.select("key", "step_id", "seq", F.posexplode("filter").alias("at", "p")).withColumn("detail", function).where("detail <> ''")
    filters = filters.select("key", F.lit("FUNCTION_FILTER_PREDICATE").alias("code"), F.lit("opportunity").alias("level"), "step_id", "detail", "seq", (F.col("at") + 1).alias("part"))
    ratio = cardinality_ratio(F.col("estimated_rows"), F.col("actual_rows"), F.col("starts"))
    gaps = steps.where("estimated_rows IS NOT NULL AND actual_rows IS NOT NULL").join(actual, "key", "left_semi").withColumn("r", ratio).where("r >= 10")
    gaps = gaps.select("key", F.lit("CARDINALITY_GAP").alias("code"), F.lit("review").alias("level"), "step_id", F.when(F.col("r") == float("inf"), "inf").otherwise(F.floor("r").cast("string")).alias("detail"), "seq", F.lit(1 << 20).alias("part"))
    out = wrong.unionByName(full).unionByName(filters).unionByName(gaps)
    if substr_keys is not None:
        out = out.unionByName(rewrite_matches(steps, substr_keys).select("key", "code", F.lit("opportunity").alias("level"), "step_id", F.lit("SUBSTR").alias("detail"), F.lit(1 << 30).alias("seq"), F.lit(0).alias("part")).select(columns))
    w = Window.partitionBy("key").orderBy("seq", "part", "code", "detail")  # as many rows as a plan has steps and predicates
    return out.withColumn("n", F.row_number().over(w)).select("key", "n", "code", "level", "step_id", "detail")


def rewrite_matches(steps: DataFrame, substr_keys: DataFrame) -> DataFrame:
    """For keys whose statement has a SUBSTR rewrite, the first step that filters by SUBSTR."""
    hit = steps.where(F.exists("filter", lambda p: p.rlike(r"(?i)\bSUBSTR\s*\("))).groupBy("key").agg(F.min("seq").alias("seq"), F.min_by("step_id", "seq").alias("step_id"))
    return hit.join(substr_keys, "key", "left_semi").select("key", F.lit("VERIFIED_REWRITE_PLAN_MATCH").alias("code"), "step_id")


def top_steps(steps: DataFrame, n: int) -> DataFrame:
    """The n most costly steps of each plan besides the root, the smaller id first among equals; only n rows a plan are kept while sorting."""
    w = Window.partitionBy("key").orderBy(F.col("cost").desc(), F.col("step_id").asc(), F.col("seq").asc())
    return steps.where("step_id <> 0 AND cost IS NOT NULL").withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= n)


def summary(steps: DataFrame, allowed: DataFrame) -> DataFrame:
    """Top 8 steps without literals: fixed operation label, the object only if its plan allows the table, functions of the filters.

    ``allowed``: key and table_name; names are compared in upper case without their owner.
    """
    functions = F.array_sort(F.array_distinct(F.flatten(F.transform("filter", lambda p: F.transform(F.regexp_extract_all(p, F.lit(SUMMARY_FUNCTIONS), F.lit(1)), F.upper)))))
    bare = lambda c: F.substring_index(F.upper(F.trim(c)), ".", -1)
    top = top_steps(steps, 8).withColumn("functions", functions).withColumn("_object", bare(F.col("object_name")))
    named = top.join(allowed.select("key", bare(F.col("table_name")).alias("_object"), F.lit(True).alias("ok")).dropDuplicates(), ["key", "_object"], "left")
    return named.select("key", "rank", "step_id", operation_kind(F.col("operation"), F.col("options")).alias("operation"), F.when(F.col("ok"), F.col("_object")).alias("object_name"), "cost", "estimated_rows", "actual_rows", "starts", F.array_join("functions", ",").alias("functions"))


SIGNALS, METRICS_KEPT = 12, 8


def contexts(plan: DataFrame, steps: DataFrame, allowed: DataFrame, noted: DataFrame, measured: DataFrame) -> DataFrame:
    """One row a recognised plan: header, top 8 steps, the first 12 observations and 8 metrics; no literal, predicate or other object."""
    top = summary(steps, allowed).groupBy("key").agg(F.array_sort(F.collect_list(F.struct("rank", "step_id", "operation", "object_name", "cost", "estimated_rows", "actual_rows", "starts", "functions"))).alias("priority_steps"))
    signals = noted.where(F.col("n") <= SIGNALS).groupBy("key").agg(F.array_sort(F.collect_list(F.struct("n", "code", "level", "step_id"))).alias("signals"))
    order = F.create_map(*[F.lit(x) for i, m in enumerate(METRICS.values()) for x in (m, i)])
    kept = measured.groupBy("key").agg(F.slice(F.array_sort(F.collect_list(F.struct(order[F.col("metric")].alias("at"), "metric", "value"))), 1, METRICS_KEPT).alias("runtime_metrics"))  # eleven at most
    out = plan.where("recognized").select("key", "source", F.col("root_cost").alias("plan_cost"), F.col("cost_matches").alias("cost_matches_input"), F.col("n_steps").alias("step_count"), (F.col("source") == "actual").alias("has_runtime_stats"))
    for part in (top, signals, kept):
        out = out.join(part, "key", "left")
    return out


# What a step is called on screen, tested in this order.
FRIENDLY = (
    ("TABLE ACCESS FULL", "whole_table_read"), ("INDEX", "index_read"), ("SORT ORDER BY", "sort"), ("HASH UNIQUE", "deduplicate"), ("SORT UNIQUE", "deduplicate"), ("GROUP BY", "aggregate"),
    ("HASH JOIN", "join"), ("MERGE JOIN", "join"), ("NESTED LOOPS", "join"), ("FILTER", "filter"), ("VIEW", "intermediate_result"),
)


def friendly(operation: Column, options: Column) -> Column:
    text, out = label(operation, options), F.lit("step")
    for word, name in reversed(FRIENDLY):
        out = F.when(text.contains(word), name).otherwise(out)
    return out
