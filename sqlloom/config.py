"""Settings and small fixed dimensions of the analysis."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession

# Analysis rules, the weight each feeds, and whether it blocks.
RULES = (
    ("R001", "cost", "block", "cost_over_threshold"),
    ("R002", "where", "block", "missing_where"),
    ("R003", "parallel_hint", "block", "parallel_hint"),
    ("R004", "leading_wildcard", "notice", "leading_wildcard_like"),
    ("R005", "function_on_condition", "notice", "function_on_condition"),
    ("R006", "or_condition", "notice", "or_condition"),
    ("R007", "watched_table", "notice", "important_table_notice"),
    ("R008", "forbidden_operation", "block", "forbidden_operation"),
)
RULE_WEIGHTS = {"missing_where": 35, "cost_over_threshold": 35, "parallel_hint": 30, "forbidden_operation": 35, "function_on_condition": 30, "leading_wildcard_like": 25, "important_table_notice": 20, "or_condition": 15}
STRUCTURE_WEIGHTS = {"cartesian_join": 6, "deep_subquery": 3, "select_star": 2, "distinct_or_union": 3, "not_in_subquery": 2}
RESTRICTION_VERDICTS = {"source_where": "pass", "join_on_constant": "review", "join_on_outer_constant": "review", "join_on_only": "review"}
COST_BANDS = ((0.25, 0.0), (0.5, 5.0), (0.75, 10.0), (1.0, 14.0), (None, 15.0))
#: Complexity flags for which no full rewrite is asked.
GATE_FLAGS = ("connect_by", "correlated_subquery", "rownum", "set_operation", "window_function")


@dataclass(frozen=True)
class Settings:
    cost_threshold: int = 100_000
    rule_cap: float = 70.0
    decay: tuple[float, ...] = (1.0, 0.5, 0.25)
    structure_cap: float = 15.0
    many_tables: int = 4
    many_tables_weight: float = 4.0
    block_floor: float = 80.0
    cartesian_floor: float = 60.0
    disabled: frozenset[str] = frozenset(("R008",))
    #: (exact name or glob with *, message code) in order; the first match counts.
    watched: tuple[tuple[str, str], ...] = (("PERMIT_HDR", "check_range"), ("LEVY_*", "check_conditions"))
    #: (exact name or glob, statement types or empty for all)
    forbidden: tuple[tuple[str, tuple[str, ...]], ...] = ()
    keep_short_literals: int = 4
    max_extracted_chars: int = 300_000
    max_file_bytes: int = 10 << 20
    max_output_tokens: int = 3072


def glob_to_regex(glob: str) -> str:
    """Anchored regular expression of a table glob, for upper-case names."""
    import re

    return "^" + ".*".join(re.escape(p) for p in glob.upper().split("*")) + "$"


# The pattern catalog, in order: id, class, source of exact matches, their signals, family signals, evidence.
_A, _V, _I, _O = "ADVICE_ONLY", "VERIFIED_REWRITE", "INFORMATIONAL", "OUT_OF_SCOPE"
PATTERNS = (
    ("SUBSTR_EQ_TO_LIKE", _V, "rewrite", ("substr_eq_to_like",), ("R005",), ("ORACLE11G_TRANSFORMED_COLUMN",)),
    ("TRUNC_EQ_TO_RANGE", _A, "none", (), ("R005",), ()),
    ("NVL_EQ_TO_OR_IS_NULL", _A, "none", (), ("R005",), ()),
    ("OR_SAME_COLUMN_TO_IN", _V, "rewrite", ("or_eq_to_in",), ("R006",), ("ORACLE11G_IN_LIST_LIMIT",)),
    ("PREDICATE_FUNCTION_GENERIC", _A, "none", (), ("R005",), ()),
    ("UPPER_CASE_FOLD_REMOVAL", _A, "none", (), ("R005",), ()),
    ("IMPLICIT_TYPE_CONVERSION_MIXED_QUOTING", _A, "none", (), (), ()),
    ("NOT_IN_SUBQUERY_TO_NOT_EXISTS", _A, "flag", ("not_in_subquery",), (), ()),
    ("IN_SUBQUERY_TO_EXISTS", _A, "none", (), (), ()),
    ("OR_CROSS_COLUMN_TO_UNION_ALL", _A, "flag", ("cross_column_or",), ("R006",), ()),
    ("LEFT_JOIN_TO_INNER_JOIN", _A, "none", (), ("outer_join",), ()),
    ("CORRELATED_SUBQUERY_TO_JOIN_OR_WINDOW", _A, "flag", ("correlated_subquery",), (), ()),
    ("LATEST_ROW_CORRELATED_MAX", _A, "flag", ("repeated_correlated_max_subquery",), (), ("ORACLE11G_SUBQUERY_UNNESTING",)),
    ("REPEATED_SCALAR_AGGREGATE", _A, "flag", ("repeated_scalar_aggregate",), (), ()),
    ("COMPOSITE_KEY_EXPRESSION_JOIN", _A, "flag", ("column_expression_join",), (), ("ORACLE11G_TRANSFORMED_COLUMN",)),
    ("REPEATED_SOURCE_UNION_BRANCH", _A, "flag", ("repeated_source_set_operation",), (), ("ORACLE11G_VISIT_DATA_FEWER_TIMES",)),
    ("DISTINCT_REMOVAL", _A, "flag", ("distinct",), (), ()),
    ("GROUP_BY_STRUCTURAL_REWRITE", _A, "none", (), ("group_by_aggregate",), ()),
    ("STRING_CONCAT_PREDICATE_SPLIT", _A, "flag", ("string_concat_predicate",), (), ("ORACLE11G_TRANSFORMED_COLUMN",)),
    ("LEADING_WILDCARD_LIKE", _A, "rule", ("R004",), (), ("ORACLE11G_LEADING_WILDCARD_RANGE_LIMIT",)),
    ("CARTESIAN_JOIN_MISSING_CONDITION", _A, "flag", ("cartesian_join",), (), ()),
    ("SELECT_STAR", _I, "flag", ("select_star",), (), ()),
    ("IMPORTANT_TABLE_USAGE", _I, "rule", ("R007",), (), ()),
    ("STRUCTURAL_COMPLEXITY_MANY_TABLES", _I, "structure", ("many_tables",), (), ()),
    ("LARGE_RESULT_SET_NO_LIMIT", _I, "none", (), (), ()),
    *((p, _O, "none", (), (), ()) for p in ("INDEX_ADVISORY", "EXECUTION_PLAN_CLAIM", "FULL_TABLE_SCAN_CLAIM", "CARDINALITY_SELECTIVITY_DISTRIBUTION", "ACTUAL_RUNTIME_IMPROVEMENT_CLAIM", "POST_REWRITE_ORACLE_COST_CLAIM", "PARTITION_RECOMMENDATION", "PHYSICAL_STORAGE_AND_HOST_TUNING")),
)


#: What a context says about a pattern: our own wording.
GUIDANCE = {
    "SUBSTR_EQ_TO_LIKE": "A prefix or inner part compared by SUBSTR can be compared by LIKE with the same result.",
    "OR_SAME_COLUMN_TO_IN": "Equality tests of one column joined by OR can be one IN list with the same result.",
    "NOT_IN_SUBQUERY_TO_NOT_EXISTS": "NOT IN over a subquery gives nothing where the subquery yields a null; NOT EXISTS differs there.",
    "OR_CROSS_COLUMN_TO_UNION_ALL": "An OR over several columns may be split, if rows that meet both sides are kept once.",
    "CORRELATED_SUBQUERY_TO_JOIN_OR_WINDOW": "A subquery run for each outer row may be one join or window, if it yields at most one row.",
    "LATEST_ROW_CORRELATED_MAX": "Several subqueries for the latest row may be gathered in one, if ties are treated alike.",
    "REPEATED_SCALAR_AGGREGATE": "Several aggregates over one source may be gathered in one pass with conditional aggregates.",
    "COMPOSITE_KEY_EXPRESSION_JOIN": "A join on an expression hides the columns beneath; joining on bare columns needs equal types.",
    "REPEATED_SOURCE_UNION_BRANCH": "Branches over one source may read it once, if the conditions of the branches do not overlap.",
    "DISTINCT_REMOVAL": "DISTINCT can go only where the joined keys prove that no row repeats.",
    "STRING_CONCAT_PREDICATE_SPLIT": "A condition on concatenated columns may be split, if the parts have fixed lengths.",
    "LEADING_WILDCARD_LIKE": "A pattern that begins with a wildcard can't narrow a search by its beginning.",
    "CARTESIAN_JOIN_MISSING_CONDITION": "Tables without a join condition multiply; a condition in WHERE should be checked.",
    "SELECT_STAR": "Naming the columns needed reads fewer of them.",
    "IMPORTANT_TABLE_USAGE": "A watched table is used; its owner's range conditions should be checked.",
    "STRUCTURAL_COMPLEXITY_MANY_TABLES": "Many tables are joined; each join condition should be checked.",
}


def patterns_frame(spark: SparkSession, patterns: tuple[tuple, ...] = PATTERNS) -> DataFrame:
    """One row for each pattern and signal: pos, pattern_id, classification, how (exact or family), source, signal."""
    rows = []
    for pos, (pid, cls, source, exact, family, _) in enumerate(patterns):
        rows += [(pos, pid, cls, "exact", s) for s in exact] + [(pos, pid, cls, "family", s) for s in family]
    return spark.createDataFrame(rows, "pos int, pattern_id string, classification string, how string, signal string")


def evidence_frame(spark: SparkSession) -> DataFrame:
    rows = [(pos, p[0], p[1], e) for pos, p in enumerate(PATTERNS) for e in p[5]]
    return spark.createDataFrame(rows, "pos int, pattern_id string, classification string, evidence_id string")


class CatalogError(ValueError):
    """A catalog file that can't be used."""


_CLASSES = (_V, _A, _I, _O)
_SOURCES = ("rewrite", "flag", "rule", "structure", "none")


def load_catalog(path: str) -> tuple[tuple, ...]:
    """Patterns from a JSON file in place of ``PATTERNS``: ``{"version": 1, "patterns": [{"id", "classification", "source", "exact", "family", "evidence"}, ...]}``.

    Another version, a missing or doubled id, an unknown class or source, or lists that aren't of
    texts are errors: a catalog is never used in part.
    """
    import json

    try:
        with open(path, encoding="utf-8") as f:
            data = json.load(f)
    except (OSError, ValueError) as e:
        raise CatalogError(f"{path}: {e}") from None
    if not isinstance(data, dict) or data.get("version") != 1 or not isinstance(data.get("patterns"), list):
        raise CatalogError(f"{path}: no catalog of version 1")
    out, seen = [], set()
    for p in data["patterns"]:
        lists = [p.get(k, []) if isinstance(p, dict) else None for k in ("exact", "family", "evidence")]
        if not isinstance(p, dict) or not isinstance(p.get("id"), str) or p["id"] in seen or p.get("classification") not in _CLASSES or p.get("source", "none") not in _SOURCES or any(not isinstance(x, list) or any(not isinstance(y, str) for y in x) for x in lists):
            raise CatalogError(f"{path}: bad pattern {p!r:.80}")
        seen.add(p["id"])
        out.append((p["id"], p["classification"], p.get("source", "none"), *map(tuple, lists)))
    return tuple(out)


def load_settings(path: str) -> Settings:
    """Settings from a JSON file; unknown names and values of another type are errors."""
    import dataclasses
    import json

    try:
        with open(path, encoding="utf-8") as f:
            data = json.load(f)
    except (OSError, ValueError) as e:
        raise CatalogError(f"{path}: {e}") from None
    if not isinstance(data, dict) or data.pop("version", None) != 1:
        raise CatalogError(f"{path}: no settings of version 1")
    known = {f.name: f.default for f in dataclasses.fields(Settings)}
    values = {}
    for name, value in data.items():
        if name not in known:
            raise CatalogError(f"{path}: unknown setting {name}")
        want = known[name]
        value = frozenset(value) if isinstance(want, frozenset) and isinstance(value, list) else tuple(tuple(v) if isinstance(v, list) else v for v in value) if isinstance(want, tuple) and isinstance(value, list) else float(value) if isinstance(want, float) and type(value) is int else value
        if type(value) is not type(want):
            raise CatalogError(f"{path}: {name} is no {type(want).__name__}")
        values[name] = value
    return Settings(**values)
