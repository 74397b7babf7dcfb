"""Rows delivered once, written tables, deep brackets."""

import datetime as dt

import pytest

from sqlloom.sources import once as module
from sqlloom.sources.once import once, repeated, split
from sqlloom.sources.scratch import written
from sqlloom.sqlast.facts import facts


@pytest.mark.parametrize("bits", [1 << 16, module.FILTER_BITS])
def test_each_key_once(spark, bits):
    rows = [(i, f"text {i}") for i in range(20_000)] + [(5, "text 4"), (5, "text 5"), (7, None), (None, "b"), (None, "a")] + [(9, "text 9")] * 3000
    df = spark.createDataFrame(rows, "k long, t string").repartition(5)
    got = {r.k: r.t for r in once(df, "k", bits).collect()}
    want = {i: f"text {i}" for i in range(20_000)} | {5: "text 4", 7: None, None: "a"}
    assert got == want and once(df, "k", bits).count() == len(want)
    assert once(df.limit(0), "k").count() == 0


def test_few_rows_pass_the_filter(spark):
    df = spark.range(50_000).unionByName(spark.range(500))
    alone, maybe = split(df, "id", repeated(df, "id"))
    assert alone.count() + maybe.count() == 50_500 and 1000 <= maybe.count() < 1000 + 500 and alone.join(spark.range(500), "id").count() == 0


def test_written_tables_keep_types_and_parts(spark):
    df = spark.createDataFrame([(1, dt.datetime(2025, 1, 1), ["a"]), (2, None, None)], "p int, t timestamp, a array<string>")
    assert sorted(written(df, "p").select("p", "t", "a").collect()) == sorted(df.collect()) and written(df, "p").where("p = 2").count() == 1
    assert written(df.limit(0)).count() == 0


@pytest.mark.parametrize("depth", [160, 1500])
def test_deep_brackets_are_read(depth):
    condition, _ = facts("SELECT a FROM t WHERE " + "(" * depth + "p = 1 OR NVL(q, 0) = 2" + ")" * depth)
    value, _ = facts("SELECT a FROM t WHERE p = " + "(1 + " * depth + "1" + ")" * depth)
    assert condition["parse_status"] == value["parse_status"] == "ok" and condition["or_count"] == 1 and condition["function_hits"] == ["NVL(Q, 0)"]
    assert facts("SELECT a FROM t WHERE " + "(" * 10_000 + "1 = 1" + ")" * 10_000)[0]["parse_status"] == "failed"  # too deep, never a crash
