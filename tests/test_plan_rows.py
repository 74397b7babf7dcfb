import csv
import re

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from sqlloom.operators.plan_rows import plan_rejects, plan_rows, plan_steps
from sqlloom.plans.grid import find_grid

COMMA = 'Id,Operation,Object_Name,Cost,Cardinality,Filter_Predicates\n'
PIPE = "Plan hash value: 1\n\n-----\n| Id | Operation | Name | Rows | Cost (%CPU) | Time |\n-----\n"


def run(spark, *texts):
    df = spark.createDataFrame([(i, t, "x") for i, t in enumerate(texts)], "plan_id long, plan_text string, reason string")
    return {(r.key, r.line_no): r.reason for r in plan_rejects(df).collect()}, plan_steps(df).orderBy("key", "line_no").collect()


def test_valid_and_failing_pipe_rows(spark):
    text = PIPE + "| 0 | SELECT STATEMENT | | 1,234 | 10 (3) | 00:00:01 |\n|* 1 | TABLE ACCESS FULL | T | 4.5M | - | |\n| 1a | X | T | 1 | 1 | |\n| 2 | X | T | 1 |\n| 3 | X | T|U | 1 | 1 | |\n| 4 | X | T | ~4 | 1 | |\n| 5 | X | T | 1 | 1 | 3 min |\n-----\nnothing | here | at | all"
    bad, steps = run(spark, text)
    assert bad == {(0, 8): "id_not_whole", (0, 9): "missing_columns", (0, 10): "too_many_columns", (0, 11): "bad_number:rows", (0, 12): "bad_time:time"}
    assert [(s.step_id, s.estimated_rows, s.cost) for s in steps] == [(0, 1234, 10), (1, 4500000, None)]


def test_quoting(spark):
    text = COMMA + '0,SELECT STATEMENT,,5,"1,000",\n1,"A ""B"" C",T,5,6,"x=1\n  AND y=2"\n2,"OPEN,T,5,6,\n3,"T"x,T,5,6,\n4,FINE,T,5,6,"z"\n5,SHORT,T\n6,LONG,T,1,2,p,q\n\n7,AFTER,T,1,2,\n'
    bad, steps = run(spark, text)
    assert bad == {(0, 5): "broken_quoting", (0, 6): "broken_quoting", (0, 8): "missing_columns", (0, 9): "too_many_columns"}
    assert [(s.step_id, s.line_no) for s in steps] == [(0, 2), (1, 3), (4, 7)]
    assert steps[1].filter_predicates == "x=1\n  AND y=2" and steps[1].operation == 'A "B" C'


def test_crlf_tabs_repeats_and_odd_texts(spark):
    tab = "ID\tOPERATION\tCOST\r\n0\tA\t1\r\n?\tB\t2\r\n"
    df = spark.createDataFrame([(1, tab), (1, tab), (2, None), (3, ""), (4, "  "), (5, "no plan"), (6, "Id,Operation"), (7, "x" * 200_000)], "plan_id long, plan_text string")
    assert [(r.key, r.line_no, r.reason) for r in plan_rejects(df).collect()] == [(1, 3, "id_not_whole")]
    assert [(r.key, r.step_id) for r in plan_steps(df).collect()] == [(1, 0)]
    assert plan_rows(df.limit(0)).count() == 0


def test_pipe_row_cut_off(spark):
    bad, _ = run(spark, PIPE + "| 0 | A | T | 1 | 1 | |\n| 1 | B | T | 1 | 1 | 00:00:0")
    assert bad == {(0, 7): "missing_columns"}


def brute(text):
    """Plain reading of one comma grid without continued lines."""
    grid, out = find_grid(text), set()
    for line_no, raw in grid.records if grid else []:
        cells, bad, i = [], False, 0
        while True:
            if raw[i : i + 1] == '"':
                m = re.match(r'"((?:[^"]|"")*)"', raw[i:])
                if not m:
                    bad = True
                    break
                i += m.end()
                cells.append(m.group(1).replace('""', '"'))
                if i < len(raw) and raw[i] != ",":
                    bad = True
                    break
            else:
                j = raw.find(",", i)
                j = len(raw) if j < 0 else j
                cells.append(raw[i:j])
                i = j
            if i >= len(raw):
                break
            i += 1
        number = r"(\d{1,3}(,\d{3})+|\d+)(\.\d+)?[KMGT]?"
        if bad or len(cells) != 3 or not re.fullmatch(r"\d+", cells[0].strip()) or not re.fullmatch(rf"|-|{number}(\s*\(\d+\))?", cells[2].strip()):
            out.add(line_no)
    return out


@settings(max_examples=15, deadline=None)
@given(st.lists(st.lists(st.sampled_from(['1', '22', '"3"', '"x', 'y"z', '"a""b"', '"a"b', '', '-', '1,5', '4K', 'A B', '"1,200"']), min_size=1, max_size=4), max_size=12))
def test_against_plain_reading(spark, rows):
    lines = [",".join(r) for r in rows]
    text = "Id,Operation,Cost\n" + "\n".join(x for x in lines if x.strip())
    # An unquoted cell with a mark inside is text; the plain reading agrees with that.
    df = spark.createDataFrame([(1, text)], "plan_id long, plan_text string")
    assert {r.line_no for r in plan_rejects(df).collect()} == brute(text)


def test_csv_module_agrees_on_valid_rows(spark):
    rows = [["0", 'say "hi"', "5"], ["1", "a,b", "1,000"], ["2", "", "-"]]
    import io

    f = io.StringIO()
    csv.writer(f, lineterminator="\n").writerows([["Id", "Operation", "Cost"], *rows])
    df = spark.createDataFrame([(1, f.getvalue())], "plan_id long, plan_text string")
    assert plan_rejects(df).count() == 0
    assert [(r.operation or "") for r in plan_steps(df).orderBy("seq").collect()] == [r[1] for r in rows]


if __name__ == "__main__":
    pytest.main([__file__])


def test_value_errors_come_from_the_reject_tables(spark, monkeypatch):
    """With the checks of the SQL statement off, bad ids and times are still rejected: the typed reader reports them."""
    text = "Id,Operation,Time\n0,A,00:00:01\nx,B,00:00:01\n2,C,abc\n3,D,00:99:00\n4,E,\n"
    pipe = "| Id | Operation | A-Time |\n| 0 | A | |\n|* 1 | B | 00:00:01.5 |\n|* y | C | |\n| 3 | D | soon |\n"
    df = spark.createDataFrame([(1, text), (2, pipe)], "plan_id long, plan_text string")
    want = {(1, 3): "id_not_whole", (1, 4): "bad_time:time", (1, 5): "bad_time:time", (2, 4): "id_not_whole", (2, 5): "bad_time:a_time"}
    assert {(r.key, r.line_no): r.reason for r in plan_rejects(df).collect()} == want
    from sqlloom.operators import plan_rows as module

    monkeypatch.setattr(module, "_checks", lambda layout, roles: "NULL")
    import pyarrow as pa

    batch = pa.RecordBatch.from_arrays([pa.array([1, 2]), pa.array([text, pipe])], ["key", "text"])
    got = [r for b in module._load(iter([batch])) for r in b.to_pylist()]
    assert {(r["key"], r["line_no"]): r["reason"] for r in got if r["reason"]} == want
    assert [r["id_text"] for r in got if r["key"] == 2 and r["reason"] is None] == ["0", "* 1"]
