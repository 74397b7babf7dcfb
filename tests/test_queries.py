"""Every core query with SQL against DuckDB on the smallest tables."""

import glob
import os

import duckdb
import pytest

from conftest import DATA
from sqlloom import queries as core

pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables here")


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for f in glob.glob(f"{DATA}/*.parquet"):
        c.execute(f"CREATE VIEW {os.path.basename(f)[:-8]} AS SELECT * FROM read_parquet('{f}')")
    return c


def rows(df):
    df = df[sorted(df.columns)]
    return list(df.columns), sorted(map(lambda r: tuple(map(str, r)), df.astype(object).where(df.notna(), None).values.tolist()))


@pytest.mark.parametrize("name", sorted(core.ORACLE))
def test_against_sql(spark, con, name):
    assert rows(core.QUERIES[name](spark, DATA).toPandas()) == rows(con.execute(core.ORACLE[name]).df())


@pytest.mark.parametrize("name", sorted(set(core.QUERIES) - set(core.ORACLE)))
def test_runs(spark, name):
    assert core.QUERIES[name](spark, DATA).count() >= 0
