"""Every registered query of the engine against its SQL, on the smallest tables."""

import os

import duckdb
import pytest

from cohortspark.plans import choice
from cohortspark.plans import more_queries as more
from cohortspark.plans import queries as core

DATA = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables")


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for f in os.listdir(DATA):
        c.execute(f"CREATE VIEW {f.removesuffix('.parquet')} AS SELECT * FROM '{DATA}/{f}'")
    return c


def plain(v):
    if v is None or v != v:
        return "-"
    return f"{float(v):.9g}" if isinstance(v, (int, float)) and not isinstance(v, bool) else str(v)


QUERIES, SQL = core.queries() | more.queries() | choice.queries(), core.oracle_sql() | more.oracle_sql() | choice.oracle_sql()


@pytest.mark.parametrize("name", sorted(SQL))
def test_against_sql(spark, duck, name):
    df = QUERIES[name](spark, DATA)
    columns = sorted(df.columns)
    found = duck.execute(SQL[name])
    names = [x[0] for x in found.description]
    assert sorted(names) == columns
    at = [names.index(c) for c in columns]
    mine = sorted(tuple(plain(r[c]) for c in columns) for r in df.collect())
    theirs = sorted(tuple(plain(row[i]) for i in at) for row in found.fetchall())
    assert mine == theirs


@pytest.mark.parametrize("name", ["match_mcf", "match_two_stage"])
def test_whole_runs(spark, name):
    rows = core.queries()[name](spark, DATA).collect()
    assert rows and len({r["ref_id"] for r in rows}) == len(rows)


def test_entry(spark):
    import __spark_entry__ as e

    assert set(e.oracle_sql()) <= set(e.queries())
    assert e.entry(spark).count() > 0
