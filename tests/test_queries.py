import os
from collections import Counter

import duckdb
import pytest

import __spark_entry__ as entry
from tracelens.queries import QUERIES, SQL

SF = "/root/testdata/sf0.001"


def plain(v):
    if hasattr(v, "asDict"):
        return tuple(map(plain, v))
    return tuple(map(plain, v)) if isinstance(v, list | tuple) else repr(v)


@pytest.fixture(scope="session")
def duck():
    con = duckdb.connect()
    for name in os.listdir(SF):
        con.execute(f"CREATE VIEW {name.removesuffix('.parquet')} AS SELECT * FROM read_parquet('{SF}/{name}')")
    return con


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query_matches_its_sql(spark, duck, name):
    out = QUERIES[name](spark, SF)
    columns = sorted(out.columns)
    rows = Counter(tuple(plain(r[c]) for c in columns) for r in out.collect())
    if name in SQL:
        result = duck.execute(SQL[name])
        names = [d[0] for d in result.description]
        assert sorted(names) == columns
        assert rows == Counter(tuple(plain(r[names.index(c)]) for c in columns) for r in result.fetchall())


def test_entry(spark):
    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_ranking_limits_rows_before_the_shuffle(spark):
    from tracelens.operators import retrieve

    df = spark.range(100).selectExpr("id % 5 AS query_id", "id AS chunk_id", "id * 0.1 AS score")
    plan = retrieve.top_k(df, 3, "score")._jdf.queryExecution().executedPlan().toString()
    assert "WindowGroupLimit" in plan and "Python" not in plan


def test_followups_hold_whole_turns(spark):
    turns = {r.conv_id * 1000 + r.turn: r.text for r in spark.read.parquet(f"{SF}/conversations.parquet").where("role = 'user'").collect()}
    got = {r.query_id: r.query for r in QUERIES["rewrite_followups"](spark, SF).collect()}
    assert got == {i: f"and what about that: {turns[i]}" for i in got} and any(len(turns[i]) > 60 for i in got)
