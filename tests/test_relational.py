"""The engine's queries against DuckDB on the smallest tables."""

import datetime
import os
from collections import Counter

import duckdb
import pytest

import __spark_entry__ as entry
from strataflow.plans.registry import QUERIES, SQL

FOLDER = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(FOLDER), reason="no test tables")


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    con.sql("SET timezone = 'UTC'")
    for name in os.listdir(FOLDER):
        con.sql(f"CREATE VIEW {name.split('.')[0]} AS SELECT * FROM '{FOLDER}/{name}'")
    return con


def norm(v):
    if isinstance(v, float):
        return None if v != v else f"{v:.6g}"
    if isinstance(v, datetime.datetime):
        return v.replace(tzinfo=None).isoformat()
    return None if v is None else str(v)


@pytest.mark.parametrize("name", sorted(SQL))
def test_query_equals_sql(spark, duck, name):
    df = QUERIES[name](spark, FOLDER)
    columns = sorted(df.columns)
    ours = Counter(tuple(norm(r[c]) for c in columns) for r in df.collect())
    result = duck.sql(SQL[name])
    order = result.columns
    assert sorted(order) == columns
    theirs = Counter(tuple(norm(r[order.index(c)]) for c in columns) for r in result.fetchall())
    assert ours == theirs


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(SQL)))
def test_query_without_sql_runs(spark, name):
    assert QUERIES[name](spark, FOLDER).count() >= 0


def test_entry(spark):
    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_search_with_alternatives(spark):
    from strataflow.operators import search as S

    texts = {"a": "Seal the drains and the membrane", "b": "Gaskets only", "c": "drain pan", "d": "membrane, final payment, drain", "e": "final the payment", "f": None, "g": ""}
    table = spark.createDataFrame([(k, "s", t) for k, t in texts.items()], "paragraph_id string, section string, text string")
    found = lambda q: {r["paragraph_id"] for r in S.matching(table, q).collect()}
    assert found("drain membrane") == found("Drains MEMBRANE") == {"a", "d"} and found("gasket or drain membrane") == {"a", "b", "d"} and found("drain -membrane") == {"c"}
    assert found('"final payments" or gaskets') == {"b", "d"} and found("-drain") == found("or") == found("") == set()
    assert [r["paragraph_id"] for r in S.cover_ranked(table, "drain membrane or gasket").collect()] == ["b", "a", "d"]
    assert S.cover_ranked(table, "").count() == 0 and [r["n_hits"] for r in S.counted(table, "drain or gasket").collect()] == [1, 1, 1, 1]
