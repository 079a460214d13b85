"""Every query with SQL gives the rows that DuckDB gives, on the smallest tables."""

from __future__ import annotations

import math
import os

import duckdb
import pytest

from tessera.plans import further  # noqa: F401  adds to the queries
from tessera.plans.catalog import ORACLE_SQL, QUERIES

FOLDER = os.environ.get("TESSERA_TABLES", "/root/testdata/sf0.001")
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
pytestmark = pytest.mark.skipif(not os.path.isdir(FOLDER), reason="no tables")


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{FOLDER}/{t}.parquet'")
    return con


def plain(v):
    if v is None or (isinstance(v, float) and math.isnan(v)):
        return "null"
    return f"{float(v):.6f}" if isinstance(v, (int, float)) and not isinstance(v, bool) else str(v)


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_equals_sql(spark, duck, name):
    got = QUERIES[name](spark, FOLDER)
    names = sorted(got.columns)
    found = duck.execute(ORACLE_SQL[name])
    theirs = [d[0] for d in found.description]
    assert sorted(theirs) == names
    want = sorted(tuple(plain(r[theirs.index(n)]) for n in names) for r in found.fetchall())
    assert sorted(tuple(plain(r[n]) for n in names) for r in got.collect()) == want


def test_all_queries_have_sql():
    assert set(QUERIES) == set(ORACLE_SQL)


def test_filters_and_columns_reach_the_scan(spark):
    plan = QUERIES["index1_lookup"](spark, FOLDER)._jdf.queryExecution().toString()
    assert "EqualTo(c_mktsegment,BUILDING)" in plan or "EqualNullSafe(c_mktsegment,BUILDING)" in plan
    assert "c_name" not in plan.split("ReadSchema")[-1]
