"""Every registered query against its DuckDB oracle, on the smallest tables."""

import math

import duckdb
import pytest

from pitspark.plans import ORACLES, QUERIES

DATA = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{DATA}/{t}.parquet'")
    return con


def plain(v):
    if isinstance(v, float):
        return None if math.isnan(v) else round(v, 5)
    if isinstance(v, list | tuple):
        return tuple(map(plain, v))
    return v


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, duck, name):
    df = QUERIES[name](spark, DATA)
    columns = sorted(df.columns)
    rows = [tuple(map(plain, r)) for r in df.select(*columns).collect()]
    if name not in ORACLES:
        return
    rel = duck.sql(f"SELECT {', '.join(chr(34) + c + chr(34) for c in columns)} FROM ({ORACLES[name]})")
    want = [tuple(map(plain, r)) for r in rel.fetchall()]
    key = lambda r: str(tuple((round(x, 3) if isinstance(x, float) else x) for x in r))
    assert len(rows) == len(want)
    for a, b in zip(sorted(rows, key=key), sorted(want, key=key)):
        assert all(x == y or (isinstance(x, int | float) and isinstance(y, int | float) and abs(x - y) <= 1e-4 * max(1, abs(x))) for x, y in zip(a, b)), (a, b)


def test_flagship_plan_shuffles_once_and_stays_in_the_jvm(spark):
    plan = QUERIES["win_snapshot_panel"](spark, DATA)._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" not in plan and "NestedLoop" not in plan and "Python" not in plan and "Arrow" not in plan
    assert plan.count("Window [") >= 1
