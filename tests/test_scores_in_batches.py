"""W/D/L and score grids of whole batches: against sums over scores by hand, with what is unknown, and with no row-wise arrays in the plan."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from pitspark.functions import probs as P


def pmf(rate, k):
    return math.exp(-rate) * rate**k / math.factorial(k)


def test_wdl_by_hand_and_unknown(spark):
    rows = [(1.2, 0.7, 0), (0.01, 5.0, -3), (2.0, 1.0, 12), (0.5, 0.5, -12), (None, 1.0, 0), (1.0, None, 0), (1.0, 1.0, None)] * 1500
    df = P.with_wdl(spark.createDataFrame(rows, "h double, a double, d int").coalesce(1), F.col("h"), F.col("a"), F.col("d"))
    assert "transform(" not in df._jdf.queryExecution().executedPlan().toString() and "Arrow" in df._jdf.queryExecution().executedPlan().toString()
    for h, a, d, *got in df.collect():
        if None in (h, a, d):
            assert got == [None] * 3
            continue
        cells = [(i - j + d, pmf(h, i) * pmf(a, j)) for i in range(9) for j in range(9)]
        total = sum(p for _, p in cells)
        want = [sum(p for x, p in cells if x > 0) / total, sum(p for x, p in cells if x == 0) / total, sum(p for x, p in cells if x < 0) / total]
        assert got == pytest.approx(want, abs=1e-12)


def test_masses_are_the_grids_sums(spark):
    df = spark.createDataFrame([(3.0, 2.0), (0.4, 1.1), (None, 1.0)] * 2000, "h double, a double").coalesce(1)
    tests = {"home": lambda i, j: i > j, "silent": lambda i, j: (i == 0) | (j == 0)}
    out = P.with_grid_masses(df, F.col("h"), F.col("a"), tests, rho=0.2, inflation=0.1)
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "transform(" not in plan and "aggregate(" not in plan
    out = P.with_score_grid(out, F.col("h"), F.col("a"), rho=0.2, inflation=0.1)
    for r in out.distinct().collect():
        if r.h is None:
            assert r.home is None and r.silent is None and r.grid is None
        else:
            assert len(r.grid) == 81 and r.home == pytest.approx(sum(c.p for c in r.grid if c.i > c.j), abs=1e-12)
            assert r.silent == pytest.approx(sum(c.p for c in r.grid if c.i == 0 or c.j == 0), abs=1e-12) and sum(c.p for c in r.grid) == pytest.approx(1)


def test_rows_with_the_same_rates_share_a_grid(monkeypatch):
    scores, seen = P._scores, []
    monkeypatch.setattr(P, "_scores", lambda h, a, *rest: seen.append(len(h)) or scores(h, a, *rest))
    h, a = np.tile([1.5, 0.3, math.nan], 3000), np.tile([1.5, 2.0, 1.0], 3000)
    i, j = np.divmod(np.arange(121), 11)
    got = P._masses(h, a, np.stack([i > j, i == j], 1).astype(float), -0.1, 0.0, 10)
    assert sum(seen) == 3 and got.shape == (9000, 2) and np.isnan(got[2::3]).all()
    for at in (0, 1):
        grid = scores(h[at : at + 1], a[at : at + 1], -0.1, 0.0, 10)[0]
        assert got[at::3] == pytest.approx(np.tile([grid[i > j].sum(), grid[i == j].sum()], (3000, 1)), abs=1e-15)
