import math

import numpy as np
from pyspark.sql import functions as F

from pitspark.llm import topk


def brute(rows, k=10):
    whole = [(i, [math.floor(1024 * x) for x in v]) for i, v in rows if i is not None and v and all(x is not None and math.isfinite(x) for x in v)]
    out = []
    for q in {i for i, _ in whole if i % 100 == 0}:
        asks = min(v for i, v in whole if i == q)
        scores = sorted((-max(-(2**63), min(2**63 - 1, sum(a * b for a, b in zip(asks, v)))), i) for i, v in whole if i != q)[:k]
        out += [(q, r + 1, i, -s) for r, (s, i) in enumerate(scores)]
    return sorted(out)


def run(spark, rows, **kw):
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>").withColumn("block", F.lit(1)).withColumn("v", F.lit(2))
    return sorted(tuple(r) for r in topk.top_k(df, df.where("vec_id % 100 = 0"), **kw).collect())


def test_matches_brute_force_in_blocks(spark):
    rng = np.random.default_rng(0)
    rows = [(i, [float(x) for x in np.float32(rng.normal(0, 0.2, 16))]) for i in range(900)]
    rows += [(1000 + i, rows[3][1]) for i in range(30)]  # ties
    assert run(spark, rows, block_rows=250, chunk_queries=3) == brute(rows)


def test_large_components_are_exact(spark):
    rows = [(0, [2.0**41, 1.0]), (1, [1.0, 2.0**30]), (2, [2.0**41, 1.0]), (3, [-(2.0**60), 0.5]), (4, [3e38, -1.0]), (100, [0.25, -0.75]), (5, [0.1, 0.2])]
    assert run(spark, rows) == brute(rows)
    assert (100, 3, 2, 2**59 - 768 * 1024) in run(spark, rows)


def test_repeated_rows_and_ids(spark):
    rows = [(0, [1.0, 0.0])] + [(1, [0.5, 0.5])] * 25 + [(2, [0.25, 1.0]), (2, [0.75, 1.0])] + [(100, [0.0, 1.0])] * 3 + [(200, [-1.0, 0.5]), (200, [1.0, 0.5])]
    assert run(spark, rows) == brute(rows)


def test_edge_cases(spark):
    bad = [(100, None), (200, [float("nan"), 1.0]), (201, [float("inf"), 1.0]), (202, [None, 1.0]), (203, []), (None, [1.0, 2.0])]
    rows = [(0, [0.5, -0.25]), (1, [0.1, 0.1]), (2, [0.1]), (3, [-1.0, 0.0]), (300, [0.0, 0.0])]
    assert run(spark, bad + rows) == brute(rows)
    assert run(spark, bad) == [] and run(spark, []) == []
    assert run(spark, [(0, [1.0])]) == []


def test_stops_on_proof_only():
    rng = np.random.default_rng(1)
    rows = rng.integers(-300, 300, (3000, 24))
    rows[:40] *= 3
    index = topk.Index(np.arange(3000), rows)
    for q in rows[rng.integers(0, 3000, 25)]:
        ids, scores, _ = index.search(-1, q, 7)
        want = sorted(zip(-(rows @ q), range(3000)))[:7]
        assert [(-s, i) for i, s in zip(ids, scores)] == want
