"""The bridge without pairs of a hot key, against the pairs themselves; a replay that keeps no league in Python."""

import random
from collections import Counter

from pitspark.operators import joins as J
from pitspark.operators import players as L


def by_pairs(a, b):
    pairs = [(i, j, x, y) for i, k, x in a for j, l, y in b if k == l]
    na, nb = Counter(p[0] for p in pairs), Counter(p[1] for p in pairs)
    for i, k, _ in a:
        na[i] += all(l != k for _, l, _ in b)
    out = {}
    for i, k, x in a:
        mine = [p for p in pairs if p[0] == i]
        states = ["ambiguous" if na[i] > 1 or nb[j] > 1 else "score_differs" if x != y else "matched" for _, j, x, y in mine] or ["no_partner"]
        out[i] = (min((p[1] for p in mine), default=None), min(states))
    return out


def test_bridge_is_that_of_all_pairs(spark):
    draw = random.Random(3)
    a, b = ([(draw.randrange(400), draw.randrange(160), draw.randrange(2)) for _ in range(90)] for _ in range(2))
    make = lambda rows: spark.createDataFrame(rows, "id long, k long, s long")
    got = {r.a: (r.b, r.status) for r in J.bridge(make(a), make(b), ["k"], "id", "s").collect()}
    assert got == by_pairs(a, b) and {s for _, s in got.values()} == {"ambiguous", "matched", "no_partner", "score_differs"}


def test_bridge_makes_no_pairs_of_a_hot_key(spark):
    hot = spark.range(30_000).selectExpr("id", "id % 2 as k", "id % 3 as s")
    out = J.bridge(hot, hot, ["k"], "id", "s")  # 450 million pairs
    assert {r.status: r["count"] for r in out.groupBy("status").count().collect()} == {"ambiguous": 30_000}


def test_replay_streams_a_league(spark):
    rows = [("x" if i % 3 else "y", i % 5, i, i % 7, 7 + i % 4, i % 3, i % 2) for i in range(900)]
    out = L.replay_ratings(spark.createDataFrame(rows, "league string, t long, id long, a long, b long, ga long, gb long"))
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "MapInArrow" in plan and "FlatMapGroups" not in plan
    want = {}
    for league, _, _, a, b, ga, gb in sorted(rows, key=lambda r: (r[0], r[1], r[2])):
        ra, rb = want.get((league, a), L.FIRST), want.get((league, b), L.FIRST)
        n = abs(ga - gb)
        d = L.K * (1.0 if n <= 1 else 1.5) * ((ga > gb) + (ga == gb) / 2 - 1 / (1 + 10 ** (-(ra + L.HOME - rb) / L.SCALE)))
        want[league, a], want[league, b] = ra + d, rb - d
    assert {(r.league, r.team): r.rating for r in out.collect()} == {k: round(v, 4) for k, v in want.items()}
