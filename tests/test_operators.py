"""What SQL can't check: metamorphic, brute-force and replay tests."""

import math
import random
import time

import numpy as np
import pytest
from pyspark.sql import functions as F

from pitspark.operators import aggregates as A
from pitspark.operators import joins as J
from pitspark.operators import pit
from pitspark.operators import players as L
from pitspark.operators import projections as R
from pitspark.operators import selection as S
from pitspark.sources import readers


def events(spark, rows):
    return spark.createDataFrame(rows, "match long, t long, kind string, x double")


def test_later_events_leave_earlier_states_alone(spark):
    rows = [(1, 10, "goal", 0.2), (1, 20, "pass", None), (1, 30, "goal", 0.4)]
    snaps = spark.createDataFrame([(1, t, "clock") for t in (5, 10, 25, 30)], "match long, t long, reason string")
    state = ["t", "n_goal", "x_sum", "x_seen", "n_last_10", "since_goal"]
    get = lambda r: {x.t: x for x in pit.state_at(events(spark, r), snaps, ["goal"], [10], "goal", [10]).select(state).collect()}
    a, b = get(rows), get(rows + [(1, 26, "goal", 0.9), (1, 31, "goal", 0.9)])
    assert all(a[t] == b[t] for t in (5, 10, 25)) and a[30] != b[30]
    assert a[10].n_goal == 1 and a[10].since_goal == 0 and a[5].since_goal is None and a[5].x_seen == 0


def test_asof_equality_tolerance_and_buckets(spark):
    left = spark.createDataFrame([("a", 10), ("a", 11), ("a", 500), ("b", 1), (None, 3)], "k string, t long")
    right = spark.createDataFrame([("a", 10, 1.0), ("a", 10, 2.0), ("a", 9, 0.5), ("b", 2, 3.0)], "k string, t long, v double")
    for bucket in (None, 7):
        get = lambda **kw: sorted((r.k or "", r.t, r.asof_v) for r in pit.asof_join(left, right, "k", "t", "t", ["v"], bucket=bucket, **kw).collect())  # noqa: B023, E731
        assert get() == [("", 3, None), ("a", 10, 2.0), ("a", 11, 2.0), ("a", 500, 2.0), ("b", 1, None)]
        assert get(strict=True)[1] == ("a", 10, 0.5) and get(tolerance=5)[3] == ("a", 500, None)


def test_anchor_clusters_follow_the_anchor(spark):
    df = spark.createDataFrame([("m", 10, 1), ("m", 11, 2), ("m", 12, 3), ("m", 13, 4), ("m", 40, 5)], "match string, minute int, idx long")
    got = {r.idx: r.cluster for r in S.anchor_clusters(df, ["match"], "minute", "idx", 1).collect()}
    assert got == {1: 1, 2: 1, 3: 2, 4: 2, 5: 3}


def test_components_match_union_find(spark):
    rng = np.random.default_rng(0)
    pairs = [(int(a), int(b)) for a, b in rng.integers(0, 200, (150, 2))] + [(i, i + 1) for i in range(300, 400)]
    parent = {}

    def find(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    for a, b in pairs:
        x, y = sorted((find(a), find(b)))
        parent[y] = x
    got = {r.node: r.component for r in J.components(spark.createDataFrame(pairs, "a long, b long")).collect()}
    assert got == {n: find(n) for n in parent}


def test_calibration_line_matches_numpy(spark):
    rng = np.random.default_rng(1)
    p = rng.uniform(0.05, 0.95, 3000)
    y = rng.random(3000) < 1 / (1 + np.exp(-(0.3 + 0.7 * np.log(p / (1 - p)))))
    df = spark.createDataFrame([(float(a), bool(b)) for a, b in zip(p, y)], "p double, y boolean")
    a, b = A.calibration_line(df, "p", F.col("y"))
    x, w = np.log(p / (1 - p)), np.array([0.0, 1.0])
    for _ in range(30):
        m = 1 / (1 + np.exp(-(w[0] + w[1] * x)))
        g, h = np.array([(y - m).sum(), ((y - m) * x).sum()]), m * (1 - m)
        w = w + np.linalg.solve([[h.sum(), (h * x).sum()], [(h * x).sum(), (h * x * x).sum()]], g)
    assert np.allclose([a, b], w, atol=1e-6)


def test_bootstrap_interval_has_the_right_width(spark):
    rng = np.random.default_rng(2)
    values = rng.normal(5, 2, 400)
    df = spark.createDataFrame([(i, float(v)) for i, v in enumerate(values)], "c long, v double")
    r = A.cluster_bootstrap(df, "c", "v", resamples=400).first()
    half = 1.96 * values.std() / 20
    assert abs(r.mean - values.mean()) < 1e-9 and abs((r.high - r.low) / (2 * half) - 1) < 0.25 and r.low < r.mean < r.high


def test_replay_and_period_ratings(spark):
    matches = [("l", 1, 1, 1, 2, 3, 0), ("l", 2, 2, 2, 1, 1, 1), ("l", 3, 3, 1, 2, 0, 2)]
    df = spark.createDataFrame(matches, "league string, t long, id long, a long, b long, ga long, gb long")
    exact = {r.team: r.rating for r in L.replay_ratings(df).collect()}
    one = {r.team: r.rating for r in L.period_ratings(df.withColumn("period", F.col("t")), [1, 2, 3]).collect()}
    assert one == pytest.approx(exact, abs=2e-4) and abs(sum(exact.values()) - 3000) < 1e-3


def test_guards(spark):
    df = spark.createDataFrame([(1, "x"), (2, None)], "a int, b string")
    with pytest.raises(ValueError, match="c"):
        R.require_columns(df, ["a", "c"], "t")
    with pytest.raises(Exception, match="a locked row"):
        R.assert_unlocked(df, F.col("a") == 2).collect()
    with pytest.raises(ValueError):
        readers.resolve_headers(df, {"z": ["q"]})
    with pytest.raises(ValueError):
        readers.release_rows(df, df, "a", "b", ["b"])
    status = spark.createDataFrame([("[1]",), ("",), ("<HTML>",), ("{",), ("{}",), (None,)], "p string")
    assert [r[0] for r in status.select(readers.payload_status(F.col("p"))).collect()] == [None, "empty", "html", "bad_json", "not_a_list", "empty"]


def test_csv_with_bad_dates(spark, tmp_path):
    (tmp_path / "m.csv").write_text("id,when\n1,2024-01-02 03:04:05\n2,never\n")
    rows = readers.read_csv(spark, str(tmp_path / "m.csv"), "id int, when string", ["when"]).collect()
    assert rows[0].when is not None and rows[1].when is None


def test_beta_interval_matches_samples(spark):
    from pitspark.functions import probs as P

    df = spark.createDataFrame([(0.1,), (0.5,), (None,)], "p double")
    rows = [r[0] for r in df.select(P.beta_interval(F.col("p"))).collect()]
    rng = np.random.default_rng(0)
    for p, r in zip((0.1, 0.5), rows):
        want = np.quantile(rng.beta(1 + p * 150, 1 + (1 - p) * 150, 400_000), [0.025, 0.975])
        assert np.allclose([r.low, r.high], want, atol=2e-3)
    assert rows[2].low is None or np.isnan(rows[2].low)


def test_values_by_hand(spark):
    """Equal ratings, risk bands, a bet, in-play rates and a score grid, computed by hand."""
    from pitspark.functions import probs as P

    one = spark.range(1)
    lit = F.lit
    assert np.allclose(one.select(*P.ternary_probs(lit(0.0))).first(), [0.35, 0.30, 0.35])
    p = 1 / (1 + 10 ** (-200 / 400))
    assert np.allclose(one.select(*P.ternary_probs(lit(150.0), home=50.0)).first(), [p * p + 0.4 * p * (1 - p), 1.2 * p * (1 - p), (1 - p) ** 2 + 0.4 * p * (1 - p)])
    assert np.allclose(one.select(P.gaussian_draw(lit(0.0)), P.gaussian_draw(lit(240.0))).first(), [0.3, 0.3 * np.exp(-0.5)])
    third = lit(1 / 3)
    assert np.allclose(one.select(P.entropy(third, third, third), P.entropy(lit(1.0), lit(0.0), lit(0.0))).first(), [1, 0], atol=1e-9)
    bands = [(0.68, 0.55, "low"), (0.67, 0.5, "medium"), (0.7, 0.6, "medium"), (0.55, 0.75, "medium"), (0.54, 0.5, "high"), (0.9, 0.76, "high")]
    assert [one.select(P.risk_band(lit(t), lit(e))).first()[0] for t, e, _ in bands] == [b for *_, b in bands]
    bet = P.bet_risk(lit(0.3), lit(4.0))
    assert np.allclose(one.select(*bet.values()).first(), [0.2, 3.36, 3.36**0.5, 0.2 / 3.36**0.5])

    none = lit(None).cast("double")
    rates = lambda *a: one.select(*P.remaining_rates(*map(lit, a[:6]), *(none if x is None else lit(x) for x in a[6:]))).first()
    assert np.allclose(rates(1.8, 0.9, 45.0, 0, 0, 0, None, None), [0.9, 0.45])
    assert np.allclose(rates(1.8, 0.9, 45.0, -2, 1, 0, None, None), [0.9 * 1.28 * 0.7, 0.45 * 0.9 * 1.18])
    assert np.allclose(rates(1.8, 0.9, 45.0, 0, 0, 0, 1.9, 0.1), [0.9 * np.exp(0.35 * 1.0 / 1.8), 0.45 * np.exp(0.35 * -0.35 / 0.9)])
    assert np.allclose(rates(1.8, 0.9, 95.0, 0, 0, 0, None, None), [0.01, 0.01])

    h, a = ([np.exp(-r) * r**k / math.factorial(k) for k in range(9)] for r in (3.0, 2.0))
    grid = np.outer(h, a)
    grid[8] += (1 - sum(h)) * np.array(a)
    grid[:, 8] += (1 - sum(a)) * np.array(h)
    for i, j, t in ((0, 0, 1 - 6 * 0.2), (0, 1, 1 + 3 * 0.2), (1, 0, 1 + 2 * 0.2), (1, 1, 0.8)):
        grid[i, j] *= max(0.001, t)
    grid[np.diag_indices(9)] *= 1.1
    got = P.with_score_grid(one, lit(3.0), lit(2.0), rho=0.2, inflation=0.1).select("grid").first()[0]
    assert np.allclose([c.p for c in got], (grid / grid.sum()).ravel())


def test_every_decision_keeps_its_row(spark):
    facts = spark.createDataFrame([(1, 50, "late"), (2, 5, "a"), (2, 9, "b"), (2, 11, "c")], "k long, t long, v string")
    decisions = spark.createDataFrame([(1, 10), (2, 10), (3, 10)], "k long, d long")
    got = {r.k: r.v for r in pit.latest_before(facts, decisions, "k", "t", "d", ["v"]).collect()}
    assert got == {1: None, 2: "b", 3: None}


def test_cascade_keeps_a_row_for_each_name(spark):
    left = spark.createDataFrame([(1, "Ann"), (2, "BOB"), (3, "Cid"), (4, "dee")], "id long, name string")
    right = spark.createDataFrame([(10, "Ann"), (11, "Ann"), (12, "Bob"), (13, "Dee"), (14, "DEE")], "rid long, rname string")
    got = sorted((r.id, r.rid, r.how) for r in J.mapping_cascade(left, right, "id", "name", "rid", "rname").collect())
    assert got == [(1, None, "ambiguous"), (2, 12, "normalised"), (3, None, "missing"), (4, None, "ambiguous")]


def test_entities_match_brute_force(spark):
    rng = random.Random(0)
    name = lambda: "".join(rng.choice("abcde ") for _ in range(rng.randint(1, 14))).strip()
    known = sorted({n for n in (name() for _ in range(80)) if n})
    raw = [(i, "".join(c for c in rng.choice(known) if rng.random() > 0.1) + rng.choice(["", "!", "x"])) for i in range(120)] + [(500, None), (501, "?!")]

    def distance(a, b):
        row = list(range(len(b) + 1))
        for i, x in enumerate(a, 1):
            row, last = [i], row
            for j, y in enumerate(b, 1):
                row.append(min(last[j] + 1, row[-1] + 1, last[j - 1] + (x != y)))
        return row[-1]

    plain = lambda x: "".join(c for c in (x or "").lower() if c.isalnum() or c == " ").strip()
    for least in (0.6, 0.75):
        want = {}
        for i, r in raw:
            r = plain(r)
            best = max(((1 - distance(r, plain(k)) / max(len(r), len(plain(k))), k) for k in known if r), default=(0, None))
            want[i] = best[1] if best[0] >= least else None
        df = J.resolve_entities(spark.createDataFrame(raw, "id long, raw string"), spark.createDataFrame([(k,) for k in known], "name string"), "id", "raw", "name", least)
        assert {r.id: r.entity for r in df.collect()} == want


def test_a_long_match_takes_no_quadratic_time(spark):
    """One match of 200,000 events: running sums only."""
    e = spark.range(200_000).select(F.lit(1).cast("long").alias("match"), F.col("id").alias("t"), F.when(F.col("id") % 1000 == 999, "goal").otherwise("pass").alias("kind"), F.lit(0.1).alias("x"))
    began = time.time()
    rows = pit.state_at(e, pit.snapshot_schedule(e, ["goal"], 100), ["goal"], [600, 50_000], "goal", [600]).cache()
    assert rows.count() == 2000 + 200
    r = rows.where("t = 100000").first()
    assert (r.n_goal, r.n_last_600, r.n_last_50000, r.since_goal, r.next_goal, r.goal_in_600) == (100, 600, 50_000, 1, 999, 0)
    assert time.time() - began < 60
