"""Promotion evidence, audits with planted leaks, and families that are saved and loaded."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from pitspark.operators import audit, families
from pitspark.operators import evaluation as E


def scored(spark, gains, n=40, worse_draws=False):
    """Folds of n matches, six rows each; the candidate's forecast is better by its fold's gain."""
    rng, rows = np.random.default_rng(1), []
    for f, gain in enumerate(gains):
        for m in range(n):
            y = "ADB"[rng.integers(3)]
            for _ in range(6):
                for model, g in (("new", gain), ("old", 0.0)):
                    p = {k: (1 - 0.4 - g) / 2 for k in "ADB"}
                    p[y] = 0.4 + g
                    if worse_draws and model == "new":
                        p = {"A": p["A"] * 0.4, "B": p["B"] * 0.4, "D": 1 - 0.4 * (p["A"] + p["B"])}
                    rows.append((f, f * 1000 + m, model, y, *(float(p[k]) for k in "ADB")))
    return spark.createDataFrame(rows, "fold int, match int, model string, outcome string, pa double, pd double, pb double")


def test_promotion_rules_by_hand(spark):
    judge = lambda df, **kw: E.promotion(df, "fold", "match", "new", "old", resamples=400, **kw).first()
    r = judge(scored(spark, [0.1, 0.1, 0.1, 0.1]))
    assert (r.verdict, r.matches, r.rows, r.folds, r.favouring) == ("promote", 160, 960, 4, 4) and r.difference_high < 0 and r.difference_without_best < 0
    r = judge(scored(spark, [0.2, -0.02, -0.02, -0.02]))
    assert r.verdict == "keep_reference" and r.improves and not r.steady and not r.not_one_fold
    r = judge(scored(spark, [-0.1, -0.1]))
    assert r.verdict == "keep_reference" and not (r.improves or r.favours)
    assert judge(scored(spark, [0.1], n=200)).verdict == "data_insufficient"
    assert judge(scored(spark, [0.1, 0.1], n=14)).verdict == "data_insufficient"
    r = judge(scored(spark, [0.1] * 4, worse_draws=True))
    assert r.verdict == "rejected" and not r.calibrated
    r = judge(scored(spark, [0.1] * 4), allowed=F.col("match") != 3)
    assert r.verdict == "rejected" and not r.allowed and r.calibrated
    df = scored(spark, [0.1] * 4)
    assert judge(df.where("model = 'old'")).verdict == "data_insufficient" and judge(df.limit(0)).verdict == "data_insufficient"


def test_a_planted_leak_is_found(spark):
    source = spark.createDataFrame([(i, i % 7, float(i % 5), None if i % 9 == 0 else i % 3) for i in range(100)], "id long, minute int, x double, goals_after int")
    clean = lambda df: df.select("id", (F.col("x") * 2).alias("double_x"), (F.col("minute") / 90).alias("share"))
    leaky = lambda df: clean(df).join(df.select("id", F.coalesce(F.col("goals_after") * 0.0 + F.col("goals_after"), F.lit(0.0)).alias("innocent_name")), "id")
    rowwise = lambda df: clean(df.where("goals_after is not null"))
    assert audit.leaked_targets(clean, source, ["goals_after"], ["id"]).count() == 0
    assert [(r.target, r.feature, r.rows) for r in audit.leaked_targets(leaky, source, ["goals_after"], ["id"]).collect()] == [("goals_after", "innocent_name", sum(1 for i in range(100) if i % 9 and i % 3))]
    assert {r.feature for r in audit.leaked_targets(rowwise, source, ["goals_after"], ["id"]).collect()} == {"double_x", "share"}
    with pytest.raises(ValueError):
        audit.leaked_targets(clean, source, ["nothing"], ["id"])


def test_suite(spark):
    rows = [(1, 0.5, 0.3, 0.2, 1, 45.0, None, None), (2, 0.5, 0.5, 0.2, 3, 95.0, 1.0, None), (3, None, 0.5, 0.5, None, None, 2.0, None)]
    df = spark.createDataFrame(rows, "id int, pa double, pd double, pb double, period int, minute double, xg double, tilt double")
    checks = [("simplex", audit.simplex(["pa", "pd", "pb"])), ("regulation", audit.regulation("period", "minute"))]
    leaks = audit.leaked_targets(lambda d: d.select("id", "xg"), df, ["xg"], ["id"])
    got = {r.check: (r.rows, r.violations, r.ok) for r in audit.suite(df, checks, {"chance": ["xg"], "ground": ["xg", "tilt"]}, leaks, ["final_score", "tilt"]).collect()}
    assert got == {"simplex": (3, 2, False), "regulation": (3, 1, False), "columns": (8, 1, False), "known:chance": (3, 1, True), "known:ground": (3, 4, False), "target_leak": (2, 1, False)}
    assert all(r.ok for r in audit.suite(df.limit(0), checks, {"chance": ["xg"]}).collect())


@pytest.fixture(scope="module")
def panel(spark):
    rng = np.random.default_rng(3)
    n = 1200
    x = {c: rng.normal(size=n) for c in ("minute", "diff", "xg", "xg_diff", "tilt", "box", "reds_diff", "market_a", "market_b")}
    wdl = np.where(x["diff"] + 0.5 * x["xg_diff"] + rng.normal(0, 0.5, n) > 0.4, 0, np.where(x["diff"] < -0.4, 2, 1))
    y = {"wdl": wdl, "next_goal": (x["xg"] + rng.normal(size=n) > 0).astype(int), "goal_soon": (x["tilt"] + rng.normal(size=n) > 0.5).astype(int), "sendoff_after": (rng.random(n) < 0.05).astype(int)}
    x["xg"] = [None if i % 11 == 0 else float(v) for i, v in enumerate(x["xg"])]
    names = [*x, *y]
    rows = [tuple(None if v is None else float(v) for v in r[: len(x)]) + tuple(int(v) for v in r[len(x) :]) for r in zip(*x.values(), *y.values())]
    return spark.createDataFrame(rows, ", ".join(f"{c} double" for c in x) + ", " + ", ".join(f"{c} int" for c in y)).select(*names).cache()


def test_families_save_load_and_rank(panel, tmp_path):
    assert len(families.FAMILIES) == 8 and all(n[0] == f for f, rungs in families.FAMILIES.items() for n in rungs)
    for name in ("e0", "e4", "q2", "y1"):
        estimator = families.FamilyEstimator(rung=name, predictionCol="forecast")
        estimator.save(str(tmp_path / f"est-{name}"))
        again = families.FamilyEstimator.load(str(tmp_path / f"est-{name}"))
        assert again.getRung() == name and again.getLabelCol() == families.rung_of(name).label
        model = again.fit(panel)
        model.write().overwrite().save(str(tmp_path / name))
        loaded = families.FamilyModel.load(str(tmp_path / name))
        assert loaded.extractParamMap() == {loaded.getParam(p.name): v for p, v in model.extractParamMap().items()}
        a, b = ([r.forecast for r in m.transform(panel).select("forecast").collect()] for m in (model, loaded))
        assert a == b and abs(sum(a[0]) - 1) < 1e-9
        assert model.getOrDefault("gated") == (name == "y1") and (model.inner is None) == (name in ("e0", "y1"))
    with pytest.raises(ValueError, match="z9"):
        families.FamilyEstimator(rung="z9")
    with pytest.raises(ValueError, match="xg"):
        families.FamilyEstimator(rung="q2").fit(panel).transform(panel.drop("xg"))
    got = {r.model: r for r in families.compared(panel, panel, ["e", "q", "y"]).collect()}
    assert got["e4"].log_loss < got["e1"].log_loss < got["e0"].log_loss == pytest.approx(got["e0"].base_loss)
    assert got["q2"].log_loss < got["q1"].log_loss and got["y2"].gated and got["y2"].log_loss == got["y2"].base_loss
    one = families.FamilyEstimator(rung="q1").fit(panel.withColumn("next_goal", F.lit(0)))
    assert one.inner is None and one.getOrDefault("base") == [1.0, 0.0]
    assert families.FamilyEstimator(rung="e1").fit(panel.limit(0)).getOrDefault("base") == [1 / 3] * 3


def test_timing_shares_from_counted_gaps(spark):
    truth = spark.createDataFrame([("m", "goal", 100 * i) for i in range(11)], "m string, c string, t long")
    said = spark.createDataFrame([("m", "goal", 100 * i + i) for i in range(10)], "m string, c string, s long")
    r = E.coverage_recovery(truth, said, ["m"], "c", "t", "s", 20).first()
    assert (r.timing_median, r.timing_p90, r.recall) == (4.5, 8, pytest.approx(10 / 11))
