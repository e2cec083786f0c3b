import numpy as np
import pytest

from pyspark.sql import functions as F

from pitspark.operators import models as M


@pytest.fixture(scope="module")
def rows(spark):
    rng = np.random.default_rng(0)
    x = rng.normal(size=(3000, 2))
    y = (rng.random(3000) < 1 / (1 + np.exp(-(0.5 + 1.5 * x[:, 0])))).astype(float)
    g = rng.poisson(np.exp(0.2 + 0.4 * x[:, 1]))
    return spark.createDataFrame([(float(a), float(b), float(c), float(d)) for (a, b), c, d in zip(x, y, g)], "a double, b double, y double, g double").cache()


def test_logistic_and_poisson_recover_the_rates(rows):
    p = M.logistic(rows, ["a", "b"], "y", penalty=0.0)(rows).toPandas()
    assert np.corrcoef(np.array(p["p"].tolist())[:, 1], 1 / (1 + np.exp(-(0.5 + 1.5 * p["a"]))))[0, 1] > 0.99
    r = M.poisson(rows, ["b"], "g")(rows).toPandas()
    assert np.abs(np.log(r["rate"]) - (0.2 + 0.4 * r["b"])).max() < 0.3


def test_isotonic_is_monotone(rows):
    q = M.logistic(rows, ["a"], "y")
    scored = q(rows).selectExpr("p[1] as q", "y")
    c = M.isotonic(scored, "q", "y")(scored).toPandas().sort_values("q")
    assert (np.diff(c["calibrated"]) >= -1e-12).all()


def test_missing_columns_fail_at_once(rows):
    with pytest.raises(ValueError, match="zzz"):
        M.logistic(rows, ["zzz"], "y")


def test_platt_recovers_a_distorted_probability(spark):
    rng = np.random.default_rng(1)
    p = rng.uniform(0.05, 0.95, 4000)
    y = rng.random(4000) < 1 / (1 + np.exp(-(0.5 + 0.6 * np.log(p / (1 - p)))))
    df = spark.createDataFrame([(float(a), float(b)) for a, b in zip(p, y)], "q double, y double")
    got = M.platt(df, "q", "y")(df).toPandas()
    assert np.abs(got["calibrated"] - 1 / (1 + np.exp(-(0.5 + 0.6 * np.log(p / (1 - p)))))).max() < 0.05


@pytest.fixture(scope="module")
def states(spark):
    """States whose goals to come are Poisson with a rate that falls with the minute."""
    rng = np.random.default_rng(2)
    rows = []
    for _ in range(3000):
        minute, lead = float(rng.integers(0, 90)), int(rng.integers(-1, 2))
        ra, rb = 1.8 * (90 - minute) / 90, 1.1 * (90 - minute) / 90
        a, b = rng.poisson(ra), rng.poisson(rb)
        soon = [float(rng.random() < 1 - np.exp(-r * 10 / max(90 - minute, 10))) for r in (ra, rb)]
        final = lead + a - b
        rows.append((minute, lead, int(a), int(b), 90 - minute, *soon, "A" if final > 0 else "D" if final == 0 else "B"))
    return spark.createDataFrame(rows, "minute double, lead int, left_a int, left_b int, left_minutes double, next_a double, next_b double, outcome string").cache()


@pytest.mark.parametrize("kind", ["intensity", "hazard", "one sided"])
def test_goals_to_come_give_calibrated_outcomes(states, kind):
    if kind == "intensity":
        predict = M.intensity_wdl(states, ["minute"], "left_a", "left_b", "lead", "outcome")
    else:
        train = states.withColumn("next_b", F.lit(0.0)) if kind == "one sided" else states
        predict = M.competing_risk_wdl(train, ["minute"], "next_a", "next_b", "left_minutes", "lead", "outcome")
    out = predict(states).toPandas()
    p = out[["p_a", "p_draw", "p_b"]].to_numpy()
    assert np.allclose(p.sum(1), 1) and (p >= 0).all()
    share = [np.mean(out["outcome"] == c) for c in "ADB"]
    assert np.abs(p.mean(0) - share).max() < 0.03
    late = out["minute"] > 85
    assert p[late & (out["lead"] == 1), 0].mean() > 0.8 and np.mean(-np.log(np.clip(p[np.arange(len(p)), ["ADB".index(o) for o in out["outcome"]]], 1e-9, 1))) < 0.9


def test_a_draw_calibrator_keeps_the_others_in_proportion(states):
    scored = states.withColumns({"p_a": F.lit(0.5) + F.col("minute") / 900, "p_draw": F.lit(0.2), "p_b": F.lit(0.3) - F.col("minute") / 900})
    out = M.draw_calibrated(scored, "outcome", head=M.isotonic)(scored).toPandas()
    assert np.allclose(out[["p_a", "p_draw", "p_b"]].sum(axis=1), 1) and np.allclose(out["p_a"] / out["p_b"], (0.5 + out["minute"] / 900) / (0.3 - out["minute"] / 900))
    assert abs(out["p_draw"].mean() - (out["outcome"] == "D").mean()) < 0.01


def test_a_gate_takes_no_correction_that_does_not_help(spark):
    rows = [(0.3 + 0.1 * (i % 8), 0.6, 0.2, 0.2, 0.1, 0.1, 0.8, "A") for i in range(100)]
    df = spark.createDataFrame(rows, "k double, a double, d double, b double, ca double, cd double, cb double, y string")
    r = M.selective_gate(df, "k", ["a", "d", "b"], ["ca", "cd", "cb"], "y").first()
    assert (r.alpha_low, r.alpha_full) == (0, 0) and r.loss == r.base_loss
    r = M.selective_gate(df, "k", ["ca", "cd", "cb"], ["a", "d", "b"], "y").first()
    assert (r.t_low, r.alpha_low, r.alpha_full) == (0.4, 0.5, 1.0) and r.loss < r.base_loss


def test_texts_are_told_apart_where_the_rule_speaks(spark):
    rng = np.random.default_rng(3)
    words = ["".join(rng.choice(list("aeiourstln"), 5)) for _ in range(300)]
    rows = []
    for i in range(400):
        t = list(rng.choice(words, 20))
        goal = i % 4 == 0
        rows.append((i, " ".join(t + (["scores", "brilliant", "net"] if goal else ["goal" if i % 4 == 1 else "kick", "midfield", "pass"]) + (["goal"] if goal else [])), int(goal)))
    df = spark.createDataFrame([*rows, (900, None, 0)], "id long, text string, y int")
    out = M.text_classifier(df, "text", "y", lambda t: F.coalesce(F.contains(t, F.lit("goal")), F.lit(False)).cast("double"))(df).toPandas().set_index("id")
    assert all(out.confidence[i] > 0.5 for i in range(0, 400, 4)) and all(out.confidence[i] == 0 for i in range(2, 400, 4)) and out.confidence[900] == 0
    assert np.mean([out.p[i] < 0.5 for i in range(1, 400, 4)]) > 0.95


def test_transfer_helps_where_domains_agree_and_is_declined_where_not(spark):
    rng = np.random.default_rng(4)

    def domain(n, slope, shift=0.0):
        x = rng.normal(size=(n, 2)) + [0, shift]
        y = rng.random(n) < 1 / (1 + np.exp(-slope * x[:, 0]))
        return spark.createDataFrame([(float(a), float(b), float(c)) for (a, b), c in zip(x, y)], "a double, b double, y double")

    main, test = domain(300, 2.0), domain(3000, 2.0)
    p = F.greatest(F.lit(1e-9), F.least(F.lit(1 - 1e-9), F.col("p")))
    loss = lambda predict: predict(test).agg(F.avg(-F.when(F.col("y") == 1, F.log(p)).otherwise(F.log(1 - p)))).first()[0]
    like, unlike = (M.transfer_ladder(main, domain(3000, k, 3.0), ["a", "b"], "y") for k in (2.0, -2.0))
    assert list(like) == ["main_only", "naive_pool", "shared_stable", "partial_pooling", "domain_weighted", "selective"]
    alone = loss(like["main_only"])
    assert loss(unlike["naive_pool"]) > alone + 0.3 and abs(loss(unlike["selective"]) - alone) < 0.02 and loss(unlike["partial_pooling"]) < alone + 0.1
    assert loss(like["naive_pool"]) < alone + 0.01 and loss(like["selective"]) < alone + 0.01 and loss(like["shared_stable"]) < alone + 0.02


def test_text_classifier_is_silent_on_one_class_and_on_few_texts(spark):
    rule = lambda t: F.lit(1.0)
    texts = [(i, f"some text of number {i}", i < 9) for i in range(60)]
    for rows in (texts, [(i, t, False) for i, t, _ in texts], [(i, t, True) for i, t, _ in texts], []):
        df = spark.createDataFrame(rows, "id long, text string, y boolean")
        out = M.text_classifier(df, "text", "y", rule)(df).collect()
        assert len(out) == len(rows) and all(r.p is None and r.confidence == 0 for r in out)
    more = spark.createDataFrame([(i, "a goal scored by him" if i % 2 else "a calm spell of passes", bool(i % 2)) for i in range(60)] + [(60, None, None)], "id long, text string, y boolean")
    out = {r.id: r.p for r in M.text_classifier(more, "text", "y", rule)(more).collect()}
    assert min(out[i] for i in range(1, 60, 2)) > 0.8 and max(out[i] for i in range(0, 60, 2)) < 0.2
