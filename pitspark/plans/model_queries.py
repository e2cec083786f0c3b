"""Queries of fitted models; their coefficients are tested apart, so they have no oracle."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..operators import audit, families, fits
from ..operators import evaluation as E
from ..operators import models as M
from ..operators.joins import written
from ..sources.tables import table
from .function_queries import FORECAST_SQL, forecasts
from .registry import Registry

query = Registry()


def panel(spark, sf_dir):
    """An in-play panel from lines of orders: minute, difference, chances, tilt, goals, and whether one follows."""
    li = table(spark, sf_dir, "lineitem")
    return li.select(
        "l_orderkey", "l_linenumber", (F.col("l_orderkey") % 90).cast("double").alias("minute"), (F.col("l_quantity") / 10 - 2.5).alias("diff"), (F.col("l_extendedprice") / 50_000).alias("xg"),
        F.col("l_discount").alias("tilt"), F.floor(F.col("l_quantity") / 18).cast("double").alias("goals"), (F.col("l_quantity") + F.col("l_tax") * 200 > 30).cast("double").alias("follows"))


def _split(df):
    held = F.col("l_orderkey") % 5 == 0
    return df.where(~held), df.where(held)


@query("mod9_logistic")
def mod9(spark, sf_dir):
    train, test = _split(panel(spark, sf_dir))
    return M.logistic(train, ["minute", "diff", "xg"], "follows")(test).select("l_orderkey", "l_linenumber", F.round(F.col("p")[1], 4).alias("p_follows"))


@query("mod10_poisson_rates")
def mod10(spark, sf_dir):
    train, test = _split(panel(spark, sf_dir))
    return M.poisson(train, ["minute", "xg"], "goals")(test).select("l_orderkey", "l_linenumber", F.round("rate", 4).alias("rate"))


@query("mod13_isotonic_calibration")
def mod13(spark, sf_dir):
    train, test = _split(panel(spark, sf_dir))
    fitted = M.logistic(train, ["diff"], "follows")
    p = lambda df: fitted(df).withColumn("p1", F.col("p")[1])
    return M.isotonic(p(train), "p1", "follows")(p(test)).select("l_orderkey", "l_linenumber", F.round("calibrated", 4).alias("calibrated"))


@query("mod16_boosted_rates")
def mod16(spark, sf_dir):
    """Counts by boosted trees with a log link."""
    train, test = _split(panel(spark, sf_dir))
    return fits.boosted_rates(train, ["minute", "diff", "xg"], "goals", rounds=8).predict(test).select("l_orderkey", "l_linenumber", F.round("rate", 3).alias("rate"))


def fixtures(spark, sf_dir):
    """A match of each order: a rating difference, and goals that lean on it."""
    o = table(spark, sf_dir, "orders")
    key, delta = F.col("o_orderkey"), (F.col("o_custkey") % 61 - 30) * 15.0
    goals = lambda sign, n: F.floor(F.pmod(F.xxhash64(key, F.lit(n)), F.lit(1000)) / 1000.0 * (2.9 + sign * delta / 300))
    return o.select(key.alias("match"), delta.alias("delta"), goals(1, 1).alias("goals_a"), goals(-1, 2).alias("goals_b"))


@query("mod10_scoreline_fit")
def mod10_scoreline(spark, sf_dir):
    """Base rate, slope and low-score correction fitted on four fifths of the matches, forecasts of the others."""
    m = fixtures(spark, sf_dir)
    fit = fits.scoreline_fit(m.where("match % 5 > 0"), "delta", "goals_a", "goals_b")
    out = fit.predict(m.where("match % 5 = 0"), "delta")
    return out.select("match", *(F.round(c, 5).alias(c) for c in ("rate_a", "rate_b", "p_a", "p_draw", "p_b", "p_00", "p_under_25", "draw_low", "draw_high")))


def _choice(spark, losses, best):
    return spark.createDataFrame([(str(n), round(float(x), 6), n == best) for n, x in losses.items()], "candidate string, loss double, chosen boolean")


@query("mod12_cross_fit_ridge")
def mod12(spark, sf_dir):
    """The penalty of a weighted ridge of many columns, chosen by folds of whole orders from one pass."""
    rows = panel(spark, sf_dir).withColumns({"late": F.col("minute") * F.col("diff") / 90, "late_xg": F.col("minute") * F.col("xg") / 90, "w": 1 + F.col("tilt"), "left": F.col("goals") - 0.2 * F.col("diff")})
    fit = fits.cross_fit_ridge(rows, ["minute", "diff", "xg", "tilt", "late", "late_xg"], "left", "l_orderkey", weight="w")
    return _choice(spark, fit.losses, fit.penalty)


@query("mod9_chosen_penalty")
def mod9_chosen(spark, sf_dir):
    """Penalties of a logistic model by their loss on left-out orders."""
    choice = fits.chosen_logistic(panel(spark, sf_dir), ["minute", "diff", "xg"], "follows", "l_orderkey", penalties=(0.001, 0.1), k=2)
    return _choice(spark, choice.losses, choice.best)


@query("mod14_ensemble")
def mod14(spark, sf_dir):
    """Two models, their average and its recalibration, by out-of-fold loss."""
    heads = {"score": lambda df: M.logistic(df, ["minute", "diff"], "follows"), "chance": lambda df: M.logistic(df, ["xg", "tilt"], "follows")}
    choice = fits.ensemble(panel(spark, sf_dir), heads, "follows", "l_orderkey", k=2)
    return _choice(spark, choice.losses, choice.best)


@query("mod14_fold_temperatures", f"""
    WITH {FORECAST_SQL}, g AS (SELECT i, 0.5::DOUBLE + 0.05::DOUBLE * i AS t FROM range(51) r(i)),
    z AS (SELECT l_orderkey % 5 AS fold, ln(greatest(pa, 1e-9)) AS a, ln(greatest(pd, 1e-9)) AS d, ln(greatest(pb, 1e-9)) AS b, CASE outcome WHEN 'A' THEN ln(greatest(pa, 1e-9)) WHEN 'D' THEN ln(greatest(pd, 1e-9)) ELSE ln(greatest(pb, 1e-9)) END AS y FROM p),
    s AS (SELECT fold, i, t, sum(ln(exp(a / t) + exp(d / t) + exp(b / t)) - y / t) AS s, count(*) AS n FROM z, g GROUP BY ALL),
    o AS (SELECT *, round(sum(s) OVER (PARTITION BY i) - s, 9) AS others FROM s),
    c AS (SELECT *, row_number() OVER (PARTITION BY fold ORDER BY others, i) AS r FROM o)
    SELECT fold::INT AS fold, t AS temperature, s / n AS loss FROM c WHERE r = 1""")
def mod14_temperatures(spark, sf_dir):
    """For each fifth of the orders the temperature that the others choose, and its loss there: sums of a fold and temperature, from one pass."""
    f = forecasts(spark, sf_dir).withColumns({"fold": (F.col("l_orderkey") % 5).cast("int"), "y": F.when(F.col("outcome") == "A", 0).when(F.col("outcome") == "D", 1).otherwise(2)})
    return fits.fold_temperatures(f, F.array("pa", "pd", "pb"), "y", "fold")


@query("mod21_mod23_family_ladder")
def mod21(spark, sf_dir):
    """Families fitted on the same rows and compared on held-out ones: an ablation by column set."""
    train, test = _split(panel(spark, sf_dir))
    return M.ladder(train, test, "follows", ["base", "time_score", "chance", "full"])


def family_panel(spark, sf_dir):
    """The panel with both sides' chances, ground, cards and prices, and the four targets of the families."""
    li = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_suppkey", "l_partkey", "l_returnflag", "l_linestatus")
    p = panel(spark, sf_dir).join(li.withColumnsRenamed({"l_orderkey": "_o", "l_linenumber": "_l"}).dropDuplicates(["_o", "_l"]), (F.col("l_orderkey") == F.col("_o")) & (F.col("l_linenumber") == F.col("_l")))
    reds = (F.col("l_suppkey") % 3 - 1).cast("double")
    return p.select(
        "l_orderkey", "l_linenumber", "minute", "diff", F.when(F.col("l_partkey") % 10 > 0, F.col("xg")).alias("xg"), (F.col("xg") - 0.7).alias("xg_diff"), "tilt", (F.col("l_partkey") % 20 / 20).alias("box"), reds.alias("reds_diff"),
        (0.3 + F.col("l_partkey") % 4 * 0.1).alias("market_a"), (0.2 + F.col("l_suppkey") % 3 * 0.1).alias("market_b"), F.when(F.col("l_returnflag") == "A", 0).when(F.col("l_returnflag") == "N", 1).otherwise(2).alias("wdl"),
        F.col("follows").cast("int").alias("next_goal"), (F.col("goals") > 1).cast("int").alias("goal_soon"), ((F.col("l_partkey") + F.col("l_suppkey")) % 40 == 0).cast("int").alias("sendoff_after"))


@query("mod21_families")
def mod21_families(spark, sf_dir):
    """Every rung of three families (W/D/L, next goal and send-offs), fitted on four fifths of the orders and compared on the rest."""
    train, test = _split(family_panel(spark, sf_dir))
    out = families.compared(train, test, ["r", "q", "y"])
    return out.select("family", "model", "label", "n", F.round("log_loss", 4).alias("log_loss"), F.round("base_loss", 4).alias("base_loss"), "gated")


@query("mod22_promotion_evidence")
def mod22_evidence(spark, sf_dir):
    """A blend with the base rates against the raw forecast, by folds of return flag and status, orders as matches."""
    li = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", F.concat("l_shipdate").substr(1, 4).alias("fold")).dropDuplicates(["l_orderkey", "l_linenumber"])
    f = written(forecasts(spark, sf_dir).join(li, ["l_orderkey", "l_linenumber"]).select(F.col("l_orderkey").alias("match"), "fold", "outcome", "pa", "pd", "pb"))
    raw = f.select("fold", "match", "outcome", "pa", "pd", "pb", F.lit("raw").alias("model"))
    blend = f.select("fold", "match", "outcome", *((0.5 * F.col(c) + 0.5 / 3).alias(c) for c in ("pa", "pd", "pb")), F.lit("blend").alias("model"))
    out = E.promotion(raw.unionByName(blend), "fold", "match", "blend", "raw")
    return out.select("candidate", "reference", "verdict", "enough", "improves", "steady", "favours", "calibrated", "not_one_fold", "allowed", "matches", "rows", "folds", "favouring", *(F.round(c, 5).alias(c) for c in ("candidate_rps", "reference_rps", "difference_without_best", "candidate_ece", "reference_ece")))


@query("set9_audit_suite", f"""
    WITH {FORECAST_SQL}, au AS (SELECT pa, pd, pb, l_orderkey % 97 AS minute, CASE WHEN l_suppkey % 4 > 0 THEN pd END AS xg, outcome FROM p)
    SELECT 'simplex' AS "check", count(*) AS rows, count(*) FILTER (NOT coalesce(abs(pa + pd + pb - 1) <= 1e-6, false)) AS violations, count(*) FILTER (NOT coalesce(abs(pa + pd + pb - 1) <= 1e-6, false)) = 0 AS ok FROM au
    UNION ALL SELECT 'regulation', count(*), count(*) FILTER (minute > 90), count(*) FILTER (minute > 90) = 0 FROM au
    UNION ALL SELECT 'columns', 8, 1, false UNION ALL SELECT 'known:chances', count(*), count(*) - count(xg), true FROM au
    UNION ALL SELECT 'target_leak', count(*) FILTER (outcome = 'A'), 1, false FROM au""")
def set9_suite(spark, sf_dir):
    """A feature table audited: probabilities, clocks, forbidden columns, what is known, and features that depend on the outcome (one, planted)."""
    keys = ["l_orderkey", "l_linenumber"]
    f = forecasts(spark, sf_dir).select(*keys, "pa", "pd", "pb", (F.col("l_orderkey") % 97).alias("minute"), F.when(F.col("l_suppkey") % 4 > 0, F.col("pd")).alias("xg"), "outcome")
    # lines of one order and number get a number of their own, as keys must be unique
    own = f.withColumn("row", F.row_number().over(Window.partitionBy(*keys).orderBy("pa", "pd", "pb", "outcome")))
    make = lambda df: df.select(*keys, "row", (F.col("pa") - F.col("pb")).alias("tilt"), F.coalesce(F.col("outcome") == "A", F.lit(False)).alias("innocent"))
    leaks = audit.leaked_targets(make, own, ["outcome"], [*keys, "row"])
    checks = [("simplex", audit.simplex(["pa", "pd", "pb"])), ("regulation", audit.regulation(minute="minute"))]
    return audit.suite(written(f), checks, {"chances": ["xg"]}, leaks, ["outcome", "final_score"])
