"""Queries of rates, scores, calibration, bootstrap, completeness and drift."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import probs as P
from ..operators import aggregates as A
from ..operators import process as X
from ..sources.tables import CLOCKED_SQL, clocked, table
from .function_queries import FORECAST_SQL, forecasts
from .registry import Registry

query = Registry()


@query("agg1_rates", "SELECT o_orderpriority, count(*) AS n, count(*) FILTER (o_orderstatus = 'F')::BIGINT AS hits, avg((o_orderstatus = 'F')::INT) AS rate, count(*) / (SELECT count(*) FROM orders) AS share FROM orders GROUP BY o_orderpriority")
def agg1(spark, sf_dir):
    return A.rate_by(table(spark, sf_dir, "orders"), ["o_orderpriority"], F.col("o_orderstatus") == "F")


@query("agg1_distribution_agg2_binomial", """
    WITH g AS (SELECT o_custkey, count(*) FILTER (o_orderstatus = 'F') AS k FROM orders WHERE o_custkey IN (SELECT o_custkey FROM orders GROUP BY 1 HAVING count(*) >= 6) AND o_orderkey IN (SELECT o_orderkey FROM (SELECT o_orderkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS r FROM orders) WHERE r <= 6) GROUP BY 1),
    o AS (SELECT k, count(*) AS n FROM g GROUP BY k)
    SELECT b.k::BIGINT AS k, coalesce(o.n, 0)::BIGINT AS observed, factorial(6) / (factorial(b.k::INT) * factorial((6 - b.k)::INT)) * pow(0.33, b.k) * pow(0.67, 6 - b.k) AS expected FROM range(7) b(k) LEFT JOIN o ON o.k = b.k""")
def agg2(spark, sf_dir):
    """How many of a customer's first six orders are F, against the binomial distribution."""
    from ..operators.selection import first_by

    o = first_by(table(spark, sf_dir, "orders"), ["o_custkey"], F.col("o_orderkey"), n=6)
    g = o.groupBy("o_custkey").agg(F.count("*").alias("m"), F.count_if(F.col("o_orderstatus") == "F").alias("k")).where("m = 6")
    seen = g.groupBy("k").agg(F.count("*").alias("observed"))
    return A.binomial(spark, 0.33, 6).join(seen, "k", "left").select("k", F.coalesce("observed", F.lit(0)).alias("observed"), "expected")


@query("agg3_agg4_metrics", f"""
    WITH {FORECAST_SQL}, s AS (SELECT *, (pow(pa - (outcome = 'A')::INT, 2) + pow(pa + pd - (outcome IN ('A', 'D'))::INT, 2)) / 2 AS r, -ln(CASE outcome WHEN 'A' THEN pa WHEN 'D' THEN pd ELSE pb END) AS l FROM p)
    SELECT l_suppkey, count(*) AS n, avg(r) AS rps, avg(l) AS log_loss, avg(pow(pd - (outcome = 'D')::INT, 2)) AS draw_brier, avg(greatest(pa, pd, pb)) AS sharpness, avg(pd) AS mean_draw, avg((outcome = 'D')::INT) AS draw_rate FROM s GROUP BY l_suppkey""")
def agg4(spark, sf_dir):
    return A.forecast_metrics(forecasts(spark, sf_dir), ["l_suppkey"])


def _bins(rule: str) -> str:
    at = "ceil(pd * 10) - 1" if rule == "right" else "floor(pd * 10)"
    return f"WITH {FORECAST_SQL} SELECT least(9, greatest(0, {at}))::INT AS bin, count(*) AS n, avg(pd) AS pred, avg((outcome = 'D')::INT) AS actual, abs(avg(pd) - avg((outcome = 'D')::INT)) AS abs_error FROM p GROUP BY 1"


@query("agg5_reliability_right_closed", _bins("right"))
def agg5(spark, sf_dir):
    return A.reliability(forecasts(spark, sf_dir), "pd", F.col("outcome") == "D")


@query("agg5_reliability_left_closed", _bins("left"))
def agg5_left(spark, sf_dir):
    return A.reliability(forecasts(spark, sf_dir), "pd", F.col("outcome") == "D", rule="left")


@query("agg5_ece", f"WITH b AS ({_bins('right')}) SELECT sum(n * abs_error) / sum(n) AS ece FROM b")
def agg5_ece(spark, sf_dir):
    return A.ece(agg5(spark, sf_dir))


@query("agg6_interval_coverage", f"WITH b AS ({_bins('left')}) SELECT avg((abs(actual - pred) <= 1.645 * sqrt(greatest(pred * (1 - pred), 1e-9) / n))::INT) AS coverage, count(*) AS bins FROM b WHERE n >= 5")
def agg6(spark, sf_dir):
    return A.interval_coverage(agg5_left(spark, sf_dir))


@query("agg7_sliced_reliability", f"""
    WITH {FORECAST_SQL}, x AS (SELECT *, CASE WHEN pa >= 0.6 THEN 'sure' ELSE 'open' END AS certainty, (l_suppkey % 3)::VARCHAR AS side FROM p), s AS (SELECT 'certainty' AS slice, certainty AS bucket, pd, outcome FROM x UNION ALL SELECT 'side', side, pd, outcome FROM x)
    SELECT slice, bucket, least(9, greatest(0, ceil(pd * 10) - 1))::INT AS bin, count(*) AS n, avg(pd) AS pred, avg((outcome = 'D')::INT) AS actual, abs(avg(pd) - avg((outcome = 'D')::INT)) AS abs_error FROM s GROUP BY ALL""")
def agg7(spark, sf_dir):
    f = forecasts(spark, sf_dir).withColumns({"certainty": F.when(F.col("pa") >= 0.6, "sure").otherwise("open"), "side": F.col("l_suppkey") % 3})
    return A.reliability(A.slices(f, ["certainty", "side"]), "pd", F.col("outcome") == "D", by=["slice", "bucket"])


@query("agg8_calibration_line")
def agg8(spark, sf_dir):
    """Intercept and slope; the tests compare them with a fit in numpy."""
    a, b = A.calibration_line(forecasts(spark, sf_dir), "pd", F.col("outcome") == "D")
    return table(spark, sf_dir, "lineitem").agg(F.count("*").alias("n")).select("n", F.lit(a).alias("intercept"), F.lit(b).alias("slope"))


@query("agg9_cluster_bootstrap")
def agg9(spark, sf_dir):
    """Mean of the clusters' mean scores with its interval; the weights are hashes that DuckDB does not have."""
    f = forecasts(spark, sf_dir).withColumn("s", P.rps(F.col("pa"), F.col("pd"), F.col("pb"), F.col("outcome")))
    return A.cluster_bootstrap(f, "l_suppkey", "s")


@query("agg9_paired_delta", f"""
    WITH {FORECAST_SQL}, s AS (SELECT l_suppkey, (pow(pa - (outcome = 'A')::INT, 2) + pow(pa + pd - (outcome IN ('A', 'D'))::INT, 2)) / 2 - (pow(1 / 3.0 - (outcome = 'A')::INT, 2) + pow(2 / 3.0 - (outcome IN ('A', 'D'))::INT, 2)) / 2 AS d FROM p), m AS (SELECT l_suppkey, avg(d) AS m FROM s GROUP BY 1)
    SELECT avg(m) AS mean, count(*) AS clusters, avg((m < 0)::INT) AS better FROM m""")
def agg9_paired(spark, sf_dir):
    """Difference to the uniform forecast, the cluster being the unit."""
    u, y = F.lit(1 / 3), F.col("outcome")
    f = forecasts(spark, sf_dir).withColumn("d", P.rps(F.col("pa"), F.col("pd"), F.col("pb"), y) - P.rps(u, u, u, y))
    m = f.groupBy("l_suppkey").agg(F.avg("d").alias("m"))
    return m.agg(F.avg("m").alias("mean"), F.count("*").alias("clusters"), F.avg((F.col("m") < 0).cast("double")).alias("better"))


@query("agg9_paired_interval")
def agg9_interval(spark, sf_dir):
    """The same difference with its interval over resampled clusters; the tests check its width."""
    u, y = F.lit(1 / 3), F.col("outcome")
    f = forecasts(spark, sf_dir).withColumn("d", P.rps(F.col("pa"), F.col("pd"), F.col("pb"), y) - P.rps(u, u, u, y))
    return A.cluster_bootstrap(f, "l_suppkey", "d")


@query("agg19_completeness", "WITH x AS (SELECT nullif(o_custkey % 4, 0) AS a, nullif(o_orderkey % 10, 1) AS b, o_totalprice AS c FROM orders) SELECT unnest(['a', 'b', 'c']) AS \"column\", unnest([count(a) / count(*), count(b) / count(*), count(c) / count(*)]) AS present FROM x")
def agg19(spark, sf_dir):
    x = table(spark, sf_dir, "orders").select(F.nullif(F.col("o_custkey") % 4, F.lit(0)).alias("a"), F.nullif(F.col("o_orderkey") % 10, F.lit(1)).alias("b"), F.col("o_totalprice").alias("c"))
    return A.completeness(x, ["a", "b", "c"])


DRIFT_SQL = """
    WITH x AS (SELECT l_linestatus = 'O' AS d, unnest(['l_quantity', 'l_discount', 'gap']) AS feature, unnest([l_quantity, l_discount, CASE WHEN l_returnflag = 'A' AND l_linestatus = 'O' THEN l_tax END]) AS v FROM lineitem),
    g AS (SELECT feature, avg(v) FILTER (NOT d) AS mean_a, stddev_pop(v) FILTER (NOT d) AS sd_a, avg((v IS NOT NULL)::INT) FILTER (NOT d) AS present_a, avg(v) FILTER (d) AS mean_b, stddev_pop(v) FILTER (d) AS sd_b, avg((v IS NOT NULL)::INT) FILTER (d) AS present_b FROM x GROUP BY feature),
    s AS (SELECT *, CASE WHEN sqrt((sd_a * sd_a + sd_b * sd_b) / 2) > 0 THEN abs(mean_a - mean_b) / sqrt((sd_a * sd_a + sd_b * sd_b) / 2) END AS smd FROM g)"""


def _drift(spark, sf_dir):
    x = table(spark, sf_dir, "lineitem").withColumns({"d": F.col("l_linestatus") == "O", "gap": F.when((F.col("l_returnflag") == "A") & (F.col("l_linestatus") == "O"), F.col("l_tax"))})
    return A.drift(x, ["l_quantity", "l_discount", "gap"], "d")


@query("agg20_drift", DRIFT_SQL + " SELECT * FROM s")
def agg20(spark, sf_dir):
    return _drift(spark, sf_dir)


@query("agg21_stable_features", DRIFT_SQL + " SELECT feature, CASE WHEN least(present_a, present_b) < 0.5 THEN 'insufficient_presence' WHEN smd > 1 THEN 'domain_shifted' ELSE 'keep' END AS verdict FROM s")
def agg21(spark, sf_dir):
    return A.stable_features(_drift(spark, sf_dir)).select("feature", "verdict")


@query("agg22_domain_baseline", "WITH b AS (SELECT c_mktsegment, ln(avg(c_acctbal + 1000) / 2000.0) AS intercept FROM customer GROUP BY 1) SELECT c_custkey, c.c_mktsegment, c_acctbal + 1000 - exp(intercept) * 2000 AS residual FROM customer c JOIN b USING (c_mktsegment)")
def agg22(spark, sf_dir):
    """Log intercept of each domain against a reference mean, and what is left of each row."""
    c = table(spark, sf_dir, "customer")
    b = c.groupBy("c_mktsegment").agg(F.log(F.avg(F.col("c_acctbal") + 1000) / 2000.0).alias("intercept"))
    return c.join(b, "c_mktsegment").select("c_custkey", "c_mktsegment", (F.col("c_acctbal") + 1000 - F.exp("intercept") * 2000).alias("residual"))


@query("agg23_consensus", f"WITH {FORECAST_SQL}, m AS (SELECT l_orderkey, median(pa) AS a, median(pd) AS d, median(pb) AS b, count(*) AS books FROM p GROUP BY 1) SELECT l_orderkey, a / (a + d + b) AS pa, d / (a + d + b) AS pd, b / (a + d + b) AS pb, books FROM m")
def agg23(spark, sf_dir):
    """Median over books of each class, normalised again."""
    m = forecasts(spark, sf_dir).groupBy("l_orderkey").agg(*(F.median(c).alias(c) for c in ("pa", "pd", "pb")), F.count("*").alias("books"))
    a, d, b = P.normalize(F.col("pa"), F.col("pd"), F.col("pb"))
    return m.select("l_orderkey", a.alias("pa"), d.alias("pd"), b.alias("pb"), "books")


@query("agg24_wilson_gate", """
    WITH k AS (SELECT lang, count(*) AS n, count(*) FILTER (quality = 1) AS k FROM documents JOIN labels USING (doc_id) GROUP BY lang), w AS (SELECT *, (k / n + 1.96 * 1.96 / (2 * n) - 1.96 * sqrt(k / n * (1 - k / n) / n + 1.96 * 1.96 / (4 * n * n))) / (1 + 1.96 * 1.96 / n) AS low FROM k)
    SELECT lang, n, k, low, CASE WHEN n < 50 THEN 'too_few' WHEN low < 0.8 THEN 'too_low' ELSE 'pass' END AS verdict FROM w""")
def agg24(spark, sf_dir):
    j = table(spark, sf_dir, "documents").join(table(spark, sf_dir, "labels"), "doc_id")
    g = j.groupBy("lang").agg(F.count("*").alias("n"), F.count_if(F.col("quality") == 1).alias("k")).withColumn("low", P.wilson_lower(F.col("k"), F.col("n")))
    return g.withColumn("verdict", F.when(F.col("n") < 50, "too_few").when(F.col("low") < 0.8, "too_low").otherwise("pass"))


@query("agg25_funnel", "SELECT unnest(['all', 'has_text', 'long_enough', 'labelled']) AS stage, unnest([count(*), count(*) FILTER (text <> ''), count(*) FILTER (text <> '' AND n_chars >= 500), count(*) FILTER (text <> '' AND n_chars >= 500 AND quality IS NOT NULL)]) AS n FROM documents LEFT JOIN labels USING (doc_id)")
def agg25(spark, sf_dir):
    j = table(spark, sf_dir, "documents").join(table(spark, sf_dir, "labels"), "doc_id", "left")
    return A.funnel(j, [("has_text", F.col("text") != ""), ("long_enough", F.col("n_chars") >= 500), ("labelled", F.col("quality").isNotNull())])


@query("agg26_release_scores", "SELECT s_suppkey, CASE WHEN stddev_samp(s_acctbal) OVER w > 0 THEN (s_acctbal - avg(s_acctbal) OVER w) / stddev_samp(s_acctbal) OVER w END AS z, CASE WHEN count(*) OVER w > 1 THEN 1 - (rank() OVER (PARTITION BY s_nationkey ORDER BY s_acctbal DESC) - 1) / (count(*) OVER w - 1) ELSE 1.0 END AS rank_pct FROM supplier WINDOW w AS (PARTITION BY s_nationkey)")
def agg26(spark, sf_dir):
    return A.release_scores(table(spark, sf_dir, "supplier"), "s_nationkey", "s_acctbal").select("s_suppkey", "z", "rank_pct")


@query("agg27_corpus_quality", "SELECT lang, source, count(*) AS n, count(*) FILTER (n_chars < 300)::BIGINT AS short_n, sum(n_chars)::BIGINT AS chars FROM documents GROUP BY ROLLUP (lang, source)")
def agg27(spark, sf_dir):
    """Counts with subtotals."""
    d = table(spark, sf_dir, "documents")
    return d.rollup("lang", "source").agg(F.count("*").alias("n"), F.count_if(F.col("n_chars") < 300).alias("short_n"), F.sum("n_chars").alias("chars"))


# ---------------------------------------------------------------- the process layer

PITCH_SQL = f"{CLOCKED_SQL}, q AS (SELECT match, idx, t, kind, x AS xg, k % 2 AS team, (idx * 7 % 121)::DOUBLE AS px, (idx * 11 % 81)::DOUBLE AS py FROM e)"


def pitch(spark, sf_dir):
    """Events on a pitch: two teams a match, places from the event's number."""
    return clocked(spark, sf_dir).select("match", "idx", "t", "kind", F.col("x").alias("xg"), (F.col("k") % 2).alias("team"), (F.col("idx") * 7 % 121).cast("double").alias("px"), (F.col("idx") * 11 % 81).cast("double").alias("py"))


@query("agg11_territory", f"""WITH {PITCH_SQL}, g AS (SELECT match, team, count(*) FILTER (px >= 80)::BIGINT AS final_third, count(*) FILTER (px >= 102 AND py BETWEEN 18 AND 62)::BIGINT AS box, count(*) FILTER (px >= 100)::BIGINT AS deep FROM q GROUP BY ALL)
    SELECT *, CASE WHEN sum(final_third) OVER (PARTITION BY match) > 0 THEN final_third / sum(final_third) OVER (PARTITION BY match) END AS tilt FROM g""")
def agg11(spark, sf_dir):
    return X.territory(pitch(spark, sf_dir))


@query("agg12_pressure_counts", f"WITH {PITCH_SQL} SELECT match, team, count(*) FILTER (kind = 'error')::BIGINT AS pressures, count(*) FILTER (kind = 'error' AND px >= 80)::BIGINT AS high_pressures, count(*) FILTER (kind = 'signup')::BIGINT AS regains FROM q GROUP BY ALL")
def agg12(spark, sf_dir):
    p, high = F.col("kind") == "error", F.col("px") >= 80
    return pitch(spark, sf_dir).groupBy("match", "team").agg(F.count_if(p).alias("pressures"), F.count_if(p & high).alias("high_pressures"), F.count_if(F.col("kind") == "signup").alias("regains"))


RUNS_SQL = f"""{PITCH_SQL}, c AS (SELECT *, CASE WHEN team IS DISTINCT FROM lag(team) OVER w THEN 1 ELSE 0 END AS new FROM q WINDOW w AS (PARTITION BY match ORDER BY t, idx)), d AS (SELECT *, sum(new) OVER (PARTITION BY match ORDER BY t, idx ROWS UNBOUNDED PRECEDING) AS possession FROM c),
    r AS (SELECT match, possession::BIGINT AS possession, team, count(*) AS actions, max(t) - min(t) AS seconds, bool_or(px >= 80) AS reached_final, bool_or(px >= 102 AND py BETWEEN 18 AND 62) AS reached_box, arg_max(kind, (t, idx)) AS ended FROM d GROUP BY ALL)"""


@query("agg14_possessions", f"WITH {RUNS_SQL} SELECT * FROM r")
def agg14(spark, sf_dir):
    return X.possessions(pitch(spark, sf_dir))


@query("agg15_attack_phases", f"WITH {RUNS_SQL} SELECT match, team, CASE WHEN ended = 'purchase' THEN 'shot' WHEN reached_box THEN 'box' WHEN actions >= 6 OR seconds >= 864000 THEN 'sustained' WHEN reached_final THEN 'final_third' ELSE 'build_up' END AS phase, count(*) AS n FROM r GROUP BY ALL")
def agg15(spark, sf_dir):
    return X.phases(X.possessions(pitch(spark, sf_dir)), "purchase", 864_000).groupBy("match", "team", "phase").agg(F.count("*").alias("n"))


@query("agg13_set_pieces", f"WITH {RUNS_SQL}, f AS (SELECT d.match, d.team, d.possession, arg_min(d.kind, (d.t, d.idx)) AS began, bool_or(d.kind = 'purchase') AS shot FROM d GROUP BY ALL) SELECT match, team, count(*) FILTER (began = 'signup')::BIGINT AS set_pieces, count(*) FILTER (began = 'signup' AND shot)::BIGINT AS with_shot FROM f GROUP BY ALL")
def agg13(spark, sf_dir):
    """Possessions that begin with a set piece, and those of them with a shot."""
    d = X.with_possession(pitch(spark, sf_dir))
    f = d.groupBy("match", "team", "possession").agg(F.min_by("kind", F.struct("t", "idx")).alias("began"), F.bool_or(F.col("kind") == "purchase").alias("shot"))
    s = F.col("began") == "signup"
    return f.groupBy("match", "team").agg(F.count_if(s).alias("set_pieces"), F.count_if(s & F.col("shot")).alias("with_shot"))


@query("agg16_chance_quality", f"""WITH {PITCH_SQL}, s AS (SELECT *, sqrt(pow(120 - px, 2) + pow(py - 40, 2)) AS dist, abs(atan2(44 - py, 120 - px) - atan2(36 - py, 120 - px)) AS ang, CASE WHEN idx % 3 > 0 THEN xg / 500 END AS q FROM q WHERE kind = 'purchase')
    SELECT match, team, count(*) AS shots, count(q) AS covered, round(sum(q), 6) AS xg, count(*) FILTER (coalesce(q >= 0.3, false) OR (dist <= 12 AND ang >= 0.35))::BIGINT AS big FROM s GROUP BY ALL""")
def agg16(spark, sf_dir):
    """Shots with a quality that every third one lacks: the sum comes with the number it covers."""
    shots = pitch(spark, sf_dir).where("kind = 'purchase'").withColumn("q", F.when(F.col("idx") % 3 > 0, F.col("xg") / 500))
    return X.chances(shots, "q").withColumn("xg", F.round("xg", 6))


@query("agg17_attacking_direction", f"WITH {PITCH_SQL}, d AS (SELECT match, team, avg(px) FILTER (kind = 'purchase') AS m FROM q GROUP BY ALL) SELECT q.match, q.idx, CASE WHEN m IS NULL THEN NULL WHEN m >= 60 THEN px ELSE 120 - px END AS ax FROM q JOIN d ON q.match = d.match AND q.team IS NOT DISTINCT FROM d.team")
def agg17(spark, sf_dir):
    """x towards the goal that a team shoots at, null for a team without shots."""
    return X.attacking_x(pitch(spark, sf_dir), F.col("kind") == "purchase").select("match", "idx", "ax")


@query("agg18_source_quality", f"WITH {CLOCKED_SQL}, g AS (SELECT match, bool_or(k IS NOT NULL) AS has_k, count(*) FILTER (kind = 'purchase') >= 10 AS enough, max(x) <= 400 AS in_range FROM e GROUP BY match) SELECT match, unnest(['has_k', 'enough', 'in_range']) AS capability, unnest([has_k, enough, in_range]) AS ok FROM g")
def agg18(spark, sf_dir):
    g = clocked(spark, sf_dir).groupBy("match").agg(F.bool_or(F.col("k").isNotNull()).alias("has_k"), (F.count_if(F.col("kind") == "purchase") >= 10).alias("enough"), (F.max("x") <= 400).alias("in_range"))
    return g.select("match", F.expr("stack(3, 'has_k', has_k, 'enough', enough, 'in_range', in_range) as (capability, ok)"))
