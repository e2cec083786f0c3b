"""Queries of the scalar functions, row predicates and guards."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import probs as P
from ..operators import projections as R
from ..sources.tables import CLOCKED_SQL, clocked, seconds, table
from .registry import Registry

query = Registry()

#: Three forecast probabilities, odds and an outcome for each line of an order, from its numbers.
FORECAST_SQL = """f AS (
    SELECT l_orderkey, l_linenumber, l_suppkey, l_quantity / 100.0 + 0.05 AS ra, l_discount + 0.05 AS rd, l_tax + 0.1 AS rb,
        CASE l_returnflag WHEN 'A' THEN 'A' WHEN 'N' THEN 'D' ELSE 'B' END AS outcome FROM lineitem
), p AS (SELECT l_orderkey, l_linenumber, l_suppkey, outcome, ra / (ra + rd + rb) AS pa, rd / (ra + rd + rb) AS pd, rb / (ra + rd + rb) AS pb FROM f)"""


def forecasts(spark, sf_dir):
    f = table(spark, sf_dir, "lineitem").select(
        "l_orderkey", "l_linenumber", "l_suppkey", (F.col("l_quantity") / 100.0 + 0.05).alias("ra"), (F.col("l_discount") + 0.05).alias("rd"), (F.col("l_tax") + 0.1).alias("rb"),
        F.when(F.col("l_returnflag") == "A", "A").when(F.col("l_returnflag") == "N", "D").otherwise("B").alias("outcome"))
    pa, pd, pb = P.normalize(F.col("ra"), F.col("rd"), F.col("rb"))
    return f.select("l_orderkey", "l_linenumber", "l_suppkey", "outcome", pa.alias("pa"), pd.alias("pd"), pb.alias("pb"))


@query("fun1_text_normal_hash", r"SELECT doc_id, sha256(trim(regexp_replace(lower(text), '[ \t\n]+', ' ', 'g'))) AS content_hash, CASE WHEN text IS NULL OR trim(text) = '' THEN 'empty' WHEN length(text) < 200 THEN 'short' ELSE 'ok' END AS status FROM documents")
def fun1(spark, sf_dir):
    text = F.trim(F.regexp_replace(F.lower("text"), "[ \t\n]+", " "))
    status = F.when(F.col("text").isNull() | (F.trim("text") == ""), "empty").when(F.length("text") < 200, "short").otherwise("ok")
    return table(spark, sf_dir, "documents").select("doc_id", F.sha2(text, 256).alias("content_hash"), status.alias("status"))


@query("fun1_duplicate_texts", r"WITH h AS (SELECT doc_id, sha256(text) AS h FROM documents WHERE text IS NOT NULL), g AS (SELECT h, min(doc_id) AS first_id, count(*) AS n FROM h GROUP BY h) SELECT doc_id, first_id, n FROM h JOIN g USING (h) WHERE n > 1")
def fun1_duplicates(spark, sf_dir):
    h = table(spark, sf_dir, "documents").where("text IS NOT NULL").select("doc_id", F.sha2("text", 256).alias("h"))
    return h.join(h.groupBy("h").agg(F.min("doc_id").alias("first_id"), F.count("*").alias("n")).where("n > 1"), "h").select("doc_id", "first_id", "n")


@query("fun2_keyword_rules", r"SELECT doc_id, len(regexp_extract_all(text, '(?i)(stupid|idiot|moron)'))::INT AS hits, regexp_matches(text, '(?i)(stupid|idiot)') AND NOT regexp_matches(text, '(?i)not (stupid|idiot)') AS claims FROM documents WHERE text IS NOT NULL")
def fun2(spark, sf_dir):
    """Keyword hits, and a claim unless a negator stands before the keyword."""
    claims = F.col("text").rlike("(?i)(stupid|idiot)") & ~F.col("text").rlike("(?i)not (stupid|idiot)")
    return table(spark, sf_dir, "documents").where("text IS NOT NULL").select("doc_id", F.regexp_count("text", F.lit("(?i)(stupid|idiot|moron)")).alias("hits"), claims.alias("claims"))


@query("fun3_name_normal", "SELECT s_suppkey, trim(regexp_replace(lower(translate(s_name, 'áàâäãåéèêëíìîïóòôöõúùûüçñýÁÀÂÄÉÈÊËÍÓÔÖÚÜÇÑ', 'aaaaaaeeeeiiiiooooouuuucnyAAAAEEEEIOOOUUCN')), '[^a-z0-9]+', ' ', 'g')) AS name FROM supplier")
def fun3(spark, sf_dir):
    return table(spark, sf_dir, "supplier").select("s_suppkey", P.normal_name(F.col("s_name")).alias("name"))


@query("fun4_short_ids", "SELECT o_orderkey, substr(sha256(concat_ws('|', o_custkey::VARCHAR, o_orderkey::VARCHAR, o_orderstatus)), 1, 16) AS id FROM orders")
def fun4(spark, sf_dir):
    return table(spark, sf_dir, "orders").select("o_orderkey", P.short_id(F.col("o_custkey").cast("string"), F.col("o_orderkey").cast("string"), F.col("o_orderstatus")).alias("id"))


@query("fun5_ratings", """
    WITH d AS (SELECT c_custkey, c_acctbal / 10.0 - 400 AS d FROM customer), e AS (SELECT *, 1 / (1 + pow(10.0, -d / 400)) AS p FROM d)
    SELECT c_custkey, p AS expected, p * p + 0.4 * p * (1 - p) AS p_win, 1 - p * p - (1 - p) * (1 - p) - 0.8 * p * (1 - p) AS p_draw, 0.3 * exp(-d * d / 115200) AS g_draw FROM e""")
def fun5(spark, sf_dir):
    d = F.col("c_acctbal") / 10.0 - 400
    win, draw, _ = P.ternary_probs(d)
    return table(spark, sf_dir, "customer").select("c_custkey", P.expected_score(d).alias("expected"), win.alias("p_win"), draw.alias("p_draw"), P.gaussian_draw(d).alias("g_draw"))


@query("fun6_odds", """
    WITH o AS (SELECT c_custkey, 1 + c_acctbal / 2000 AS a, 1 + c_nationkey / 5.0 AS d, 2.5::DOUBLE AS b FROM customer), i AS (SELECT *, CASE WHEN a > 1 THEN 1 / a END AS ia, CASE WHEN d > 1 THEN 1 / d END AS id, 1 / b AS ib FROM o)
    SELECT c_custkey, ia / (ia + id + ib) AS pa, id / (ia + id + ib) AS pd, ib / (ia + id + ib) AS pb, (CASE WHEN a > 1 THEN greatest(0.0, (0.4 * a - 1) / (a - 1)) ELSE 0.0 END)::DOUBLE AS stake FROM i""")
def fun6(spark, sf_dir):
    c = table(spark, sf_dir, "customer").select("c_custkey", (1 + F.col("c_acctbal") / 2000).alias("a"), (1 + F.col("c_nationkey") / 5.0).alias("d"), F.lit(2.5).alias("b"))
    pa, pd, pb = P.no_vig(F.col("a"), F.col("d"), F.col("b"))
    return c.select("c_custkey", pa.alias("pa"), pd.alias("pd"), pb.alias("pb"), P.kelly(F.lit(0.4), F.col("a")).alias("stake"))


@query("fun7_fun8_uncertainty", f"""
    WITH {FORECAST_SQL}, e AS (SELECT *, -(pa * ln(pa) + pd * ln(pd) + pb * ln(pb)) / ln(3) AS entropy, greatest(pa, pd, pb) AS top, 2.5 + l_linenumber AS odds FROM p),
    x AS (SELECT *, pd * (odds - 1) - (1 - pd) AS ev FROM e), v AS (SELECT *, pd * (odds - 1) * (odds - 1) + (1 - pd) - ev * ev AS var FROM x)
    SELECT l_orderkey, l_linenumber, entropy, sqrt(pd * (1 - pd) / 150) AS se, CASE WHEN top >= 0.68 AND entropy <= 0.55 THEN 'low' WHEN top >= 0.55 AND entropy <= 0.75 THEN 'medium' ELSE 'high' END AS band,
        pa * (1 - pa) AS var_a, -pa * pd AS cov_ad, ev AS bet_ev, sqrt(var) AS bet_sd, ev / sqrt(var) AS bet_sharpe FROM v""")
def fun8(spark, sf_dir):
    f = forecasts(spark, sf_dir)
    p = [F.col("pa"), F.col("pd"), F.col("pb")]
    f = f.withColumns({"entropy": P.entropy(*p), "top": F.greatest(*p)})
    cov, bet = P.categorical_covariance(*p), P.bet_risk(F.col("pd"), 2.5 + F.col("l_linenumber"))
    return f.select("l_orderkey", "l_linenumber", "entropy", P.standard_error(F.col("pd")).alias("se"), P.risk_band(F.col("top"), F.col("entropy")).alias("band"), cov[0][0].alias("var_a"), cov[0][1].alias("cov_ad"), *(bet[k].alias(f"bet_{k}") for k in ("ev", "sd", "sharpe")))


@query("fun7_blend_resplit", f"WITH {FORECAST_SQL} SELECT l_orderkey, l_linenumber, 0.75 * pa + 0.25 / 3 AS pa, (pa * (1 - least(0.9, pd * 1.1)) / (pa + pb)) AS split_a, least(0.9, pd * 1.1) AS split_d FROM p")
def fun7(spark, sf_dir):
    """A fixed blend with the uniform forecast, and the other classes re-split after a change of the draw."""
    draw = F.least(F.lit(0.9), F.col("pd") * 1.1)
    return forecasts(spark, sf_dir).select("l_orderkey", "l_linenumber", (0.75 * F.col("pa") + 0.25 / 3).alias("pa"), (F.col("pa") * (1 - draw) / (F.col("pa") + F.col("pb"))).alias("split_a"), draw.alias("split_d"))


GRID = "SELECT i, j FROM range(9) a(i), range(9) b(j)"


@query("fun10_score_grid", f"""
    WITH r AS (SELECT c_custkey, 0.5 + (c_acctbal + 1000) / 2500 AS h, 1.0 + c_nationkey / 12.0 AS a FROM customer), g AS ({GRID}),
    q AS (SELECT *, exp(-h) * pow(h, i) / factorial(i::INT) AS x, exp(-a) * pow(a, j) / factorial(j::INT) AS y FROM r, g),
    t AS (SELECT *, 1 - sum(x) FILTER (j = 0) OVER w AS tx, 1 - sum(y) FILTER (i = 0) OVER w AS ty FROM q WINDOW w AS (PARTITION BY c_custkey)),
    m AS (SELECT c_custkey, i, j, (x * y + CASE WHEN i = 8 THEN tx * y ELSE 0 END + CASE WHEN j = 8 THEN ty * x ELSE 0 END) * CASE WHEN i = j THEN 1.05 ELSE 1 END
        * CASE WHEN i = 0 AND j = 0 THEN greatest(0.001, 1 - 0.25 * h * a) WHEN i = 0 AND j = 1 THEN greatest(0.001, 1 + 0.25 * h) WHEN i = 1 AND j = 0 THEN greatest(0.001, 1 + 0.25 * a) WHEN i = 1 AND j = 1 THEN 0.75 ELSE 1 END AS p FROM t)
    SELECT c_custkey, sum(p) FILTER (i > j) / sum(p) AS win, sum(p) FILTER (i = j) / sum(p) AS draw, sum(p) FILTER (i + j <= 2) / sum(p) AS under FROM m GROUP BY c_custkey""")
def fun10(spark, sf_dir):
    """1X2 and a cluster from the score grid: tails in the last row and column, low scores corrected, draws inflated."""
    r = table(spark, sf_dir, "customer").select("c_custkey", (0.5 + (F.col("c_acctbal") + 1000) / 2500).alias("h"), (1.0 + F.col("c_nationkey") / 12.0).alias("a"))
    tests = {"win": lambda i, j: i > j, "draw": lambda i, j: i == j, "under": lambda i, j: i + j <= 2}
    return P.with_grid_masses(r, F.col("h"), F.col("a"), tests, rho=0.25, inflation=0.05).select("c_custkey", *tests)


@query("fun11_remaining_wdl", f"""
    WITH r AS (SELECT o_orderkey, 1.35 * (o_orderkey % 90) / 90.0 AS h, 1.35 * (o_orderkey % 90) / 90.0 * 0.8 AS a, (o_custkey % 5 - 2) AS d FROM orders), g AS ({GRID}),
    m AS (SELECT o_orderkey, i - j + d AS x, exp(-h) * pow(h, i) / factorial(i::INT) * exp(-a) * pow(a, j) / factorial(j::INT) AS p FROM r, g)
    SELECT o_orderkey, coalesce(sum(p) FILTER (x > 0), 0) / sum(p) AS win, coalesce(sum(p) FILTER (x = 0), 0) / sum(p) AS draw, coalesce(sum(p) FILTER (x < 0), 0) / sum(p) AS loss FROM m GROUP BY o_orderkey""")
def fun11(spark, sf_dir):
    o = table(spark, sf_dir, "orders").withColumn("rate", P.remaining_rate((F.col("o_orderkey") % 90).cast("double")))
    return P.with_wdl(o, F.col("rate"), F.col("rate") * 0.8, F.col("o_custkey") % 5 - 2).select("o_orderkey", "win", "draw", "loss")


@query("fun12_inplay_update", """
    WITH r AS (SELECT o_orderkey, 1.2 + (o_custkey % 7) * 0.1 AS la, 1.0 + (o_custkey % 5) * 0.1 AS lb, o_orderkey % 131 AS minute, o_custkey % 5 - 2 AS diff, o_custkey % 3 AS ka, o_orderkey % 2 AS kb, CASE WHEN o_custkey % 4 > 0 THEN o_totalprice / 100000 END AS xa, CASE WHEN o_custkey % 6 > 0 THEN o_totalprice / 200000 END AS xb FROM orders),
    t AS (SELECT *, greatest(0, 90 - least(120, minute)) / 90.0 AS left_share, greatest(1e-6, least(120, minute) / 90.0) AS gone FROM r)
    SELECT o_orderkey,
        least(5, greatest(0.01, la * left_share * CASE WHEN diff < 0 THEN 1 + 0.14 * abs(diff) WHEN diff > 0 THEN greatest(0.2, 1 - 0.05 * diff) ELSE 1 END * pow(0.7, ka) * pow(1.18, kb) * CASE WHEN xa IS NULL THEN 1 ELSE exp(0.35 * least(2, greatest(-2, xa - la * gone)) / greatest(0.5, la)) END)) AS ra,
        least(5, greatest(0.01, lb * left_share * CASE WHEN diff > 0 THEN 1 + 0.14 * diff WHEN diff < 0 THEN greatest(0.2, 1 - 0.05 * abs(diff)) ELSE 1 END * pow(0.7, kb) * pow(1.18, ka) * CASE WHEN xb IS NULL THEN 1 ELSE exp(0.35 * least(2, greatest(-2, xb - lb * gone)) / greatest(0.5, lb)) END)) AS rb FROM t""")
def fun12(spark, sf_dir):
    """Rates for the rest of the match: time, score state, red cards and chances so far."""
    c, o = F.col("o_custkey"), F.col("o_orderkey")
    xg = [F.when(c % 4 > 0, F.col("o_totalprice") / 100_000), F.when(c % 6 > 0, F.col("o_totalprice") / 200_000)]
    ra, rb = P.remaining_rates(1.2 + (c % 7) * 0.1, 1.0 + (c % 5) * 0.1, (o % 131).cast("double"), c % 5 - 2, c % 3, o % 2, *xg)
    return table(spark, sf_dir, "orders").select("o_orderkey", ra.alias("ra"), rb.alias("rb"))


@query("fun13_horizon_probability", "SELECT o_orderkey, 1 - exp(-1.35 * least(15, 90 - o_orderkey % 91) / 90.0) AS p_goal, 1 - exp(-2.7 * least(15, 90 - o_orderkey % 91) / 90.0) AS p_any FROM orders")
def fun13(spark, sf_dir):
    rate = P.remaining_rate(F.least(F.lit(15), 90 - F.col("o_orderkey") % 91).cast("double"))
    return table(spark, sf_dir, "orders").select("o_orderkey", P.goal_within(rate).alias("p_goal"), P.goal_within(2 * rate).alias("p_any"))


@query("fun14_temperature", f"WITH {FORECAST_SQL} SELECT l_orderkey, l_linenumber, pow(pa, 1 / 1.5) / (pow(pa, 1 / 1.5) + pow(pd, 1 / 1.5) + pow(pb, 1 / 1.5)) AS pa FROM p")
def fun14(spark, sf_dir):
    f = forecasts(spark, sf_dir)
    return f.select("l_orderkey", "l_linenumber", P.temperature(1.5, F.col("pa"), F.col("pd"), F.col("pb"))[0].alias("pa"))


PLACE_SQL = "SELECT c_custkey AS id, c_nationkey * 3.0 - 30 AS lat, c_nationkey * 7.0 - 90 AS lon, c_acctbal / 100 AS x, (c_custkey % 80)::DOUBLE AS y FROM customer"


@query("fun15_haversine", f"WITH v AS ({PLACE_SQL}) SELECT id, 2 * 6371.0 * asin(sqrt(pow(sin(radians(52 - lat) / 2), 2) + cos(radians(lat)) * cos(radians(52)) * pow(sin(radians(13 - lon) / 2), 2))) AS km FROM v")
def fun15(spark, sf_dir):
    c = table(spark, sf_dir, "customer")
    return c.select(F.col("c_custkey").alias("id"), P.haversine_km(F.col("c_nationkey") * 3.0 - 30, F.col("c_nationkey") * 7.0 - 90, F.lit(52.0), F.lit(13.0)).alias("km"))


@query("fun16_pitch_geometry", f"""WITH v AS ({PLACE_SQL}) SELECT id, CASE WHEN x < 40 THEN 'defensive' WHEN x < 80 THEN 'middle' ELSE 'final' END AS third, CASE WHEN y < 80 / 3.0 THEN 'left' WHEN y < 160 / 3.0 THEN 'centre' ELSE 'right' END AS channel,
    x >= 102 AND y BETWEEN 18 AND 62 AS box, sqrt(pow(120 - x, 2) + pow(y - 40, 2)) AS distance, abs(atan2(44 - y, 120 - x) - atan2(36 - y, 120 - x)) AS angle FROM v""")
def fun16(spark, sf_dir):
    x, y = F.col("c_acctbal") / 100, (F.col("c_custkey") % 80).cast("double")
    return table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id"), P.third(x).alias("third"), P.channel(y).alias("channel"), P.in_box(x, y).alias("box"), P.shot_distance(x, y).alias("distance"), P.shot_angle(x, y).alias("angle"))


@query("prj1_prj2_outcome_deltas", "SELECT o_orderkey, CASE WHEN o_custkey % 4 > o_orderkey % 4 THEN 'A' WHEN o_custkey % 4 = o_orderkey % 4 THEN 'D' ELSE 'B' END AS outcome, (o_custkey % 4 = o_orderkey % 4)::INT AS is_draw, o_custkey % 4 - o_orderkey % 4 AS goal_delta, abs(o_custkey % 4 - o_orderkey % 4) AS abs_goal_delta FROM orders")
def prj1(spark, sf_dir):
    o = table(spark, sf_dir, "orders").select("o_orderkey", (F.col("o_custkey") % 4).alias("goals_a"), (F.col("o_orderkey") % 4).alias("goals_b"))
    return R.deltas(R.outcome(o), [("goals_a", "goals_b", "goal_delta"), ("elo_a", "elo_b", "elo_delta")]).drop("goals_a", "goals_b")


@query("prj3_bounded_indices", """
    WITH o AS (SELECT o_orderkey, (o_custkey % 30) / 10.0 AS total, o_orderkey % 900 AS gap, o_custkey % 7 AS ra, o_orderkey % 6 AS rb, (o_custkey * 13 % 5000)::DOUBLE AS ma, o_orderkey % 11 - 5 AS tz, 70 + o_custkey % 40 AS heat FROM orders),
    u AS (SELECT *, least(1, greatest(0, (4 - ra) / 3.0)) + least(1, greatest(0, ma / 3000)) + least(1, greatest(0, abs(tz) / 4.0)) + least(1, greatest(0, (heat - 80) / 25.0)) AS fa, least(1, greatest(0, (4 - rb) / 3.0)) + least(1, greatest(0, (heat - 80) / 25.0)) AS fb FROM o)
    SELECT o_orderkey, least(1, greatest(0, (2.7 - total) / 1.2)) * least(1, greatest(0, gap / 450.0)) * 0.5 AS low_block_risk, fa AS travel_fatigue_a, fb AS travel_fatigue_b, (fa + fb) / 4 AS travel_fatigue, fa - fb AS travel_fatigue_delta FROM u""")
def prj3(spark, sf_dir):
    c, k = F.col("o_custkey"), F.col("o_orderkey")
    o = table(spark, sf_dir, "orders").select(k, ((c % 30) / 10.0).alias("market_total_goals"), (k % 900).alias("abs_elo_delta"), (c % 7).alias("rest_days_a"), (k % 6).alias("rest_days_b"), (c * 13 % 5000).cast("double").alias("travel_miles_last7_a"), (k % 11 - 5).alias("timezone_shift_a"), (70 + c % 40).alias("heat_index"))
    return R.travel_fatigue(R.low_block_risk(o)).select("o_orderkey", "low_block_risk", "travel_fatigue_a", "travel_fatigue_b", "travel_fatigue", "travel_fatigue_delta")


@query("prj4_stage_filter", "SELECT o_orderkey, o_orderpriority FROM orders WHERE year(o_orderdate) BETWEEN 1996 AND 1998 AND contains(lower(o_orderpriority), 'high')")
def prj4(spark, sf_dir):
    return R.stage_filter(table(spark, sf_dir, "orders"), "o_orderdate", "o_orderpriority", "high", 1996, 1998).select("o_orderkey", "o_orderpriority")


@query("prj5_leakage_safe_frame", "SELECT l_orderkey, l_linenumber, l_quantity, CASE WHEN l_discount = 0 THEN 0 ELSE l_quantity / l_discount END AS ratio, l_tax FROM lineitem")
def prj5(spark, sf_dir):
    f = table(spark, sf_dir, "lineitem").withColumn("ratio", F.when(F.col("l_discount") == 0, F.lit(float("inf"))).otherwise(F.col("l_quantity") / F.col("l_discount")))
    return R.leakage_safe(f.drop("l_partkey", "l_suppkey"), forbidden=["l_extendedprice", "l_discount"])


@query("prj6_locked_holdout", "SELECT count(*) AS n, count(*) FILTER (o_orderdate >= TIMESTAMP '2001-01-01') AS locked FROM orders")
def prj6(spark, sf_dir):
    """What a locked hold-out takes away from a table: all rows, less those that stay."""
    o = table(spark, sf_dir, "orders").select("o_orderdate", F.lit(1).alias("all"))
    free = R.exclude_locked(o, F.col("o_orderdate") >= F.lit("2001-01-01").cast("timestamp_ntz")).withColumn("all", F.lit(0))
    return o.unionByName(free).agg(F.count_if(F.col("all") == 1).alias("n"), (F.count_if(F.col("all") == 1) - F.count_if(F.col("all") == 0)).alias("locked"))


@query("prj7_time_gates", "SELECT l_linestatus, count(*) AS n, count(*) FILTER (l_shipdate > o_orderdate)::BIGINT AS violations FROM lineitem JOIN orders ON l_orderkey = o_orderkey GROUP BY l_linestatus")
def prj7(spark, sf_dir):
    """Rows whose fact (shipping) was not known by the decision (ordering)."""
    j = table(spark, sf_dir, "lineitem").join(table(spark, sf_dir, "orders"), F.col("l_orderkey") == F.col("o_orderkey"))
    return j.groupBy("l_linestatus").agg(F.count("*").alias("n"), F.count_if(~R.known_by(F.col("l_shipdate"), F.col("o_orderdate"))).alias("violations"))


@query("prj8_live_publication", f"WITH {CLOCKED_SQL} SELECT match, idx, coalesce(CASE WHEN k % 10 > 0 THEN t + 30 <= t + k END, false) AS live FROM e")
def prj8(spark, sf_dir):
    """Live only if published, with a safety lag, by the decision; unknown publication is never live."""
    published = F.when(F.col("k") % 10 > 0, F.col("t"))
    return clocked(spark, sf_dir).select("match", "idx", R.live_safe(published, F.col("t") + F.col("k"), 30).alias("live"))


@query("prj9_eligibility_plane", f"WITH {CLOCKED_SQL} SELECT match, idx, CASE WHEN k % 2 = 1 THEN 'blocked' WHEN k % 3 = 0 THEN 'live' WHEN k % 5 = 0 THEN 'historical' ELSE 'static' END AS plane FROM e")
def prj9(spark, sf_dir):
    k = F.col("k")
    return clocked(spark, sf_dir).select("match", "idx", R.plane(k % 2 == 0, k % 3 == 0, k % 5 == 0).alias("plane"))


@query("prj10_contract_errors", """SELECT e AS error, count(*) AS n FROM (SELECT unnest(list_filter([CASE WHEN text IS NULL OR text = '' THEN 'text: required' END, CASE WHEN lang NOT IN ('en', 'de', 'fr') THEN 'lang: not allowed' END, CASE WHEN n_chars < 300 THEN 'n_chars: below 300' END], lambda x: x IS NOT NULL)) AS e FROM documents) GROUP BY e""")
def prj10(spark, sf_dir):
    contract = {"text": {"required": True}, "lang": {"enum": ["en", "de", "fr"]}, "n_chars": {"min": 300}}
    errors = table(spark, sf_dir, "documents").select(F.explode(R.contract_errors(contract)).alias("error"))
    return errors.groupBy("error").agg(F.count("*").alias("n"))


@query("prj11_scoring_gates", f"""WITH {FORECAST_SQL}, r AS (SELECT CASE WHEN abs(pa + pd + pb - 1) > 1e-6 THEN 'not_simplex' WHEN pd < 0.1 THEN 'draw_too_low' WHEN l_suppkey % 10 = 0 THEN 'supplier_barred' END AS reason FROM p) SELECT coalesce(reason, 'kept') AS reason, count(*) AS n FROM r GROUP BY 1""")
def prj11(spark, sf_dir):
    gates = [("not_simplex", F.abs(F.col("pa") + F.col("pd") + F.col("pb") - 1) > 1e-6), ("draw_too_low", F.col("pd") < 0.1), ("supplier_barred", F.col("l_suppkey") % 10 == 0)]
    kept, excluded = R.gated(forecasts(spark, sf_dir), gates)
    return kept.select(F.lit("kept").alias("reason")).unionByName(excluded.select("reason")).groupBy("reason").agg(F.count("*").alias("n"))


@query("prj12_provider_semantics", f"""
    WITH {CLOCKED_SQL}, g AS (SELECT *, CASE WHEN k % 3 = 0 THEN 'p1' WHEN k % 3 = 1 THEN 'p2' ELSE 'p9' END AS provider, (k % 2) AS side, kind = 'error' AS own FROM e WHERE kind IN ('purchase', 'error')),
    c AS (SELECT g.* FROM g WHERE NOT EXISTS (SELECT 1 FROM e v WHERE v.kind = 'signup' AND v.match = g.match AND v.t // 60 = g.t // 60))
    SELECT match, count(*) FILTER (provider <> 'p9' AND (CASE WHEN own AND provider = 'p2' THEN 1 - side ELSE side END) = 0)::BIGINT AS home, count(*) FILTER (provider <> 'p9' AND (CASE WHEN own AND provider = 'p2' THEN 1 - side ELSE side END) = 1)::BIGINT AS away, count(*) FILTER (provider = 'p9')::BIGINT AS unknown FROM c GROUP BY match""")
def prj12(spark, sf_dir):
    """Score by provider: whose name an own goal carries differs, cancelled goals go, an unknown provider counts for nobody."""
    e = clocked(spark, sf_dir)
    g = e.where("kind IN ('purchase', 'error')").withColumns({"provider": F.when(F.col("k") % 3 == 0, "p1").when(F.col("k") % 3 == 1, "p2").otherwise("p9"), "side": F.col("k") % 2, "own": F.col("kind") == "error"})
    cancelled = e.where("kind = 'signup'").select("match", F.floor(F.col("t") / 60).alias("minute")).distinct()
    g = g.withColumn("minute", F.floor(F.col("t") / 60)).join(cancelled, ["match", "minute"], "left_anti")
    return R.score_by_provider(g, {"p1": False, "p2": True}, "match")


@query("prj15_reorient", f"WITH {FORECAST_SQL} SELECT l_orderkey, l_linenumber, CASE WHEN l_suppkey % 2 = 0 THEN pa ELSE pb END AS p_team_a, pd AS p_draw, CASE WHEN l_suppkey % 2 = 0 THEN pb ELSE pa END AS p_team_b FROM p")
def prj15(spark, sf_dir):
    return R.reorient(forecasts(spark, sf_dir), F.col("l_suppkey") % 2 == 0, "pa", "pd", "pb").select("l_orderkey", "l_linenumber", "p_team_a", "p_draw", "p_team_b")


@query("prj16_prj17_regimes", f"""WITH {CLOCKED_SQL}, n AS (SELECT *, 90 - k % 91 AS left_min FROM e) SELECT concat_ws('|', CASE WHEN left_min <= 25 THEN 'late' WHEN left_min >= 65 THEN 'early' ELSE 'middle' END, CASE WHEN x >= 50 THEN 'rich' WHEN x >= 10 THEN 'partial' ELSE 'thin' END) AS regime, count(*) AS n, count(DISTINCT match) AS matches FROM n GROUP BY 1""")
def prj16(spark, sf_dir):
    """PRJ16, PRJ17 and AGG29: regime labels and how many rows and matches each has."""
    e = clocked(spark, sf_dir).withColumn("left_min", 90 - F.col("k") % 91)
    e = e.withColumn("regime", F.concat_ws("|", R.bucket(F.col("left_min"), [(25, "late"), (64, "middle")], "early"), R.bucket(F.col("x"), [(9.999999, "thin"), (49.999999, "partial")], "rich")))
    return e.groupBy("regime").agg(F.count("*").alias("n"), F.count_distinct("match").alias("matches"))


@query("prj18_card_classes", f"""WITH {CLOCKED_SQL}, c AS (SELECT *, count(*) OVER (PARTITION BY match, k ORDER BY idx) AS nth FROM e WHERE kind = 'error')
    SELECT match, idx, CASE WHEN nth = 1 THEN 'yellow' WHEN nth = 2 THEN 'second_yellow' ELSE 'after' END AS card FROM c""")
def prj18(spark, sf_dir):
    """The running number of a player's bookings in a match decides what a card is."""
    return R.card_class(clocked(spark, sf_dir).where("kind = 'error'"), ["match", "k"], "idx").select("match", "idx", "card")


@query("prj19_comparable_state", f"WITH {CLOCKED_SQL} SELECT match, idx, coalesce(x, 0) - k AS score_diff, (90 - k % 91) / 90.0 AS left_share, CASE WHEN k % 91 < 45 THEN 1 ELSE 2 END AS half FROM e")
def prj19(spark, sf_dir):
    minute = F.col("k") % 91
    return clocked(spark, sf_dir).select("match", "idx", (F.coalesce("x", F.lit(0.0)) - F.col("k")).alias("score_diff"), ((90 - minute) / 90.0).alias("left_share"), F.when(minute < 45, 1).otherwise(2).alias("half"))


@query("prj20_rights_filter", "SELECT doc_id, source FROM documents WHERE source IN ('src1', 'src3')")
def prj20(spark, sf_dir):
    rights = spark.createDataFrame([("src1", "research"), ("src2", "none"), ("src3", "research")], "source string, right string")
    return R.permitted(table(spark, sf_dir, "documents"), rights, "source", "research").select("doc_id", "source")


@query("str4_staleness", "SELECT l_orderkey, l_linenumber, l_shipdate > o_orderdate + INTERVAL 30 DAY AS stale FROM lineitem JOIN orders ON l_orderkey = o_orderkey")
def str4(spark, sf_dir):
    j = table(spark, sf_dir, "lineitem").join(table(spark, sf_dir, "orders"), F.col("l_orderkey") == F.col("o_orderkey"))
    return j.select("l_orderkey", "l_linenumber", (seconds(F.col("l_shipdate")) > seconds(F.col("o_orderdate")) + 30 * 86_400).alias("stale"))


@query("fun9_beta_interval")
def fun9(spark, sf_dir):
    """Beta intervals of shares; the test compares them with sampled ones."""
    share = table(spark, sf_dir, "customer").select("c_custkey", ((F.col("c_custkey") % 97 + 1) / 100.0).alias("p"))
    return share.withColumn("b", P.beta_interval(F.col("p"))).select("c_custkey", "p", F.round("b.low", 4).alias("low"), F.round("b.high", 4).alias("high"))
