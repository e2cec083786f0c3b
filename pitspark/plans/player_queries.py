"""Queries of entity priors, lineups, context, ratings and folds."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import probs as P
from ..operators import pit
from ..operators import players as L
from ..sources.tables import CLOCKED_SQL, clocked, seconds, table
from .registry import Registry

query = Registry()

#: An appearance is a line of an order: the supplier plays for the customer's side on the order's day.
APP_SQL = """a AS (SELECT l_suppkey AS player, o_custkey % 40 AS team, o_orderpriority AS ctype, l_orderkey AS fixture, l_linenumber AS slot, epoch_us(o_orderdate) // 86400000000 AS day,
    l_quantity AS minutes, CASE WHEN l_returnflag = 'A' THEN 1 ELSE 0 END AS goals FROM lineitem JOIN orders ON l_orderkey = o_orderkey)"""


def appearances(spark, sf_dir):
    j = table(spark, sf_dir, "lineitem").join(table(spark, sf_dir, "orders"), F.col("l_orderkey") == F.col("o_orderkey"))
    return j.select(
        F.col("l_suppkey").alias("player"), (F.col("o_custkey") % 40).alias("team"), F.col("o_orderpriority").alias("ctype"), F.col("l_orderkey").alias("fixture"), F.col("l_linenumber").alias("slot"),
        F.floor(seconds(F.col("o_orderdate")) / 86_400).alias("day"), F.col("l_quantity").alias("minutes"), F.when(F.col("l_returnflag") == "A", 1).otherwise(0).alias("goals"))


@query("win16_shrunk_prior", f"""
    WITH {APP_SQL}, p AS (SELECT player, day, sum(minutes) AS m, sum(goals) AS g FROM a GROUP BY ALL), pc AS (SELECT player, day, coalesce(sum(m) OVER w, 0) AS m, coalesce(sum(g) OVER w, 0) AS g FROM p WINDOW w AS (PARTITION BY player ORDER BY day RANGE BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
    d AS (SELECT day, sum(minutes) AS m, sum(goals) AS g FROM a GROUP BY day), dc AS (SELECT day, sum(g) OVER w / nullif(sum(m) OVER w, 0) AS rate FROM d WINDOW w AS (ORDER BY day RANGE BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING))
    SELECT pc.player, pc.day, pc.m::DOUBLE AS prior_minutes, (pc.g + 270 * coalesce(dc.rate, 0)) / (pc.m + 270) AS prior_rate FROM pc JOIN dc USING (day)""")
def win16(spark, sf_dir):
    """Goals a minute before the day, shrunk to the global rate before it; the global sums are a row a day."""
    return L.shrunk_prior(appearances(spark, sf_dir), ["player"], "day", "goals", "minutes", 270.0)


@query("win17_shrinkage_ladder", f"""
    WITH {APP_SQL}, p AS (SELECT player, team, day, sum(minutes) AS m, sum(goals) AS g FROM a GROUP BY ALL),
    pc AS (SELECT player, team, day, coalesce(sum(m) OVER w, 0) AS m, coalesce(sum(g) OVER w, 0) AS g FROM p WINDOW w AS (PARTITION BY player, team ORDER BY day RANGE BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
    t AS (SELECT team, day, sum(minutes) AS m, sum(goals) AS g FROM a GROUP BY ALL), tc AS (SELECT team, day, coalesce(sum(m) OVER w, 0) AS m, coalesce(sum(g) OVER w, 0) AS g FROM t WINDOW w AS (PARTITION BY team ORDER BY day RANGE BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
    d AS (SELECT day, sum(minutes) AS m, sum(goals) AS g FROM a GROUP BY day), dc AS (SELECT day, coalesce(sum(g) OVER w / nullif(sum(m) OVER w, 0), 0) AS rate FROM d WINDOW w AS (ORDER BY day RANGE BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING))
    SELECT pc.player, pc.team, pc.day, (pc.g + 270 * (tc.g + 540 * dc.rate) / (tc.m + 540)) / (pc.m + 270) AS prior_rate FROM pc JOIN tc USING (team, day) JOIN dc USING (day)""")
def win17(spark, sf_dir):
    """Player shrunk to the team, the team to all: a cumulative table for each tier, joined by day."""
    a = appearances(spark, sf_dir)
    tiers = [(["player", "team"], 270.0), (["team"], 540.0)]
    return L.shrinkage_ladder(a, tiers, "day", "goals", "minutes").select("player", "team", "day", "prior_rate")


@query("win18_exposure_recency", f"""
    WITH {APP_SQL}, p AS (SELECT player, day, sum(minutes) AS m FROM a GROUP BY ALL)
    SELECT player, day, coalesce(sum(m) OVER (PARTITION BY player ORDER BY day ROWS BETWEEN 5 PRECEDING AND 1 PRECEDING), 0)::DOUBLE AS last5, count(*) OVER (PARTITION BY player ORDER BY day ROWS BETWEEN 10 PRECEDING AND 1 PRECEDING) AS seen10, day - lag(day) OVER (PARTITION BY player ORDER BY day) AS days_since FROM p""")
def win18(spark, sf_dir):
    p = appearances(spark, sf_dir).groupBy("player", "day").agg(F.sum("minutes").alias("m"))
    w = Window.partitionBy("player").orderBy("day")
    return p.select("player", "day", F.coalesce(F.sum("m").over(w.rowsBetween(-5, -1)), F.lit(0.0)).alias("last5"), F.count("*").over(w.rowsBetween(-10, -1)).alias("seen10"), (F.col("day") - F.lag("day").over(w)).alias("days_since"))


@query("win19_lineup_aggregate", f"WITH {APP_SQL}, r AS (SELECT *, row_number() OVER (PARTITION BY fixture ORDER BY minutes DESC, slot) AS top, row_number() OVER (PARTITION BY fixture ORDER BY minutes, slot) AS low FROM a) SELECT fixture, avg(minutes) AS mean, avg(minutes) FILTER (top <= 3) AS top3, avg(minutes) FILTER (low <= 3) AS bottom3, sum(minutes * slot) / sum(slot) AS weighted, count(*) / 11.0 AS completeness FROM r GROUP BY fixture")
def win19(spark, sf_dir):
    return L.lineup_aggregate(appearances(spark, sf_dir), ["fixture"], "minutes", F.col("slot"))


@query("win20_substitution_delta", f"WITH {APP_SQL}, s AS (SELECT fixture, max(minutes) FILTER (slot = 2) - max(minutes) FILTER (slot = 1) AS delta FROM a GROUP BY fixture) SELECT fixture, delta FROM s WHERE delta IS NOT NULL")
def win20(spark, sf_dir):
    """What comes on less what goes off."""
    a = appearances(spark, sf_dir).groupBy("fixture").agg((F.max(F.when(F.col("slot") == 2, F.col("minutes"))) - F.max(F.when(F.col("slot") == 1, F.col("minutes")))).alias("delta"))
    return a.where("delta IS NOT NULL")


@query("win21_key_players", f"""
    WITH {APP_SQL}, p AS (SELECT team, player, day, sum(minutes) AS m FROM a GROUP BY ALL), c AS (SELECT team, player, sum(m) AS total FROM p WHERE day < 10500 GROUP BY ALL), k AS (SELECT *, row_number() OVER (PARTITION BY team ORDER BY total DESC, player) AS place FROM c)
    SELECT team, player, total::DOUBLE AS total, place FROM k WHERE place <= 5""")
def win21(spark, sf_dir):
    """The five players of a side with most minutes before a day."""
    c = appearances(spark, sf_dir).where("day < 10500").groupBy("team", "player").agg(F.sum("minutes").alias("total"))
    return c.withColumn("place", F.row_number().over(Window.partitionBy("team").orderBy(F.desc("total"), "player"))).where("place <= 5")


@query("win14_win15_on_pitch", f"""
    WITH {CLOCKED_SQL}, i AS (SELECT match, k AS player, min(t) FILTER (kind = 'signup') AS came, min(t) FILTER (kind = 'error') AS went FROM e GROUP BY ALL), p AS (SELECT match, player, came, CASE WHEN went > came THEN went END AS went FROM i WHERE came IS NOT NULL)
    SELECT p.match, p.player, count(e.idx)::BIGINT AS goals_for FROM p LEFT JOIN e ON e.match = p.match AND e.kind = 'purchase' AND e.t >= p.came AND (p.went IS NULL OR e.t < p.went) GROUP BY ALL""")
def win15(spark, sf_dir):
    """Goals while a player was on the pitch: first on to first off."""
    e = clocked(spark, sf_dir)
    i = L.on_pitch(e, ["match", "k"], "t", F.col("kind") == "signup", F.col("kind") == "error").withColumnRenamed("k", "player")
    return L.while_on(i, e.where("kind = 'purchase'"), "match", "player", "t").withColumnRenamed("n", "goals_for")


@query("win22_rest_travel", """
    WITH o AS (SELECT o_custkey, o_orderkey, o_orderdate, o_orderkey % 25 * 3.0 - 30 AS lat, o_orderkey % 25 * 7.0 - 90 AS lon, o_orderkey % 9 * 250 AS alt FROM orders), l AS (SELECT *, alt - lag(alt) OVER w AS climb_m, lag(o_orderdate) OVER w AS pd, lag(lat) OVER w AS plat, lag(lon) OVER w AS plon FROM o WINDOW w AS (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey))
    SELECT o_orderkey, (epoch_us(o_orderdate) - epoch_us(pd)) / 86400000000.0 AS rest_days, climb_m, 2 * 6371.0 * asin(sqrt(pow(sin(radians(lat - plat) / 2), 2) + cos(radians(plat)) * cos(radians(lat)) * pow(sin(radians(lon - plon) / 2), 2))) AS km FROM l""")
def win22(spark, sf_dir):
    o = table(spark, sf_dir, "orders").select("o_custkey", "o_orderkey", seconds(F.col("o_orderdate")).alias("t"), (F.col("o_orderkey") % 25 * 3.0 - 30).alias("lat"), (F.col("o_orderkey") % 25 * 7.0 - 90).alias("lon"), (F.col("o_orderkey") % 9 * 250).alias("alt"))
    w = Window.partitionBy("o_custkey").orderBy("t", "o_orderkey")
    km = P.haversine_km(F.lag("lat").over(w), F.lag("lon").over(w), F.col("lat"), F.col("lon"))
    return o.select("o_orderkey", ((F.col("t") - F.lag("t").over(w)) / 86_400.0).alias("rest_days"), (F.col("alt") - F.lag("alt").over(w)).alias("climb_m"), km.alias("km"))


@query("win23_rating_periods")
def win23(spark, sf_dir):
    """Ratings by yearly periods: all matches of a period use the ratings before it; the tests replay it in Python."""
    o = table(spark, sf_dir, "orders")
    price = F.floor("o_totalprice").cast("long")
    m = o.select((F.year("o_orderdate")).alias("period"), (F.col("o_custkey") % 30).alias("a"), (F.floor(F.col("o_custkey") / 30) % 30 + 30).alias("b"), (price % 4).alias("ga"), (F.floor(price / 4) % 4).alias("gb"))
    periods = sorted(r["period"] for r in m.select("period").distinct().collect())  # a few years
    return L.period_ratings(m, periods)


@query("win23_rating_replay")
def win23_exact(spark, sf_dir):
    """Ratings match by match within closed leagues; the tests replay them in Python."""
    o = table(spark, sf_dir, "orders")
    price = F.floor("o_totalprice").cast("long")
    m = o.select(F.col("o_orderpriority").alias("league"), seconds(F.col("o_orderdate")).alias("t"), F.col("o_orderkey").alias("id"), (F.col("o_custkey") % 30).alias("a"), (F.floor(F.col("o_custkey") / 30) % 30 + 30).alias("b"), (price % 4).alias("ga"), (F.floor(price / 4) % 4).alias("gb"))
    return L.replay_ratings(m)


@query("win13_prior_quality", f"WITH {CLOCKED_SQL}, d AS (SELECT match, t // 86400 AS day, sum(x) AS q FROM e GROUP BY ALL) SELECT match, day, avg(q) OVER (PARTITION BY match ORDER BY day RANGE BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS prior_quality FROM d")
def win13(spark, sf_dir):
    """Mean daily quality of strictly earlier days."""
    d = clocked(spark, sf_dir).groupBy("match", F.floor(F.col("t") / 86_400).alias("day")).agg(F.sum("x").alias("q"))
    return d.select("match", "day", F.avg("q").over(Window.partitionBy("match").orderBy("day").rangeBetween(Window.unboundedPreceding, -1)).alias("prior_quality"))


@query("win10_cut_possessions", f"""
    WITH {CLOCKED_SQL}, q AS (SELECT match, idx, t, kind, k % 2 AS team, (idx * 7 % 121) AS px FROM e WHERE t <= 1705276800), c AS (SELECT *, CASE WHEN team IS DISTINCT FROM lag(team) OVER w THEN 1 ELSE 0 END AS new FROM q WINDOW w AS (PARTITION BY match ORDER BY t, idx)),
    d AS (SELECT *, sum(new) OVER (PARTITION BY match ORDER BY t, idx ROWS UNBOUNDED PRECEDING) AS p FROM c)
    SELECT match, max(p)::BIGINT AS possessions, arg_max(team, (t, idx)) AS with_ball, count(DISTINCT p) FILTER (px >= 80) AS reached FROM d GROUP BY match""")
def win10(spark, sf_dir):
    """Possessions as they stood at a decision: regrouped from what was known, the last one cut."""
    from ..operators.process import with_possession

    q = clocked(spark, sf_dir).where("t <= 1705276800").select("match", "idx", "t", "kind", (F.col("k") % 2).alias("team"), (F.col("idx") * 7 % 121).alias("px"))
    d = with_possession(q)
    return d.groupBy("match").agg(F.max("possession").alias("possessions"), F.max_by("team", F.struct("t", "idx")).alias("with_ball"), F.count_distinct(F.when(F.col("px") >= 80, F.col("possession"))).alias("reached"))


# ---------------------------------------------------------------- folds and closed-form fits


@query("mod1_mod3_forward_folds", "WITH c AS (SELECT o_orderpriority AS comp, min(o_orderdate) AS first FROM orders GROUP BY 1), r AS (SELECT comp, dense_rank() OVER (ORDER BY first, comp) AS k FROM c) SELECT f.comp AS test_comp, count(*) AS train_n FROM r f JOIN r t ON t.k < f.k JOIN orders o ON o.o_orderpriority = t.comp GROUP BY f.comp")
def mod3(spark, sf_dir):
    """Folds in the order of first dates: how many training rows each test competition has."""
    o = table(spark, sf_dir, "orders")
    f = L.forward_folds(o, "o_orderpriority", "o_orderdate")
    n = o.groupBy(F.col("o_orderpriority").alias("train_comp")).agg(F.count("*").alias("n"))
    return f.join(n, "train_comp").groupBy("test_comp").agg(F.sum("n").alias("train_n"))


@query("mod4_loco_ridge", """
    WITH x AS (SELECT l_returnflag || l_linestatus AS comp, l_quantity / 50 AS x, l_extendedprice / 100000 AS y FROM lineitem), s AS (SELECT comp, count(*) AS n, sum(x) AS sx, sum(y) AS sy, sum(x * x) AS sxx, sum(x * y) AS sxy FROM x GROUP BY comp),
    h AS (SELECT s.comp, (sum(s.n) OVER () - s.n) AS n, (sum(s.sx) OVER () - s.sx) AS sx, (sum(s.sy) OVER () - s.sy) AS sy, (sum(s.sxx) OVER () - s.sxx) AS sxx, (sum(s.sxy) OVER () - s.sxy) AS sxy FROM s)
    SELECT comp AS held, ((n * sxy - sx * sy) / (n * (sxx + 1) - sx * sx)) AS slope, (sy - sx * (n * sxy - sx * sy) / (n * (sxx + 1) - sx * sx)) / n AS intercept FROM h""")
def mod4(spark, sf_dir):
    """MOD4 and MOD12: a ridge line for each held-out competition from total less held sums, no rows copied."""
    li = table(spark, sf_dir, "lineitem").select(F.concat("l_returnflag", "l_linestatus").alias("comp"), (F.col("l_quantity") / 50).alias("x"), (F.col("l_extendedprice") / 100_000).alias("y"))
    return L.loco_ridge(li, "comp", "x", "y", 1.0)


@query("mod8_fold_base_rates", "WITH g AS (SELECT o_orderpriority AS comp, count(*) AS n, count(*) FILTER (o_orderstatus = 'F') AS k FROM orders GROUP BY 1) SELECT comp AS held, (sum(k) OVER () - k) / (sum(n) OVER () - n) AS base_rate FROM g")
def mod8(spark, sf_dir):
    g = table(spark, sf_dir, "orders").groupBy(F.col("o_orderpriority").alias("held")).agg(F.count("*").alias("n"), F.count_if(F.col("o_orderstatus") == "F").alias("k"))
    every = Window.partitionBy(F.lit(1))
    return g.select("held", ((F.sum("k").over(every) - F.col("k")) / (F.sum("n").over(every) - F.col("n"))).alias("base_rate"))


@query("mod7_prequential", "SELECT o_orderkey, avg((o_orderstatus = 'F')::INT) OVER (PARTITION BY o_orderpriority ORDER BY o_orderdate RANGE BETWEEN UNBOUNDED PRECEDING AND INTERVAL 1 DAY PRECEDING) AS forecast FROM orders")
def mod7(spark, sf_dir):
    """Each row forecast by the rate of what came on earlier days; days are summed before the window."""
    o = table(spark, sf_dir, "orders").withColumn("day", F.floor(seconds(F.col("o_orderdate")) / 86_400))
    d = o.groupBy("o_orderpriority", "day").agg(F.count("*").alias("n"), F.count_if(F.col("o_orderstatus") == "F").alias("k"))
    w = Window.partitionBy("o_orderpriority").orderBy("day").rangeBetween(Window.unboundedPreceding, -1)
    d = d.select("o_orderpriority", "day", (F.sum("k").over(w) / F.sum("n").over(w)).alias("forecast"))
    return o.join(d, ["o_orderpriority", "day"]).select("o_orderkey", "forecast")


@query("mod14_temperature_grid", """
    WITH f AS (SELECT l_quantity / 100.0 + 0.05 AS ra, l_discount + 0.05 AS rd, l_tax + 0.1 AS rb, CASE l_returnflag WHEN 'A' THEN 'A' WHEN 'N' THEN 'D' ELSE 'B' END AS y FROM lineitem), p AS (SELECT ra / (ra + rd + rb) AS a, rd / (ra + rd + rb) AS d, rb / (ra + rd + rb) AS b, y FROM f), g AS (SELECT unnest([0.5, 1.0, 2.0, 4.0])::DOUBLE AS t),
    s AS (SELECT t, -ln(CASE y WHEN 'A' THEN pow(a, 1 / t) WHEN 'D' THEN pow(d, 1 / t) ELSE pow(b, 1 / t) END / (pow(a, 1 / t) + pow(d, 1 / t) + pow(b, 1 / t))) AS loss FROM p, g)
    SELECT t, avg(loss) AS loss FROM s GROUP BY t""")
def mod14(spark, sf_dir):
    """MOD14 and MOD18: the loss at each point of a grid, all points from one aggregate."""
    from .function_queries import forecasts

    f = forecasts(spark, sf_dir)
    p = (F.col("pa"), F.col("pd"), F.col("pb"))
    losses = f.agg(*(F.avg(P.log_loss(*P.temperature(t, *p), F.col("outcome"))).alias(str(i)) for i, t in enumerate((0.5, 1.0, 2.0, 4.0))))
    return losses.select(F.expr("stack(4, 0.5D, `0`, 1.0D, `1`, 2.0D, `2`, 4.0D, `3`) as (t, loss)"))


@query("mod11_impute_indicators", "WITH x AS (SELECT o_orderkey, CASE WHEN o_custkey % 4 > 0 THEN o_totalprice END AS v, o_orderkey % 5 > 0 AS train FROM orders), m AS (SELECT avg(v) FILTER (train) AS m FROM x) SELECT o_orderkey, coalesce(v, m) AS v, (v IS NULL)::INT AS v_missing FROM x, m")
def mod11(spark, sf_dir):
    """Means of the training rows fill gaps, and an indicator says where."""
    x = table(spark, sf_dir, "orders").select("o_orderkey", F.when(F.col("o_custkey") % 4 > 0, F.col("o_totalprice")).alias("v"), (F.col("o_orderkey") % 5 > 0).alias("train"))
    return L.impute(x, x.where("train"), ["v"]).select("o_orderkey", "v", "v_missing")


@query("mod22_promotion_verdict", "WITH g AS (SELECT o_orderpriority AS comp, avg(o_totalprice / 500000) AS cand, 0.5 AS ref FROM orders GROUP BY 1), s AS (SELECT avg(ref - cand) AS gain, avg((cand < ref)::INT) AS fold_share, count(*) AS folds FROM g) SELECT gain, fold_share, folds, CASE WHEN folds < 3 THEN 'too_few_folds' WHEN gain < 0.005 THEN 'no_gain' WHEN fold_share < 0.6 THEN 'not_steady' ELSE 'promote' END AS verdict FROM s")
def mod22(spark, sf_dir):
    g = table(spark, sf_dir, "orders").groupBy("o_orderpriority").agg(F.avg(F.col("o_totalprice") / 500_000).alias("cand")).withColumn("ref", F.lit(0.5))
    return L.verdict(g, "cand", "ref")
