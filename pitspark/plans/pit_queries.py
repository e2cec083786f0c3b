"""Queries of the point-in-time core."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..operators import pit
from ..sources.tables import CLOCKED_SQL, clocked, seconds, table
from .registry import Registry

DAY = 86_400
query = Registry()


@query("jon1_asof_backward", f"""
    WITH {CLOCKED_SQL}, p AS (SELECT match, idx, t FROM e WHERE kind = 'purchase'), c AS (SELECT match, t, max(x) AS x FROM e WHERE kind = 'click' GROUP BY match, t),
    j AS (SELECT p.match, p.idx, p.t, c.t AS ct, c.x AS cx FROM p ASOF LEFT JOIN c ON p.match = c.match AND p.t >= c.t)
    SELECT match, idx, t, CASE WHEN t - ct <= 86400 THEN ct END AS asof_t, CASE WHEN t - ct <= 86400 THEN cx END AS asof_x FROM j""")
def jon1(spark, sf_dir):
    """Each purchase with the latest click of its user at or before it, a day old at most; users are cut by week."""
    e = clocked(spark, sf_dir)
    p = e.where("kind = 'purchase'").select("match", "idx", "t")
    return pit.asof_join(p, e.where("kind = 'click'"), "match", "t", "t", ["x"], tolerance=DAY, bucket=7 * DAY)


@query("jon2_latest_before_decision", f"""
    WITH {CLOCKED_SQL}, d AS (SELECT match, min(t) AS decision FROM e WHERE kind = 'purchase' GROUP BY match)
    SELECT d.match, d.decision, max(e.t) AS t, arg_max(e.x, (e.t, e.x)) AS x FROM d LEFT JOIN e ON d.match = e.match AND e.kind = 'view' AND e.t <= d.decision GROUP BY ALL""")
def jon2(spark, sf_dir):
    e = clocked(spark, sf_dir)
    d = e.where("kind = 'purchase'").groupBy("match").agg(F.min("t").alias("decision"))
    views = e.where("kind = 'view'").select("match", "t", "x")
    return pit.latest_before(views, d, "match", "t", "decision", ["t", "x"])


@query("jon3_asof_strict_default", """
    WITH o AS (SELECT o_custkey, o_orderkey, epoch_us(o_orderdate) // 1000000 AS t, o_totalprice FROM orders), f AS (SELECT o_custkey, t, max(o_totalprice) AS p FROM o GROUP BY 1, 2)
    SELECT o.o_custkey, o.o_orderkey, o.t, coalesce(f.p, 1500.0) AS rating FROM o ASOF LEFT JOIN f ON o.o_custkey = f.o_custkey AND o.t > f.t""")
def jon3(spark, sf_dir):
    """The rating from the previous order of a customer, 1500 when there is none."""
    o = table(spark, sf_dir, "orders").select("o_custkey", "o_orderkey", seconds(F.col("o_orderdate")).alias("t"), "o_totalprice")
    found = pit.asof_join(o, o, "o_custkey", "t", "t", ["o_totalprice"], strict=True)
    return found.select("o_custkey", "o_orderkey", "t", F.coalesce("asof_o_totalprice", F.lit(1500.0)).alias("rating"))


@query("jon4_nearest_in_time", f"""
    WITH {CLOCKED_SQL}, g AS (SELECT p.match, p.idx, p.t, min((abs(r.t - p.t), r.idx)) AS best FROM e p LEFT JOIN e r ON p.match = r.match AND r.kind = 'error' AND abs(r.t - p.t) <= 7200 WHERE p.kind = 'purchase' GROUP BY ALL)
    SELECT g.match, g.idx, g.t, r.idx AS near_idx, abs(r.t - g.t) AS gap FROM g LEFT JOIN LATERAL (SELECT e.idx, e.t FROM e WHERE e.match = g.match AND e.kind = 'error' AND abs(e.t - g.t) <= 7200 ORDER BY abs(e.t - g.t), e.idx LIMIT 1) r ON true""")
def jon4(spark, sf_dir):
    e = clocked(spark, sf_dir)
    p = e.where("kind = 'purchase'").select("match", "idx", "t")
    return pit.nearest_in_time(p, e.where("kind = 'error'"), "match", "t", "t", "idx", 7200)


@query("jon4_unordered_pair_join", """
    WITH p AS (SELECT c_custkey AS a, c_custkey - c_custkey % 40 + (c_custkey + c_nationkey) % 40 AS b FROM customer)
    SELECT p.a, p.b, q.a AS other FROM p JOIN p q ON least(p.a, p.b) = least(q.a, q.b) AND greatest(p.a, p.b) = greatest(q.a, q.b)""")
def jon4_pairs(spark, sf_dir):
    """Fixtures in swapped orientation meet by their unordered pair."""
    a = F.col("c_custkey")
    p = table(spark, sf_dir, "customer").select(a.alias("a"), (a - a % 40 + (a + F.col("c_nationkey")) % 40).alias("b"))
    p = p.withColumn("pair", pit.unordered_pair(F.col("a"), F.col("b")))
    return p.join(p.select("pair", F.col("a").alias("other")), "pair").select("a", "b", "other")


SNAPSHOTS_SQL = """s AS (
    SELECT match, t, max(reason) AS reason FROM (
        SELECT match, unnest(range(CAST(ceil(lo / 21600.0) AS BIGINT) * 21600, hi + 1, 21600)) AS t, 'clock' AS reason FROM (SELECT match, min(t) AS lo, max(t) AS hi FROM e GROUP BY match)
        UNION ALL SELECT match, t, 'event' FROM e WHERE kind = 'purchase') GROUP BY match, t)"""


@query("win3_snapshot_schedule", f"WITH {CLOCKED_SQL}, {SNAPSHOTS_SQL} SELECT * FROM s")
def win3(spark, sf_dir):
    return pit.snapshot_schedule(clocked(spark, sf_dir), ["purchase"], 21_600)


PANEL_SQL = f"""
    WITH {CLOCKED_SQL}, {SNAPSHOTS_SQL}, j AS (SELECT s.match, s.t, s.reason, e.t AS et, e.kind, e.x, e.idx FROM s LEFT JOIN e ON s.match = e.match)
    SELECT match, t, reason,
        count(*) FILTER (et <= t AND kind = 'purchase') AS n_purchase, count(*) FILTER (et <= t AND kind = 'error') AS n_error,
        round(coalesce(sum(x) FILTER (et <= t), 0.0), 4) AS x_sum, coalesce(max(CASE WHEN et <= t AND x IS NOT NULL THEN 1 ELSE 0 END), 0) AS x_seen,
        count(*) FILTER (et <= t AND et > t - 3600) AS n_last_3600, count(*) FILTER (et <= t AND et > t - 86400) AS n_last_86400,
        t - max(et) FILTER (et <= t AND kind = 'purchase') AS since_goal, min(et) FILTER (et > t AND kind = 'purchase') - t AS next_goal,
        coalesce(max(CASE WHEN kind = 'purchase' AND et > t AND et <= t + 43200 THEN 1 ELSE 0 END), 0) AS goal_in_43200
    FROM j GROUP BY match, t, reason"""


@query("win_snapshot_panel", PANEL_SQL)
def panel(spark, sf_dir):
    """WIN4 to WIN9 and LAB2, LAB3: state so far and labels ahead at every snapshot, one shuffle."""
    e = clocked(spark, sf_dir)
    s = pit.snapshot_schedule(e, ["purchase"], 21_600)
    out = pit.state_at(e, s, ["purchase", "error"], [3600, DAY], "purchase", [43_200])
    return out.withColumn("x_sum", F.round("x_sum", 4))


@query("win11_panel_strict_cut", PANEL_SQL.replace("et <= t", "et < t").replace("et > t - 3600", "et >= t - 3600").replace("et > t - 86400", "et >= t - 86400").replace("min(et) FILTER (et > t ", "min(et) FILTER (et >= t ").replace("et > t AND et < t + 43200", "et >= t AND et < t + 43200"))
def panel_strict(spark, sf_dir):
    """The same with a strict cut: an event at the snapshot's clock lies ahead."""
    e = clocked(spark, sf_dir)
    s = pit.snapshot_schedule(e, ["purchase"], 21_600)
    rows = pit.state_at(e, s, ["purchase", "error"], [3600, DAY], "purchase", [43_200], strict=True)
    return rows.withColumn("x_sum", F.round("x_sum", 4))


@query("win2_strict_prior_state", """
    WITH o AS (SELECT o_custkey, o_orderkey, epoch_us(o_orderdate) // 1000000 AS t, (o_orderstatus = 'F')::INT AS win, o_totalprice FROM orders)
    SELECT o_custkey, o_orderkey, coalesce(sum(win) OVER w, 0)::BIGINT AS prior_wins, count(*) OVER w AS prior_n, round(coalesce(sum(o_totalprice) OVER w, 0), 2) AS prior_total
    FROM o WINDOW w AS (PARTITION BY o_custkey ORDER BY t RANGE BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)""")
def win2(spark, sf_dir):
    o = table(spark, sf_dir, "orders").withColumn("t", seconds(F.col("o_orderdate")))
    out = pit.prior_state(o, ["o_custkey"], "t", {"prior_wins": F.when(F.col("o_orderstatus") == "F", 1).otherwise(0), "prior_n": F.lit(1), "prior_total": F.col("o_totalprice")})
    return out.select("o_custkey", "o_orderkey", "prior_wins", "prior_n", F.round("prior_total", 2).alias("prior_total"))


@query("win1_pre_match_group_state", """
    WITH m AS (SELECT o_orderkey AS id, epoch_us(o_orderdate) // 1000000 AS t, o_orderpriority AS g, o_custkey % 20 AS a, o_custkey // 20 % 20 + 20 AS b, (floor(o_totalprice)::BIGINT % 4) AS ga, (floor(o_totalprice)::BIGINT // 4 % 4) AS gb FROM orders),
    r AS (SELECT id, t, g, a AS team, ga AS f, gb AS v FROM m UNION ALL SELECT id, t, g, b, gb, ga FROM m),
    p AS (SELECT id, team, coalesce(sum(CASE WHEN f > v THEN 3 WHEN f = v THEN 1 ELSE 0 END) OVER w, 0)::BIGINT AS points, coalesce(sum(f - v) OVER w, 0)::BIGINT AS gd, coalesce(sum(f) OVER w, 0)::BIGINT AS gf, count(*) OVER w AS played
        FROM r WINDOW w AS (PARTITION BY g, team ORDER BY t RANGE BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING))
    SELECT m.id, x.points AS points_a, y.points AS points_b, x.gd AS gd_a, y.gd AS gd_b, x.gf AS gf_a, y.gf AS gf_b, x.played AS played_a, y.played AS played_b,
        coalesce(sum((ga = gb)::INT) OVER w, 0)::BIGINT AS group_draws, coalesce(sum(ga + gb) OVER w, 0)::BIGINT AS group_goals
    FROM m JOIN p x ON x.id = m.id AND x.team = m.a JOIN p y ON y.id = m.id AND y.team = m.b WINDOW w AS (PARTITION BY g ORDER BY t RANGE BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)""")
def win1(spark, sf_dir):
    """Points, goal difference and goals of both teams before a match, and of its group; simultaneous matches do not see each other."""
    price = F.floor("o_totalprice").cast("long")
    m = table(spark, sf_dir, "orders").select(
        F.col("o_orderkey").alias("id"), seconds(F.col("o_orderdate")).alias("t"), F.col("o_orderpriority").alias("g"), (F.col("o_custkey") % 20).alias("a"),
        (F.floor(F.col("o_custkey") / 20) % 20 + 20).alias("b"), (price % 4).alias("ga"), (F.floor(price / 4) % 4).alias("gb"))
    sides = m.select("id", "t", "g", F.explode(F.array(F.struct(F.lit("a").alias("side"), F.col("a").alias("team"), F.col("ga").alias("f"), F.col("gb").alias("v")), F.struct(F.lit("b").alias("side"), F.col("b").alias("team"), F.col("gb").alias("f"), F.col("ga").alias("v")))).alias("s")).select("id", "t", "g", "s.*")
    points = F.when(F.col("f") > F.col("v"), 3).when(F.col("f") == F.col("v"), 1).otherwise(0)
    state = pit.prior_state(sides, ["g", "team"], "t", {"points": points, "gd": F.col("f") - F.col("v"), "gf": F.col("f"), "played": F.lit(1)})
    both = state.groupBy("id").agg(*(F.max(F.when(F.col("side") == s, F.col(c))).alias(f"{c}_{s}") for c in ("points", "gd", "gf", "played") for s in "ab"))
    # the group's sums: a group is few rows a day, so days are summed before the window
    days = m.groupBy("g", "t").agg(F.sum((F.col("ga") == F.col("gb")).cast("int")).alias("d"), F.sum(F.col("ga") + F.col("gb")).alias("s"))
    days = pit.prior_state(days, ["g"], "t", {"group_draws": F.col("d"), "group_goals": F.col("s")})
    return m.join(days.drop("d", "s"), ["g", "t"]).join(both, "id").select("id", *both.columns[1:], "group_draws", "group_goals")


@query("lab1_final_outcome", f"WITH {CLOCKED_SQL} SELECT match, count(*) FILTER (kind = 'purchase')::BIGINT AS h, count(*) FILTER (kind = 'error')::BIGINT AS a, CASE WHEN h > a THEN 'H' WHEN h = a THEN 'D' ELSE 'A' END AS outcome FROM e WHERE t <= 1705276800 GROUP BY match")
def lab1(spark, sf_dir):
    g = clocked(spark, sf_dir).where("t <= 1705276800").groupBy("match").agg(F.count_if(F.col("kind") == "purchase").alias("h"), F.count_if(F.col("kind") == "error").alias("a"))
    return g.withColumn("outcome", F.when(F.col("h") > F.col("a"), "H").when(F.col("h") == F.col("a"), "D").otherwise("A"))


@query("lab4_competing_risk", f"""
    WITH {CLOCKED_SQL}, {SNAPSHOTS_SQL}, z AS (SELECT match, max(t) AS fin FROM e GROUP BY match), j AS (SELECT s.match, s.t, z.fin, (SELECT min(e.t) FROM e WHERE e.match = s.match AND e.kind = 'purchase' AND e.t > s.t) - s.t AS next_goal FROM s JOIN z ON s.match = z.match)
    SELECT match, t, least(43200, fin - t) AS effective, CASE WHEN next_goal <= least(43200, fin - t) THEN 'goal' ELSE 'none' END AS risk, fin - t < 43200 AND coalesce(next_goal > fin - t, true) AS censored FROM j""")
def lab4(spark, sf_dir):
    e = clocked(spark, sf_dir)
    rows = pit.state_at(e, pit.snapshot_schedule(e, ["purchase"], 21_600), [], [], "purchase", []).select("match", "t", "next_goal")
    ends = e.groupBy("match").agg(F.max("t").alias("fin"))
    return pit.competing_risk(rows.join(ends, "match"), 43_200, F.col("fin")).select("match", "t", F.col("effective").cast("long").alias("effective"), "risk", "censored")


@query("lab5_remaining_goals", f"WITH {CLOCKED_SQL}, {SNAPSHOTS_SQL} SELECT s.match, s.t, count(e.idx) FILTER (e.kind = 'purchase') AS remaining, coalesce(max((e.kind = 'error')::INT), 0) AS error_after FROM s LEFT JOIN e ON s.match = e.match AND e.t > s.t GROUP BY ALL")
def lab5(spark, sf_dir):
    """Goals still to come, and whether an error follows: the final state less the state at t."""
    e = clocked(spark, sf_dir)
    s = pit.state_at(e, pit.snapshot_schedule(e, ["purchase"], 21_600), ["purchase", "error"], [], "purchase", [])
    final = e.groupBy("match").agg(F.count_if(F.col("kind") == "purchase").alias("all_p"), F.count_if(F.col("kind") == "error").alias("all_e"))
    return s.join(final, "match").select("match", "t", (F.col("all_p") - F.col("n_purchase")).alias("remaining"), (F.col("all_e") > F.col("n_error")).cast("int").alias("error_after"))


@query("win24_chronological", "WITH l AS (SELECT conv_id, length(text) < lag(length(text)) OVER (PARTITION BY conv_id ORDER BY turn) AS back FROM conversations) SELECT conv_id, count(*) FILTER (back)::BIGINT AS n FROM l GROUP BY conv_id")
def win24(spark, sf_dir):
    """How often the clock (here a turn's length) goes back within a conversation."""
    c = table(spark, sf_dir, "conversations").withColumn("len", F.length("text"))
    return pit.out_of_order(c, "conv_id", "turn", "len")


@query("win12_momentum", f"""
    WITH {CLOCKED_SQL}, {SNAPSHOTS_SQL}, j AS (SELECT s.match, s.t, e.t AS et, e.x FROM s LEFT JOIN e ON s.match = e.match AND e.t <= s.t)
    SELECT match, t, round(coalesce(sum(x) FILTER (et > t - 86400), 0), 4) AS last_day, round(coalesce(sum(x) FILTER (et > t - 172800 AND et <= t - 86400), 0), 4) AS day_before,
        round(coalesce(sum(x) FILTER (et > t - 86400), 0) - coalesce(sum(x) FILTER (et > t - 172800 AND et <= t - 86400), 0), 4) AS acceleration FROM j GROUP BY match, t""")
def win12(spark, sf_dir):
    """Rolling sums whose windows do not overlap: the last day against the day before."""
    e = clocked(spark, sf_dir)
    s = pit.snapshot_schedule(e, ["purchase"], 21_600)
    rows = e.select("match", "t", "x", F.lit(1).alias("tag")).unionByName(s.select("match", "t", F.lit(None).cast("double").alias("x"), F.lit(2).alias("tag")))
    by = Window.partitionBy("match").orderBy("t")
    last, before = F.coalesce(F.sum("x").over(by.rangeBetween(-DAY + 1, 0)), F.lit(0.0)), F.coalesce(F.sum("x").over(by.rangeBetween(-2 * DAY + 1, -DAY)), F.lit(0.0))
    out = rows.withColumns({"last_day": last, "day_before": before}).where("tag = 2")
    return out.select("match", "t", F.round("last_day", 4).alias("last_day"), F.round("day_before", 4).alias("day_before"), F.round(F.col("last_day") - F.col("day_before"), 4).alias("acceleration"))
