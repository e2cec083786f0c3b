"""Queries of selection, tie-breaks, sampling, set operations and reconciliation."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import probs as P
from ..operators import joins as J
from ..operators import reconcile as R
from ..operators import selection as S
from ..sources.tables import CLOCKED_SQL, clocked, seconds, table
from .function_queries import FORECAST_SQL, forecasts
from .registry import Registry

query = Registry()


@query("top1_complete_snapshot", f"""
    WITH {CLOCKED_SQL}, s AS (SELECT match, t // 86400 AS snap, list_distinct(list(kind) FILTER (x < 100)) AS have FROM e GROUP BY ALL)
    SELECT match, max(snap) FILTER (list_has_all(coalesce(have, []), ['view', 'click', 'purchase'])) AS snap, CASE WHEN max(snap) FILTER (list_has_all(coalesce(have, []), ['view', 'click', 'purchase'])) IS NULL THEN 'no_complete_snapshot' END AS reason FROM s GROUP BY match""")
def top1(spark, sf_dir):
    e = clocked(spark, sf_dir).withColumn("snap", F.floor(F.col("t") / 86_400))
    return S.complete_snapshot(e, "match", "snap", "kind", ["view", "click", "purchase"], F.col("x") < 100)


@query("top2_window_priority", "WITH r AS (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY CASE o_orderpriority WHEN '1-URGENT' THEN 0 WHEN '2-HIGH' THEN 1 ELSE 2 END, o_orderdate DESC, o_orderkey) AS rn FROM orders) SELECT o_custkey, o_orderkey FROM r WHERE rn = 1")
def top2(spark, sf_dir):
    rank = F.when(F.col("o_orderpriority") == "1-URGENT", 0).when(F.col("o_orderpriority") == "2-HIGH", 1).otherwise(2)
    return S.first_by(table(spark, sf_dir, "orders"), ["o_custkey"], rank, F.desc("o_orderdate"), F.col("o_orderkey")).select("o_custkey", "o_orderkey")


SIDES_SQL = """m AS (SELECT o_orderkey AS id, o_orderkey // 20 AS g, o_custkey % 4 AS a, (o_custkey % 4 + 1 + o_orderkey % 3) % 4 AS b, floor(o_totalprice)::BIGINT % 3 AS ga, floor(o_totalprice)::BIGINT // 3 % 3 AS gb FROM orders),
    sd AS (SELECT g, a AS team, b AS opponent, ga AS scored, gb AS conceded FROM m UNION ALL SELECT g, b, a, gb, ga FROM m)"""


def sides(spark, sf_dir):
    """Matches of groups of four teams, twenty orders a group, a row for each side."""
    price = F.floor("o_totalprice").cast("long")
    m = table(spark, sf_dir, "orders").select(
        F.floor(F.col("o_orderkey") / 20).alias("g"), (F.col("o_custkey") % 4).alias("a"), ((F.col("o_custkey") % 4 + 1 + F.col("o_orderkey") % 3) % 4).alias("b"), (price % 3).alias("ga"), (F.floor(price / 3) % 3).alias("gb"))
    names = ["g", "team", "opponent", "scored", "conceded"]
    return m.select("g", "a", "b", "ga", "gb").toDF(*names).unionByName(m.select("g", "b", "a", "gb", "ga").toDF(*names))


TABLE_SQL = f"""{SIDES_SQL}, tb AS (SELECT g, team, sum(CASE WHEN scored > conceded THEN 3 WHEN scored = conceded THEN 1 ELSE 0 END)::BIGINT AS points, sum(scored - conceded)::BIGINT AS gd, sum(scored)::BIGINT AS gf FROM sd GROUP BY ALL),
    pl AS (SELECT *, row_number() OVER (PARTITION BY g ORDER BY points DESC, gd DESC, gf DESC, team) AS place FROM tb)"""


@query("top3_group_tables", f"WITH {TABLE_SQL} SELECT g, team, points, gd, gf, place FROM pl")
def top3(spark, sf_dir):
    return S.group_table(sides(spark, sf_dir), "g", "team", "scored", "conceded")


@query("top3_best_thirds", f"WITH {TABLE_SQL} SELECT g, team, points FROM pl WHERE place = 3 ORDER BY points DESC, gd DESC, gf DESC, g LIMIT 8")
def top3_thirds(spark, sf_dir):
    """The eight best third-placed teams of all groups."""
    return top3(spark, sf_dir).where("place = 3").orderBy(F.desc("points"), F.desc("gd"), F.desc("gf"), "g").limit(8).select("g", "team", "points")


def _h2h_round(i: int) -> str:
    return f"""x{i} AS (SELECT r.g, r.team, sum(CASE WHEN sd.scored > sd.conceded THEN 3 WHEN sd.scored = sd.conceded THEN 1 ELSE 0 END) AS p, sum(sd.scored - sd.conceded) AS d, sum(sd.scored) AS f FROM r{i - 1} r JOIN sd ON sd.g = r.g AND sd.team = r.team JOIN r{i - 1} o ON o.g = r.g AND o.team = sd.opponent AND o.block = r.block GROUP BY ALL),
    r{i} AS (SELECT r.g, r.team, r.points, r.gd, r.gf, dense_rank() OVER (PARTITION BY r.g ORDER BY r.block, coalesce(x.p, 0) DESC, coalesce(x.d, 0) DESC, coalesce(x.f, 0) DESC) AS block FROM r{i - 1} r LEFT JOIN x{i} x ON x.g = r.g AND x.team = r.team)"""


@query("top4_head_to_head", f"WITH {TABLE_SQL}, r0 AS (SELECT g, team, points, gd, gf, dense_rank() OVER (PARTITION BY g ORDER BY points DESC) AS block FROM tb), {_h2h_round(1)}, {_h2h_round(2)}, {_h2h_round(3)} SELECT g, team, points, row_number() OVER (PARTITION BY g ORDER BY block, gd DESC, gf DESC, team) AS place FROM r3")
def top4(spark, sf_dir):
    s = sides(spark, sf_dir)
    return S.head_to_head(s, S.group_table(s, "g", "team", "scored", "conceded").drop("place"), "g", "team").select("g", "team", "points", "place")


@query("top5_seeded_sample", "WITH r AS (SELECT c_custkey, c_mktsegment, row_number() OVER (PARTITION BY c_mktsegment ORDER BY sha256('s1:' || c_custkey::VARCHAR)) AS rn FROM customer) SELECT c_custkey, c_mktsegment FROM r WHERE rn <= 20")
def top5(spark, sf_dir):
    return S.seeded_sample(table(spark, sf_dir, "customer"), "c_mktsegment", "c_custkey", 20, "s1").select("c_custkey", "c_mktsegment")


@query("top6_even_allocation", """
    WITH a AS (SELECT *, row_number() OVER (PARTITION BY c_nationkey ORDER BY c_custkey) AS r FROM customer), b AS (SELECT *, row_number() OVER (PARTITION BY c_mktsegment ORDER BY r, c_nationkey, c_custkey) AS l FROM a WHERE r <= 6)
    SELECT c_custkey, c_nationkey FROM b WHERE l <= 25 ORDER BY r, c_nationkey, c_custkey LIMIT 100""")
def top6(spark, sf_dir):
    return S.even_allocation(table(spark, sf_dir, "customer"), "c_nationkey", "c_mktsegment", ["c_custkey"], 6, 25, 100).select("c_custkey", "c_nationkey")


@query("top7_edge_scan", f"WITH {FORECAST_SQL} SELECT l_orderkey, l_linenumber, pd - 0.28 AS edge, pd - 0.28 >= 0.05 AS flag FROM p WHERE pd - 0.28 >= 0.03")
def top7(spark, sf_dir):
    f = forecasts(spark, sf_dir).withColumn("edge", F.col("pd") - 0.28)
    return f.where("edge >= 0.03").withColumn("flag", F.col("edge") >= 0.05).orderBy(F.desc("edge")).select("l_orderkey", "l_linenumber", "edge", "flag")


@query("top8_widest_threshold", """
    WITH s AS (SELECT lang, n_chars, count(*) AS n, count(*) FILTER (quality = 1) AS k FROM documents JOIN labels USING (doc_id) GROUP BY ALL), c AS (SELECT lang, n_chars, sum(n) OVER w AS n, sum(k) OVER w AS k FROM s WINDOW w AS (PARTITION BY lang ORDER BY n_chars DESC ROWS UNBOUNDED PRECEDING))
    SELECT lang, min(n_chars) FILTER (n >= 10 AND k >= 0.85 * n) AS threshold, (max(n) FILTER (n >= 10 AND k >= 0.85 * n))::BIGINT AS n FROM c GROUP BY lang""")
def top8(spark, sf_dir):
    j = table(spark, sf_dir, "documents").join(table(spark, sf_dir, "labels"), "doc_id")
    return S.widest_threshold(j, "lang", "n_chars", F.col("quality") == 1, 0.85, 10)


@query("top9_most_likely_class", f"WITH {FORECAST_SQL} SELECT l_orderkey, l_linenumber, CASE WHEN pa >= pd AND pa >= pb THEN 'A' WHEN pd >= pb THEN 'D' ELSE 'B' END AS label FROM p")
def top9(spark, sf_dir):
    p = F.array("pa", "pd", "pb")
    label = F.element_at(F.array(F.lit("A"), F.lit("D"), F.lit("B")), F.array_position(p, F.array_max(p)).cast("int"))
    return forecasts(spark, sf_dir).select("l_orderkey", "l_linenumber", label.alias("label"))


@query("set1_union_missing_columns", "SELECT s_suppkey AS id, s_name AS name, s_acctbal AS balance, NULL AS segment FROM supplier UNION ALL SELECT c_custkey, c_name, c_acctbal, c_mktsegment FROM customer")
def set1(spark, sf_dir):
    s = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("id"), F.col("s_name").alias("name"), F.col("s_acctbal").alias("balance"))
    c = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id"), F.col("c_name").alias("name"), F.col("c_acctbal").alias("balance"), F.col("c_mktsegment").alias("segment"))
    return s.unionByName(c, allowMissingColumns=True)


@query("set2_dedupe_first", f"WITH {CLOCKED_SQL}, r AS (SELECT *, row_number() OVER (PARTITION BY match, kind, t // 3600 ORDER BY idx) AS rn FROM e) SELECT match, kind, idx FROM r WHERE rn = 1")
def set2(spark, sf_dir):
    e = clocked(spark, sf_dir).withColumn("hour", F.floor(F.col("t") / 3600))
    return S.first_by(e, ["match", "kind", "hour"], F.col("idx")).select("match", "kind", "idx")


@query("set3_corrections", f"WITH {CLOCKED_SQL}, v AS (SELECT *, match * 1000 + k AS key FROM e), r AS (SELECT *, row_number() OVER (PARTITION BY key ORDER BY idx DESC) AS rn FROM v) SELECT key, idx, x FROM r WHERE rn = 1 AND kind <> 'signup'")
def set3(spark, sf_dir):
    """The latest version of an event counts; a retraction (signup) takes it away."""
    v = clocked(spark, sf_dir).withColumns({"key": F.col("match") * 1000 + F.col("k"), "action": F.when(F.col("kind") == "signup", "retract").otherwise("keep")})
    return S.apply_corrections(v, "key", "idx", "action").select("key", "idx", "x")


@query("set4_upsert", "SELECT c_custkey, CASE WHEN c_custkey % 10 = 0 THEN c_acctbal + 1 ELSE c_acctbal END AS c_acctbal FROM customer UNION ALL SELECT c_custkey + 1000000, c_acctbal FROM customer WHERE c_custkey % 100 = 0")
def set4(spark, sf_dir):
    base = table(spark, sf_dir, "customer").select("c_custkey", "c_acctbal")
    new = base.where("c_custkey % 100 = 0").withColumn("c_custkey", F.col("c_custkey") + 1_000_000)
    updates = base.where("c_custkey % 10 = 0").withColumn("c_acctbal", F.col("c_acctbal") + 1).unionByName(new)
    return S.upsert(base, updates, "c_custkey")


@query("set5_anchor_clusters", f"""
    WITH RECURSIVE {CLOCKED_SQL}, g AS (SELECT match, idx, t // 60 AS minute FROM e WHERE kind = 'purchase'),
    a AS (SELECT match, min(minute) AS anchor FROM g GROUP BY match UNION ALL SELECT match, n FROM (SELECT a.match, a.anchor, min(g.minute) AS n FROM a JOIN g ON g.match = a.match AND g.minute > a.anchor + 1440 GROUP BY a.match, a.anchor)),
    c AS (SELECT g.*, max(a.anchor) AS anchor FROM g JOIN a ON a.match = g.match AND a.anchor <= g.minute GROUP BY ALL)
    SELECT match, (row_number() OVER (PARTITION BY match ORDER BY anchor))::INT AS cluster, count(*) AS n, anchor::BIGINT AS anchor, CASE WHEN min(idx % 2) <> max(idx % 2) THEN 'agreed' ELSE 'single_source' END AS status FROM c GROUP BY match, anchor""")
def set5(spark, sf_dir):
    """Events of two sources within a day of a cluster's first one are the same."""
    e = clocked(spark, sf_dir).where("kind = 'purchase'").withColumn("minute", F.floor(F.col("t") / 60))
    c = S.anchor_clusters(e, ["match"], "minute", "idx", 1440)
    g = c.groupBy("match", "cluster").agg(F.count("*").alias("n"), F.min("minute").alias("anchor"), F.max(F.col("idx") % 2).alias("b"), F.min(F.col("idx") % 2).alias("a"))
    return g.withColumn("status", F.when(F.col("a") != F.col("b"), "agreed").otherwise("single_source")).drop("a", "b")


@query("set5_reconciled_events", f"""
    WITH RECURSIVE {CLOCKED_SQL}, r AS (SELECT match, CASE kind WHEN 'purchase' THEN 'goal' WHEN 'error' THEN 'red_card' WHEN 'signup' THEN 'substitution' ELSE 'corner' END AS kind, k % 2 AS team, t // 60 AS minute, idx,
        CASE idx % 3 WHEN 0 THEN 'official_feed' WHEN 1 THEN 'api_football' ELSE 'blog' END AS source, CASE idx % 3 WHEN 0 THEN 1 WHEN 1 THEN 2 ELSE 9 END AS rk, CASE WHEN idx % 10 = 0 THEN idx // 40 END AS pid, CASE WHEN idx % 4 > 0 THEN k % 3 END AS player FROM e),
    f AS (SELECT *, CASE WHEN pid IS NULL THEN minute ELSE min(minute) OVER (PARTITION BY match, kind, team, pid) END AS pos FROM r), g AS (SELECT DISTINCT match, kind, team, pos FROM f),
    a AS (SELECT match, kind, team, min(pos) AS anchor FROM g GROUP BY ALL UNION ALL SELECT match, kind, team, n FROM (SELECT a.match, a.kind, a.team, a.anchor, min(g.pos) AS n FROM a JOIN g ON g.match = a.match AND g.kind = a.kind AND g.team = a.team AND g.pos > a.anchor + 600 GROUP BY ALL)),
    d AS (SELECT g.match, g.kind, g.team, g.pos, max(a.anchor) AS anchor FROM g JOIN a ON a.match = g.match AND a.kind = g.kind AND a.team = g.team AND a.anchor <= g.pos GROUP BY ALL),
    c AS (SELECT match, kind, team, anchor, count(*) AS versions, count(DISTINCT source) AS sources, min(rk) AS rk, arg_min(source, (rk, source)) AS best, count(DISTINCT minute) AS minutes, count(DISTINCT player) AS players FROM f JOIN d USING (match, kind, team, pos) GROUP BY ALL)
    SELECT match, kind AS event_type, team, anchor, versions, sources, best AS canonical_source, CASE WHEN bad THEN 'unresolved' WHEN sources >= 2 THEN 'reconciled' ELSE 'single_source' END AS status,
        CASE WHEN bad THEN 'low' WHEN sources >= 2 THEN 'high' WHEN rk <= 2 THEN 'medium' ELSE 'low' END AS confidence, (minutes > 1)::INT + bad::INT AS disagreements, NOT (kind <> 'corner' AND bad) AS eligible
    FROM (SELECT *, kind IN ('goal', 'red_card') AND players > 1 AS bad FROM c)""")
def set5_reconciled(spark, sf_dir):
    """Candidates of three sources as canonical events, with what they disagree on; provider ids that come back join their first event."""
    i, k = F.col("idx"), F.col("k")
    kind = F.when(F.col("kind") == "purchase", "goal").when(F.col("kind") == "error", "red_card").when(F.col("kind") == "signup", "substitution").otherwise("corner")
    source = F.when(i % 3 == 0, "official_feed").when(i % 3 == 1, "api_football").otherwise("blog")
    c = clocked(spark, sf_dir).select(
        F.col("match").alias("match_id"), kind.alias("event_type"), (k % 2).alias("team_id"), F.floor(F.col("t") / 60).alias("minute"), source.alias("source_name"), F.when(i % 10 == 0, F.floor(i / 40)).alias("provider_event_id"),
        F.when(i % 4 > 0, k % 3).alias("player_id"), F.lit(None).cast("map<string,string>").alias("attrs"))
    clusters, raw = R.reconcile_events(c, tolerance=600)
    n = raw.groupBy(*R.GROUP, "anchor").agg(F.count("*").alias("versions"))
    out = clusters.join(n, [*R.GROUP, "anchor"])
    return out.select(
        F.col("match_id").alias("match"), "event_type", F.col("team_id").alias("team"), "anchor", "versions", F.size("contributing_sources").cast("long").alias("sources"), "canonical_source", F.col("reconciliation_status").alias("status"),
        F.col("source_confidence").alias("confidence"), F.size("provider_disagreement").alias("disagreements"), F.col("approved_feature_eligible").alias("eligible"))


@query("set6_score_reconcile", """
    WITH e AS (SELECT l_orderkey AS match, CASE WHEN l_suppkey % 2 = 0 THEN 'home' ELSE 'away' END AS side, CASE WHEN l_returnflag = 'A' THEN 'goal' WHEN l_returnflag = 'R' AND l_linenumber % 3 = 0 THEN 'own_goal' WHEN l_returnflag = 'R' AND l_linenumber % 3 = 1 THEN 'penalty_scored' ELSE 'other' END AS kind, l_linenumber >= 6 AS shootout FROM lineitem),
    d AS (SELECT match, count(*) FILTER (NOT shootout AND (kind IN ('goal', 'penalty_scored') AND side = 'home' OR kind = 'own_goal' AND side = 'away')) AS h, count(*) FILTER (NOT shootout AND (kind IN ('goal', 'penalty_scored') AND side = 'away' OR kind = 'own_goal' AND side = 'home')) AS a FROM e GROUP BY match),
    r AS (SELECT o_orderkey AS match, floor(o_totalprice)::BIGINT % 3 AS home, floor(o_totalprice)::BIGINT // 3 % 3 AS away, CASE WHEN o_custkey % 4 = 0 THEN 3::BIGINT END AS ph, CASE WHEN o_custkey % 8 = 0 THEN o_orderkey % 3 END AS pa FROM orders)
    SELECT r.match, home, away, coalesce(h, 0) AS derived_home, coalesce(a, 0) AS derived_away, CASE WHEN ph IS NOT NULL OR pa IS NOT NULL THEN coalesce(ph, 0) END AS shootout_home, CASE WHEN ph IS NOT NULL OR pa IS NOT NULL THEN coalesce(pa, 0) END AS shootout_away,
        coalesce(h, 0) = home AND coalesce(a, 0) = away AS exact, CASE WHEN coalesce(h, 0) = home AND coalesce(a, 0) = away THEN 'ok' ELSE 'exception' END AS status FROM r LEFT JOIN d ON d.match = r.match""")
def set6(spark, sf_dir):
    """PRJ13 and SET6: the score from one source's events against what another reports; own goals turned, shoot-outs apart."""
    n, flag, price = F.col("l_linenumber"), F.col("l_returnflag"), F.floor("o_totalprice").cast("long")
    kind = F.when(flag == "A", "goal").when((flag == "R") & (n % 3 == 0), "own_goal").when((flag == "R") & (n % 3 == 1), "penalty_scored").otherwise("other")
    e = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("match"), F.when(F.col("l_suppkey") % 2 == 0, "home").otherwise("away").alias("side"), kind.alias("kind"), (n >= 6).alias("shootout"))
    c, k = F.col("o_custkey"), F.col("o_orderkey")
    r = table(spark, sf_dir, "orders").select(k.alias("match"), (price % 3).alias("home"), (F.floor(price / 3) % 3).alias("away"), F.when(c % 4 == 0, F.lit(3).cast("long")).alias("pen_home"), F.when(c % 8 == 0, k % 3).alias("pen_away"))
    return S.reconcile_scores(e, r)


@query("prj14_exception_class", f"""
    WITH {CLOCKED_SQL}, l AS (SELECT *, t < lag(t) OVER (PARTITION BY match ORDER BY idx) AS back FROM e), f AS (SELECT match, count(*) - count(DISTINCT (kind, t // 3600)) AS dups, coalesce(bool_or(back), false) AS back, bool_or(x > 300) AS large FROM l GROUP BY match)
    SELECT match, CASE WHEN back THEN 'out_of_order' WHEN dups > 1 THEN 'duplicates' WHEN large THEN 'out_of_range' ELSE 'none' END AS exception FROM f""")
def prj14(spark, sf_dir):
    e = clocked(spark, sf_dir).withColumn("back", F.col("t") < F.lag("t").over(Window.partitionBy("match").orderBy("idx")))
    f = e.groupBy("match").agg((F.count("*") - F.count_distinct(F.struct("kind", F.floor(F.col("t") / 3600)))).alias("dups"), F.coalesce(F.bool_or("back"), F.lit(False)).alias("back"), F.bool_or(F.col("x") > 300).alias("large"))
    return f.select("match", F.when(F.col("back"), "out_of_order").when(F.col("dups") > 1, "duplicates").when(F.col("large"), "out_of_range").otherwise("none").alias("exception"))


@query("set7_integrity", f"WITH {FORECAST_SQL} SELECT unnest(['sum_one', 'in_range', 'draw_floor']) AS \"check\", unnest([count(*) FILTER (abs(pa + pd + pb - 1) > 1e-9), count(*) FILTER (least(pa, pd, pb) < 0), count(*) FILTER (pd < 0.08)]) AS violations FROM p")
def set7(spark, sf_dir):
    checks = [("sum_one", F.abs(F.col("pa") + F.col("pd") + F.col("pb") - 1) <= 1e-9), ("in_range", F.least("pa", "pd", "pb") >= 0), ("draw_floor", F.col("pd") >= 0.08)]
    return S.integrity(forecasts(spark, sf_dir), checks)


@query("set7_duplicate_keys", "SELECT l_orderkey, l_linenumber, count(*) AS n FROM lineitem GROUP BY ALL HAVING count(*) > 1")
def set7_keys(spark, sf_dir):
    return S.duplicate_keys(table(spark, sf_dir, "lineitem"), ["l_orderkey", "l_linenumber"])


@query("set8_disagreements", "WITH g AS (SELECT o_custkey AS key, count(DISTINCT o_orderstatus) AS st, count(DISTINCT o_orderpriority) AS pr FROM orders GROUP BY 1) SELECT key, 'st' AS field, st AS n FROM g WHERE st > 1 UNION ALL SELECT key, 'pr', pr FROM g WHERE pr > 1")
def set8(spark, sf_dir):
    o = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("key"), F.col("o_orderstatus").alias("st"), F.col("o_orderpriority").alias("pr"))
    return S.disagreements(o, "key", ["st", "pr"])


@query("set9_no_future_in_state", f"""
    WITH {CLOCKED_SQL}, k AS (SELECT * FROM e WHERE t <= 1705320000), a AS (SELECT match, count(*) FILTER (kind = 'purchase' AND t <= 1705320000) AS n, coalesce(max((x IS NOT NULL AND t <= 1705320000)::INT), 0) AS seen, max(t) FILTER (kind = 'purchase' AND t <= 1705320000) AS goal FROM e GROUP BY match),
    b AS (SELECT m.match, count(k.idx) FILTER (k.kind = 'purchase') AS n, coalesce(max((k.x IS NOT NULL)::INT), 0) AS seen, max(k.t) FILTER (k.kind = 'purchase') AS goal FROM (SELECT DISTINCT match FROM e) m LEFT JOIN k ON k.match = m.match GROUP BY m.match)
    SELECT count(*) AS rows, count(*) FILTER (a.n IS DISTINCT FROM b.n OR a.seen IS DISTINCT FROM b.seen OR a.goal IS DISTINCT FROM b.goal) AS differences, sum(a.n)::BIGINT AS purchases FROM a FULL JOIN b ON a.match = b.match""")
def set9(spark, sf_dir):
    """State at midday of day 15 from all events and from those known by then: matches, those in which they differ, and purchases by then."""
    from ..operators import pit

    e = clocked(spark, sf_dir)
    cut = 1_705_320_000
    s = e.select("match").distinct().select("match", F.lit(cut).cast("long").alias("t"), F.lit("clock").alias("reason"))
    known = ["match", "n_purchase", "x_seen", "since_goal"]
    a = pit.state_at(e, s, ["purchase"], [], "purchase", []).select(known)
    b = pit.state_at(e.where(F.col("t") <= cut), s, ["purchase"], [], "purchase", []).select(known)
    both = a.withColumnsRenamed({c: f"a_{c}" for c in known[1:]}).join(b, "match", "full_outer")
    same = [F.col(f"a_{c}").eqNullSafe(F.col(c)) for c in known[1:]]
    return both.agg(F.count("*").alias("rows"), F.count_if(~(same[0] & same[1] & same[2])).alias("differences"), F.sum("a_n_purchase").alias("purchases"))


# ---------------------------------------------------------------- joins of sources


@query("jon5_strict_bridge", """
    WITH a AS (SELECT 2 * o_orderkey AS id, o_orderdate AS d, o_custkey % 10 AS h, o_custkey % 9 + 10 AS v, floor(o_totalprice)::BIGINT % 5 AS s FROM orders),
    b AS (SELECT 2 * o_orderkey + 1 AS id, o_orderdate AS d, o_custkey % 9 + 10 AS h, o_custkey % 10 AS v, floor(o_totalprice)::BIGINT % 5 + (o_orderkey % 7 = 0)::INT AS s FROM orders),
    j AS (SELECT a.id AS a, b.id AS b, a.s = b.s AS same, count(*) OVER (PARTITION BY a.id) AS na, count(*) OVER (PARTITION BY b.id) AS nb FROM a LEFT JOIN b ON a.d = b.d AND least(a.h, a.v) = least(b.h, b.v) AND greatest(a.h, a.v) = greatest(b.h, b.v))
    SELECT a, min(CASE WHEN b IS NULL THEN 'no_partner' WHEN na > 1 OR nb > 1 THEN 'ambiguous' WHEN NOT same THEN 'score_differs' ELSE 'matched' END) AS status FROM j GROUP BY a""")
def jon5(spark, sf_dir):
    """Fixtures of two sources by date and unordered pair, one to one; else the reason why not."""
    o = table(spark, sf_dir, "orders")
    s = F.floor("o_totalprice") % 5
    a = o.select((2 * F.col("o_orderkey")).alias("id"), F.col("o_orderdate").alias("d"), F.array_sort(F.array(F.col("o_custkey") % 10, F.col("o_custkey") % 9 + 10)).alias("pair"), s.alias("s"))
    b = o.select((2 * F.col("o_orderkey") + 1).alias("id"), F.col("o_orderdate").alias("d"), F.array_sort(F.array(F.col("o_custkey") % 10, F.col("o_custkey") % 9 + 10)).alias("pair"), (s + (F.col("o_orderkey") % 7 == 0).cast("int")).alias("s"))
    return J.bridge(a, b, ["d", "pair"], "id", "s").select("a", "status")


@query("jon6_mapping_cascade", r"""
    WITH l AS (SELECT c_custkey AS id, c_name AS name FROM customer), r AS (SELECT c_custkey + 5000 AS rid, CASE WHEN c_custkey % 3 = 0 THEN upper(c_name) WHEN c_custkey % 3 = 1 THEN c_name ELSE c_name || ' x' END AS rname FROM customer),
    n AS (SELECT lower(rname) AS nn, min(rid) AS rid, count(*) AS c FROM r GROUP BY 1)
    SELECT l.id, CASE WHEN e.rid IS NOT NULL THEN e.rid WHEN n.c = 1 THEN n.rid END AS rid, CASE WHEN e.rid IS NOT NULL THEN 'exact' WHEN n.c = 1 THEN 'normalised' WHEN n.c > 1 THEN 'ambiguous' ELSE 'missing' END AS how FROM l LEFT JOIN r e ON e.rname = l.name LEFT JOIN n ON n.nn = lower(l.name)""")
def jon6(spark, sf_dir):
    c = table(spark, sf_dir, "customer")
    left = c.select(F.col("c_custkey").alias("id"), F.col("c_name").alias("name"))
    k = F.col("c_custkey") % 3
    right = c.select((F.col("c_custkey") + 5000).alias("rid"), F.when(k == 0, F.upper("c_name")).when(k == 1, F.col("c_name")).otherwise(F.concat("c_name", F.lit(" x"))).alias("rname"))
    return J.mapping_cascade(left, right, "id", "name", "rid", "rname").select("id", "rid", "how")


@query("jon7_band_join", f"""
    WITH {CLOCKED_SQL} SELECT a.match, a.idx, count(b.idx) AS hits, arg_min(b.idx, (abs(b.t - a.t), b.idx)) AS nearest FROM e a LEFT JOIN e b ON b.match = a.match AND b.kind = 'view' AND abs(b.t - a.t) <= 3600 WHERE a.kind = 'purchase' GROUP BY ALL""")
def jon7(spark, sf_dir):
    """Purchases with the views within an hour: how many and the nearest, by buckets as wide as the band."""
    e = clocked(spark, sf_dir)
    p = e.where("kind = 'purchase'").select("match", "idx", "t")
    return J.band_join(p, e.where("kind = 'view'").select("match", F.col("idx").alias("other"), F.col("t").alias("ot")), ["match"], "t", "ot", "other", 3600).select("match", "idx", "hits", "nearest")


@query("jon8_median_offset", f"WITH {CLOCKED_SQL} SELECT a.match % 2 AS fold, median(b.t - a.t)::DOUBLE AS offset_s, count(*) AS n FROM e a JOIN e b ON b.match = a.match AND b.kind = 'view' AND abs(b.t - a.t) <= 3600 WHERE a.kind = 'purchase' GROUP BY 1")
def jon8(spark, sf_dir):
    """The median offset on each fold of the matches, to be used on the other."""
    e = clocked(spark, sf_dir)
    pairs = J.band_pairs(e.where("kind = 'purchase'").select("match", "t"), e.where("kind = 'view'").select("match", F.col("t").alias("ot")), ["match"], "t", "ot", 3600)
    return pairs.groupBy((F.col("match") % 2).alias("fold")).agg(F.percentile((F.col("ot") - F.col("t")).cast("double"), F.lit(0.5)).alias("offset_s"), F.count("*").alias("n"))


@query("jon9_cross_provider", f"""
    WITH {CLOCKED_SQL}, a AS (SELECT match, idx, t, x FROM e WHERE kind = 'click' AND idx % 2 = 0), b AS (SELECT match, idx, t, x FROM e WHERE kind = 'click' AND idx % 2 = 1),
    j AS (SELECT a.match, a.idx AS ia, b.idx AS ib, abs(a.x - b.x) < 20 AS agree, row_number() OVER (PARTITION BY a.idx ORDER BY abs(a.t - b.t), b.idx) AS ra, row_number() OVER (PARTITION BY b.idx ORDER BY abs(a.t - b.t), a.idx) AS rb FROM a JOIN b ON a.match = b.match AND abs(a.t - b.t) <= 7200),
    m AS (SELECT * FROM j WHERE ra = 1 AND rb = 1)
    SELECT status, count(*) AS n FROM (SELECT CASE WHEN agree THEN 'agree' ELSE 'conflict' END AS status FROM m UNION ALL SELECT 'only_a' FROM a WHERE idx NOT IN (SELECT ia FROM m) UNION ALL SELECT 'only_b' FROM b WHERE idx NOT IN (SELECT ib FROM m)) GROUP BY status""")
def jon9(spark, sf_dir):
    """Two providers' events matched by mutual nearness, each used once."""
    e = clocked(spark, sf_dir).where("kind = 'click'")
    a = e.where("idx % 2 = 0").select("match", F.col("idx").alias("ia"), F.col("t").alias("ta"), F.col("x").alias("xa"))
    b = e.where("idx % 2 = 1").select("match", F.col("idx").alias("ib"), F.col("t").alias("tb"), F.col("x").alias("xb"))
    m = J.mutual_nearest(a, b, ["match"], "ta", "tb", "ia", "ib", 7200)
    both = a.join(m.select("ia", "ib"), "ia", "full_outer").join(b, "ib", "full_outer")
    status = F.when(F.col("ib").isNull(), "only_a").when(F.col("ia").isNull(), "only_b").when(F.abs(F.col("xa") - F.col("xb")) < 20, "agree").otherwise("conflict")
    return both.groupBy(status.alias("status")).agg(F.count("*").alias("n"))


@query("jon10_targets_join", f"WITH {CLOCKED_SQL}, s AS (SELECT match, t // 86400 AS day, count(*) AS n FROM e GROUP BY ALL), g AS (SELECT match, t // 86400 - 1 AS day, count(*) FILTER (kind = 'purchase') AS goals FROM e GROUP BY ALL) SELECT s.match, s.day, s.n, coalesce(g.goals, 0)::BIGINT AS goals_next_day FROM s LEFT JOIN g ON s.match = g.match AND s.day = g.day")
def jon10(spark, sf_dir):
    """Daily snapshots with targets from the day after, keyed in whole days."""
    e = clocked(spark, sf_dir).withColumn("day", F.floor(F.col("t") / 86_400))
    s = e.groupBy("match", "day").agg(F.count("*").alias("n"))
    g = e.groupBy("match", (F.col("day") - 1).alias("day")).agg(F.count_if(F.col("kind") == "purchase").alias("goals_next_day"))
    return s.join(g, ["match", "day"], "left").na.fill(0, ["goals_next_day"])


@query("jon11_paired_models", f"WITH {FORECAST_SQL}, m AS (SELECT l_suppkey, CASE WHEN l_linenumber % 2 = 0 THEN 'm0' ELSE 'm1' END AS model, avg(pd) AS p FROM p GROUP BY ALL) SELECT l_suppkey, max(p) FILTER (model = 'm0') AS m0, max(p) FILTER (model = 'm1') AS m1 FROM m GROUP BY l_suppkey")
def jon11(spark, sf_dir):
    f = forecasts(spark, sf_dir).withColumn("model", F.when(F.col("l_linenumber") % 2 == 0, "m0").otherwise("m1"))
    return f.groupBy("l_suppkey").pivot("model", ["m0", "m1"]).agg(F.avg("pd"))


@query("jon12_previous_lineup", """
    WITH x AS (SELECT o_custkey, o_orderkey, o_orderdate, list_sort(list(DISTINCT l_suppkey % 15)) AS xi FROM orders JOIN lineitem ON l_orderkey = o_orderkey GROUP BY ALL), p AS (SELECT o_orderkey, xi, lag(xi) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS prev FROM x)
    SELECT o_orderkey, CASE WHEN prev IS NOT NULL THEN len(list_intersect(xi, prev))::INT END AS kept, len(xi)::INT AS n FROM p""")
def jon12(spark, sf_dir):
    """Players kept from the side's previous lineup (WIN19's continuity)."""
    x = table(spark, sf_dir, "orders").join(table(spark, sf_dir, "lineitem"), F.col("o_orderkey") == F.col("l_orderkey"))
    x = x.groupBy("o_custkey", "o_orderkey", "o_orderdate").agg(F.collect_set(F.col("l_suppkey") % 15).alias("xi"))
    prev = F.lag("xi").over(Window.partitionBy("o_custkey").orderBy("o_orderdate", "o_orderkey"))
    return x.withColumn("prev", prev).select("o_orderkey", F.when(F.col("prev").isNotNull(), F.size(F.array_intersect("xi", "prev"))).alias("kept"), F.size("xi").alias("n"))


@query("jon14_identity_aliases", "SELECT o_orderkey, CASE o_orderpriority WHEN '1-URGENT' THEN 'm_urgent' WHEN '2-HIGH' THEN 'm_high' END AS identity FROM orders")
def jon14(spark, sf_dir):
    """Aliases in context; unresolved stays null."""
    aliases = spark.createDataFrame([("1-URGENT", "m_urgent"), ("2-HIGH", "m_high")], "alias string, identity string")
    return J.resolve_aliases(table(spark, sf_dir, "orders"), aliases, "o_orderpriority").select("o_orderkey", "identity")


@query("jon15_alignment_confidence", f"""
    WITH {CLOCKED_SQL}, j AS (SELECT a.match, a.idx, b.idx AS other, b.k % 10 = 0 AS fixed, b.k % 7 > 0 AS safe, floor(least(1::DOUBLE, 0.4::DOUBLE * (a.kind = b.kind)::INT + 0.3::DOUBLE * (a.k % 2 = b.k % 2)::INT + 0.3::DOUBLE * greatest(0::DOUBLE, 1 - abs(a.t - b.t) / 1800::DOUBLE)) * 1000 + 0.5) / 1000 AS c FROM e a JOIN e b ON a.match = b.match AND a.idx < b.idx AND abs(a.t - b.t) <= 1800)
    SELECT match, idx, other, c::DOUBLE AS confidence, CASE WHEN fixed THEN 'correction_or_duplicate' WHEN NOT safe THEN 'timing_not_safe_for_live_use' WHEN c >= 0.75 THEN 'high_confidence_event_alignment' WHEN c >= 0.5 THEN 'medium_confidence_event_alignment' WHEN c > 0 THEN 'low_confidence_event_alignment' ELSE 'unaligned' END AS class FROM j""")
def jon15(spark, sf_dir):
    e = clocked(spark, sf_dir).select("match", "idx", "t", "kind", "k")
    other = e.select("match", *(F.col(c).alias(f"{c}_o") for c in ("idx", "t", "kind", "k")))
    j = J.band_pairs(e, other, ["match"], "t", "t_o", 1800).where("idx < idx_o")
    k = F.col("k_o")
    j = J.confidence(j, F.col("kind") == F.col("kind_o"), F.col("k") % 2 == k % 2, F.abs(F.col("t") - F.col("t_o")), 1800, corrected=k % 10 == 0, live_safe=k % 7 > 0)
    return j.select("match", "idx", F.col("idx_o").alias("other"), "confidence", "class")


@query("jon16_components", """
    WITH RECURSIVE p AS (SELECT DISTINCT c_custkey AS a, c_custkey - c_custkey % 7 + (c_custkey + c_nationkey % 3) % 7 AS b FROM customer), e AS (SELECT a, b FROM p UNION SELECT b, a FROM p),
    r AS (SELECT a, a AS c FROM e UNION SELECT e.a, r.c FROM r JOIN e ON e.b = r.a) SELECT a AS node, min(c) AS component FROM r GROUP BY a""")
def jon16(spark, sf_dir):
    """Groups rebuilt from pairs of fixtures."""
    a = F.col("c_custkey")
    return J.components(table(spark, sf_dir, "customer").select(a.alias("a"), (a - a % 7 + (a + F.col("c_nationkey") % 3) % 7).alias("b")))


@query("jon13_entity_resolution", r"""
    WITH d AS (SELECT trim(regexp_replace(lower(p_name), '[^\p{L}\p{N} ]', '', 'g')) AS plain, max(p_name) AS name FROM part GROUP BY 1),
    q AS (SELECT s_suppkey AS id, trim(regexp_replace(lower(CASE s_suppkey % 3 WHEN 0 THEN regexp_replace(p_name, 'e', 'a') WHEN 1 THEN '"X' || substr(p_name, 2) || '"' ELSE upper(p_name) END), '[^\p{L}\p{N} ]', '', 'g')) AS raw FROM supplier JOIN part ON p_partkey = s_suppkey),
    c AS (SELECT id, name, 1 - levenshtein(raw, plain) / greatest(length(raw), length(plain)) AS conf FROM q JOIN d ON plain <> '' AND raw <> ''), b AS (SELECT id, arg_max(name, (conf, name)) AS name, max(conf) AS conf FROM c GROUP BY ALL)
    SELECT q.id, CASE WHEN b.conf >= 0.7 THEN b.name END AS entity FROM q LEFT JOIN b USING (id)""")
def jon13(spark, sf_dir):
    """Names with an error, another first letter, quotes or another case, resolved by edit distance; null below the least confidence."""
    part, k = table(spark, sf_dir, "part"), F.col("s_suppkey") % 3
    name = F.col("p_name")
    raw = F.when(k == 0, F.regexp_replace("p_name", "^([^e]*)e", "$1a")).when(k == 1, F.concat(F.lit('"X'), name.substr(F.lit(2), F.length(name)), F.lit('"'))).otherwise(F.upper(name))
    q = table(spark, sf_dir, "supplier").join(part, F.col("p_partkey") == F.col("s_suppkey")).select(F.col("s_suppkey").alias("id"), raw.alias("raw"))
    return J.resolve_entities(q, part.select(name.alias("name")).distinct(), "id", "raw", "name", 0.7)
