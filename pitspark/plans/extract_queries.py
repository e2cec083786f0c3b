"""Queries of provider extraction, coverage, composed models and refreshes."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from ..functions import probs as P
from ..operators import evaluation as E
from ..operators import models as M
from ..operators.joins import shared_folder
from ..operators.players import HOME, K
from ..sources import extract as X
from ..sources.tables import CLOCKED_SQL, clocked, table
from .function_queries import FORECAST_SQL, forecasts
from .model_queries import _split, panel
from .registry import Registry

query = Registry()

KINDS = {"click": "Shot", "purchase": "Own Goal For", "error": "Foul Committed", "signup": "Substitution", "view": "Pass"}


@query("src17_extract_events", f"""
    WITH {CLOCKED_SQL}, n AS (SELECT match, CASE WHEN k % 20 > 0 THEN k END AS minute, 't' || k % 2 AS team, kind, k, x FROM e),
    r AS (SELECT match, minute, team, 'shot' AS kind, NULL AS detail, coalesce(CASE WHEN k % 3 > 0 THEN x / 100 END, 0) AS xg FROM n WHERE kind = 'click' UNION ALL SELECT match, minute, team, 'goal', NULL, NULL FROM n WHERE kind = 'purchase' OR kind = 'click' AND k % 7 = 0
        UNION ALL SELECT match, minute, team, 'card', CASE WHEN k % 4 = 0 THEN 'Red Card' ELSE 'Yellow Card' END, NULL FROM n WHERE kind = 'error' AND k % 2 = 0 UNION ALL SELECT match, minute, team, 'sub', NULL, NULL FROM n WHERE kind = 'signup')
    SELECT match, minute::INT AS minute, team, kind, detail, xg::DOUBLE AS xg FROM r WHERE minute IS NOT NULL""")
def src17(spark, sf_dir):
    """Goals, cards, substitutions and shots from nested provider events."""
    k, kind = F.col("k"), F.col("kind")
    name = F.when(F.lit(False), "")
    for ours, theirs in KINDS.items():
        name = name.when(kind == ours, theirs)
    shot = F.when(kind == "click", F.struct(F.when(k % 3 > 0, F.col("x") / 100).alias("statsbomb_xg"), F.struct(F.when(k % 7 == 0, "Goal").otherwise("Saved").alias("name")).alias("outcome")))
    foul = F.when((kind == "error") & (k % 2 == 0), F.struct(F.struct(F.when(k % 4 == 0, "Red Card").otherwise("Yellow Card").alias("name")).alias("card")))
    payload = F.to_json(F.struct(F.struct(name.alias("name")).alias("type"), F.struct(F.concat(F.lit("t"), (k % 2).cast("string")).alias("name")).alias("team"), F.when(k % 20 > 0, k).alias("minute"), shot.alias("shot"), foul.alias("foul_committed")))
    return X.extract_events(clocked(spark, sf_dir).select("match", payload.alias("payload")), "match", F.col("payload")).drop("xg_known")


@query("src18_commentary_segments", """
    SELECT conv_id, turn, 'league a/' || conv_id % 9 || '/game ' || conv_id AS game, CASE WHEN turn % 3 > 0 THEN (turn % 3)::INT ELSE 0 END AS half, 'league_a/' || conv_id % 9 || '/game_' || conv_id || CASE WHEN turn % 3 > 0 THEN '/' || turn % 3 ELSE '' END AS normal,
        turn * 12.5 AS t_s, CASE turn % 4 WHEN 0 THEN 'goal' WHEN 1 THEN 'second_yellow' WHEN 2 THEN 'shot' ELSE 'other' END AS canonical, turn % 3 = 0 OR role = 'user' AS open_half FROM conversations""")
def src18(spark, sf_dir):
    """Commentary and action labels as rows relative to a half, from game paths and clocks."""
    c, t = F.col("conv_id").cast("string"), F.col("turn")
    path = F.concat(F.lit("League A\\"), (F.col("conv_id") % 9).cast("string"), F.lit("/Game "), c, F.when(t % 3 > 0, F.concat(F.lit("/"), (t % 3).cast("string"))).otherwise(""), F.lit("/"))
    label = F.when(t % 4 == 0, "Goal").when(t % 4 == 1, "Yellow->red card").when(t % 4 == 2, "Shots off target").otherwise("Throw-in")
    clock = F.when((t % 3 > 0) & (F.col("role") != "user"), F.concat((t % 3).cast("string"), F.lit(" - 10:00"))).otherwise("unknown")
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", path.alias("path"), label.alias("label"), clock.alias("game_time"), (t * 12_500).cast("string").alias("position"))
    game, half = X.game_of(F.col("path"))
    rows = X.label_events(rows.withColumns({"game": F.lower(game), "of": half, "normal": X.normal_game(F.col("path"))}))
    return rows.select("conv_id", "turn", "game", F.col("of").alias("half"), "normal", "t_s", "canonical", (F.col("half") == 0).alias("open_half"))


@query("src22_normalised_events", """
    SELECT lower(c_mktsegment) || '/' || c_nationkey || '/' || o_orderdate::DATE || '/' || o_custkey || '/' || o_orderkey AS canonical_match_id, CASE WHEN o_orderstatus = 'F' THEN 'goal' ELSE 'other' END AS event_type, CASE WHEN o_custkey % 5 > 0 THEN o_custkey::VARCHAR END AS player_id, NULL::DOUBLE AS xg, true AS has_player, false AS has_xg
    FROM orders JOIN customer ON c_custkey = o_custkey""")
def src22(spark, sf_dir):
    """A provider's rows as canonical events: ids verbatim, missing fields null, and what it can tell."""
    o = table(spark, sf_dir, "orders").join(table(spark, sf_dir, "customer"), F.col("c_custkey") == F.col("o_custkey"))
    key = X.match_key(F.col("c_mktsegment"), F.col("c_nationkey"), F.col("o_custkey"), F.col("o_orderkey"), F.to_date("o_orderdate"))
    raw = o.select(key.alias("game"), F.when(F.col("o_orderstatus") == "F", "goal").otherwise("other").alias("what"), X.verbatim_id(F.when(F.col("o_custkey") % 5 > 0, F.col("o_custkey").cast("string")).otherwise("null")).alias("who"))
    fields = {"canonical_match_id": "string", "event_type": "string", "player_id": "string", "xg": "double"}
    rows, has = X.normalised(raw, {"canonical_match_id": "game", "event_type": "what", "player_id": "who"}, fields, ["goal", "other"])
    return rows.withColumns({"has_player": F.lit(has["player_id"]), "has_xg": F.lit(has["xg"])})


@query("agg28_coverage_recovery", f"""
    WITH {CLOCKED_SQL}, tr AS (SELECT match, k % 3 AS cls, t FROM e WHERE kind = 'purchase'), d AS (SELECT DISTINCT match, cls, t FROM tr), em AS (SELECT row_number() OVER (ORDER BY idx) AS id, match, k % 3 AS cls, t FROM e WHERE kind = 'view'),
    n AS (SELECT em.id, em.match, em.cls, abs(d.t - em.t) AS gap, d.t AS spot, row_number() OVER (PARTITION BY em.id ORDER BY abs(d.t - em.t), d.t) AS place FROM em JOIN d ON d.match = em.match AND d.cls = em.cls AND abs(d.t - em.t) <= 1800), g AS (SELECT id, match, cls, gap, spot FROM n WHERE place = 1),
    r AS (SELECT cls, gap, row_number() OVER (PARTITION BY cls ORDER BY gap) AS rn, count(*) OVER (PARTITION BY cls) AS k FROM g), h AS (SELECT cls, count(*) AS hits, median(gap)::DOUBLE AS timing_median, max(gap) FILTER (rn = greatest(1, floor(k * 0.9))) AS timing_p90 FROM r GROUP BY cls),
    v AS (SELECT cls, count(*) AS recovered FROM (SELECT DISTINCT match, cls, spot FROM g) GROUP BY cls), a AS (SELECT cls, count(*) AS true_events FROM tr GROUP BY cls), b AS (SELECT cls, count(*) AS emitted FROM em GROUP BY cls)
    SELECT cls, true_events, emitted, timing_median, timing_p90, coalesce(recovered, 0)::BIGINT AS recovered, emitted - coalesce(hits, 0) AS false_ones, coalesce(recovered, 0) / true_events AS recall, (emitted - coalesce(hits, 0)) / emitted AS burden FROM a JOIN b USING (cls) LEFT JOIN h USING (cls) LEFT JOIN v USING (cls)""")
def agg28(spark, sf_dir):
    """How many true events a masked source's claims recover, and how many claims are false."""
    e = clocked(spark, sf_dir).withColumn("cls", F.col("k") % 3)
    return E.coverage_recovery(e.where("kind = 'purchase'"), e.where("kind = 'view'").select("match", "cls", F.col("t").alias("said")), ["match"], "cls", "t", "said", 1800)


@query("mod6_temporal_folds", """
    WITH m AS (SELECT o_orderpriority AS comp, o_orderdate + INTERVAL (o_custkey % 5 * 300) DAY AS d FROM orders WHERE o_orderstatus <> 'F'), x AS (SELECT l_shipdate AS d FROM lineitem), f AS (SELECT comp AS held, min(d) AS cutoff FROM m GROUP BY comp), s AS (SELECT * FROM f WHERE cutoff > (SELECT min(d) FROM m))
    SELECT held, role, domain, count(*) AS n FROM (SELECT held, 'train' AS role, 'main' AS domain FROM s JOIN m ON m.d < cutoff UNION ALL SELECT held, 'train', 'aux' FROM s JOIN x ON x.d < cutoff UNION ALL SELECT held, 'test', 'main' FROM s JOIN m ON comp = held) GROUP BY ALL""")
def mod6(spark, sf_dir):
    """Rows of each outer fold by role and domain: nothing at or after a fold's first date trains for it."""
    shift = F.make_dt_interval((F.col("o_custkey") % 5 * 300).cast("int"))
    main = table(spark, sf_dir, "orders").where("o_orderstatus <> 'F'").select(F.col("o_orderpriority").alias("comp"), (F.col("o_orderdate") + shift).alias("d"))
    aux = table(spark, sf_dir, "lineitem").select(F.col("l_shipdate").alias("d"))
    return E.temporal_folds(main, aux, "comp", "d").groupBy("held", "role", "domain").agg(F.count("*").alias("n"))


LOSS_SQL = "-ln(CASE outcome WHEN 'A' THEN (1 - a) * pa + a * qa WHEN 'D' THEN (1 - a) * pd + a * qd ELSE (1 - a) * pb + a * qb END)"


@query("mod18_selective_gate", f"""
    WITH {FORECAST_SQL}, r AS (SELECT outcome, 1 / 3.0 AS pa, 1 / 3.0 AS pd, 1 / 3.0 AS pb, pa AS qa, pd AS qd, pb AS qb, (l_suppkey % 11) / 10.0 AS k FROM p),
    g AS (SELECT t[1] AS t_low, t[2] AS t_full, lo AS alpha_low, fu AS alpha_full FROM (SELECT unnest([[0.40, 0.75], [0.50, 0.80], [0.60, 0.85]]) AS t), (SELECT unnest([0.0, 0.25, 0.5]) AS lo), (SELECT unnest([0.0, 0.5, 0.75, 1.0]) AS fu) WHERE fu >= lo),
    l AS (SELECT t_low, t_full, alpha_low, alpha_full, avg({LOSS_SQL}) AS loss FROM (SELECT g.*, r.*, CASE WHEN k >= t_full THEN alpha_full WHEN k >= t_low THEN alpha_low ELSE 0 END AS a FROM g, r) GROUP BY ALL)
    SELECT t_low::DOUBLE AS t_low, t_full::DOUBLE AS t_full, alpha_low::DOUBLE AS alpha_low, alpha_full::DOUBLE AS alpha_full, loss, (SELECT avg(ln(3)) FROM r) AS base_loss FROM l ORDER BY loss, t_low, alpha_low, alpha_full LIMIT 1""")
def mod18(spark, sf_dir):
    """How much of a correction to take, by how much of a row is known; the one setting with the least loss."""
    f = forecasts(spark, sf_dir).withColumns({"k": (F.col("l_suppkey") % 11) / 10.0, "u": F.lit(1 / 3)})
    return M.selective_gate(f, "k", ["u", "u", "u"], ["pa", "pd", "pb"], "outcome")


@query("mod26_refresh", """
    WITH m AS (SELECT o_orderkey AS id, o_custkey AS a, o_orderkey % 1000 + 1 AS b, CASE WHEN o_orderkey % 5 > 0 THEN floor(o_totalprice)::BIGINT % 4 END AS ga, CASE WHEN o_orderkey % 5 > 0 THEN floor(o_totalprice)::BIGINT // 4 % 4 END AS gb FROM orders), n AS (SELECT o_orderkey AS id, 3 AS ga, o_orderkey % 4 AS gb FROM orders WHERE o_orderkey % 50 = 0),
    t AS (SELECT c_custkey AS team, 1500 + c_acctbal / 20 AS rating FROM customer), pl AS (SELECT m.a, m.b, n.ga, n.gb, coalesce(x.rating, 1500) AS ra, coalesce(y.rating, 1500) AS rb FROM m JOIN n ON n.id = m.id LEFT JOIN t x ON x.team = m.a LEFT JOIN t y ON y.team = m.b),
    d AS (SELECT a, b, {k} * CASE WHEN abs(ga - gb) <= 1 THEN 1 WHEN abs(ga - gb) = 2 THEN 1.5 ELSE (11 + abs(ga - gb)) / 8.0 END * (CASE WHEN ga > gb THEN 1 WHEN ga = gb THEN 0.5 ELSE 0 END - 1 / (1 + pow(10, -(ra + {home} - rb) / 400))) AS d FROM pl),
    mv AS (SELECT team, sum(d) AS d FROM (SELECT a AS team, d FROM d UNION ALL SELECT b, -d FROM d) GROUP BY team), af AS (SELECT coalesce(t.team, mv.team) AS team, coalesce(rating, 1500) + coalesce(d, 0) AS rating FROM t FULL JOIN mv ON t.team = mv.team),
    o AS (SELECT id, a, b FROM m WHERE ga IS NULL AND id NOT IN (SELECT id FROM n)), q AS (SELECT o.*, 1 / (1 + pow(10, -(coalesce(x.rating, 1500) - coalesce(y.rating, 1500)) / 400)) AS p FROM o LEFT JOIN af x ON x.team = a LEFT JOIN af y ON y.team = b)
    SELECT id, a, b, p * p + 0.4 * p * (1 - p) AS pa, 1.2 * p * (1 - p) AS pd, (1 - p) * (1 - p) + 0.4 * p * (1 - p) AS pb FROM q""".replace("{k}", str(K)).replace("{home}", str(HOME)))
def mod26(spark, sf_dir):
    """Results come in, ratings move, and what is still open is forecast anew."""
    k, price = F.col("o_orderkey"), F.floor("o_totalprice").cast("long")
    o = table(spark, sf_dir, "orders")
    m = o.select(k.alias("id"), F.col("o_custkey").alias("a"), (k % 1000 + 1).alias("b"), F.when(k % 5 > 0, price % 4).alias("ga"), F.when(k % 5 > 0, F.floor(price / 4) % 4).alias("gb"))
    results = o.where("o_orderkey % 50 = 0").select(k.alias("id"), F.lit(3).cast("long").alias("ga"), (k % 4).alias("gb"))
    ratings = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("team"), (1500 + F.col("c_acctbal") / 20).alias("rating"))
    return E.refresh(m, results, ratings)[2]


@query("mod15_intensity_wdl")
def mod15(spark, sf_dir):
    """Remaining goals of both sides to W/D/L, calibrated; the tests check its parts."""
    train, test = _split(_sides(spark, sf_dir))
    out = M.intensity_wdl(train, ["minute", "diff", "xg"], "left_a", "left_b", "lead", "outcome")(test)
    return out.select("l_orderkey", "l_linenumber", *(F.round(c, 4).alias(c) for c in ("p_a", "p_draw", "p_b")))


@query("mod17_competing_risk")
def mod17(spark, sf_dir):
    """Hazards of either side scoring next to W/D/L, calibrated; the tests check its parts."""
    train, test = _split(_sides(spark, sf_dir))
    out = M.competing_risk_wdl(train, ["minute", "diff", "xg"], "next_a", "next_b", "left_minutes", "lead", "outcome")(test)
    return out.select("l_orderkey", "l_linenumber", *(F.round(c, 4).alias(c) for c in ("p_a", "p_draw", "p_b")))


def _sides(spark, sf_dir):
    """The in-play panel with goals to come of both sides and the outcome."""
    p = panel(spark, sf_dir).withColumns({"left_a": F.col("goals"), "left_b": F.floor(F.col("tilt") * 25), "lead": F.floor(F.col("diff")).cast("int"), "left_minutes": 90 - F.col("minute"), "next_a": F.col("follows"), "next_b": (F.col("tilt") > 0.06).cast("double")})
    final = F.col("lead") + F.col("left_a") - F.col("left_b")
    return p.withColumn("outcome", F.when(final > 0, "A").when(final == 0, "D").otherwise("B"))


@query("mod13_platt_and_draw")
def mod13_platt(spark, sf_dir):
    """Draws calibrated on even suppliers and applied to the others, the other classes keeping their proportion."""
    f = forecasts(spark, sf_dir).withColumnsRenamed({"pa": "p_a", "pd": "p_draw", "pb": "p_b"})
    out = M.draw_calibrated(f.where("l_suppkey % 2 = 0"), "outcome")(f)
    return out.select("l_orderkey", "l_linenumber", *(F.round(c, 4).alias(c) for c in ("p_a", "p_draw", "p_b")))


@query("mod20_text_classifier")
def mod20(spark, sf_dir):
    """Texts like those marked toxic, by words and letters, silent unless a keyword speaks; the tests check it on made-up texts."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    known = docs.join(table(spark, sf_dir, "labels").where("toxic is not null").select("doc_id", "toxic"), "doc_id")
    rule = lambda t: F.least(F.lit(1.0), F.regexp_count(F.coalesce(t, F.lit("")), F.lit("(?i)(stupid|idiot|moron)")) / 2)
    return M.text_classifier(known, "text", "toxic", rule)(docs).select("doc_id", F.round("p", 4).alias("p"), F.round("confidence", 4).alias("confidence"))


@query("src21_report_bundle", "SELECT * FROM (SELECT 'orders' AS name, count(*) AS rows FROM orders UNION ALL SELECT 'teams', count(DISTINCT c_nationkey) FROM customer)")
def src21(spark, sf_dir):
    """Report tables written as a bundle, with what each holds."""
    tables = {"orders": table(spark, sf_dir, "orders"), "teams": table(spark, sf_dir, "customer").groupBy("c_nationkey").agg(F.avg("c_acctbal").alias("balance"))}
    return X.write_bundle(tables, f"{shared_folder(spark)}/bundle-{uuid.uuid4().hex}").select("name", "rows")


@query("mod19_transfer_ladder")
def mod19(spark, sf_dir):
    """Rungs of learning from another domain (lines of an odd ship line), by their loss on held-out main rows; the tests check them on made-up domains."""
    train, test = _split(panel(spark, sf_dir))
    other = F.col("l_linenumber") % 2 == 1
    rungs = M.transfer_ladder(train.where(~other), train.where(other).withColumn("xg", F.col("xg") * 3), ["minute", "diff", "xg"], "follows")
    scored = None
    for name, predict in rungs.items():
        p = P.clip(F.col("p"), 1e-9, 1 - 1e-9)
        part = predict(test.where(~other)).select(F.lit(name).alias("model"), (-F.when(F.col("follows") == 1, F.log(p)).otherwise(F.log(1 - p))).alias("loss"))
        scored = part if scored is None else scored.unionByName(part)
    return scored.groupBy("model").agg(F.count("*").alias("n"), F.round(F.avg("loss"), 4).alias("log_loss"))
