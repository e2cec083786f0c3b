"""Queries of player histories, rolling windows, goal dynamics, and provider payloads of players and results."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from ..operators import evaluation as E
from ..operators import history as H
from ..operators import inplay as I
from ..operators import pit
from ..operators import players as L
from ..operators import projections as R
from ..operators.joins import shared_folder
from ..sources import extract as X
from ..sources import nested as N
from ..sources import readers as S
from ..sources.tables import CLOCKED_SQL, clocked, seconds, table
from .inplay_queries import MATCHES_SQL, NORMAL_SQL, _rates_sql, _states_sql, _wdl_sql, match_events, matches
from .pit_queries import SNAPSHOTS_SQL
from .registry import Registry

query = Registry()

#: A line of an order is an appearance: the supplier plays for the customer's side; three in four start.
PLAYED_SQL = """p AS (SELECT l_suppkey AS player, o_custkey % 40 AS team, l_orderkey AS match, l_linenumber AS slot, epoch_us(o_orderdate) // 86400000000 AS day, l_quantity AS minutes, CASE WHEN l_returnflag = 'A' THEN 1 ELSE 0 END AS goals,
    l_partkey % 4 > 0 AS started, CASE l_partkey % 5 WHEN 0 THEN 'D' WHEN 1 THEN 'F' WHEN 2 THEN 'G' WHEN 3 THEN 'M' END AS position, CASE WHEN l_partkey % 3 > 0 THEN 5 + l_discount * 40 END AS rating, l_partkey FROM lineitem JOIN orders ON l_orderkey = o_orderkey)"""
ORDER = ("match", "slot", "l_partkey", "minutes")


def played(spark, sf_dir):
    j = table(spark, sf_dir, "lineitem").join(table(spark, sf_dir, "orders"), F.col("l_orderkey") == F.col("o_orderkey"))
    part = F.col("l_partkey")
    position = F.when(part % 5 == 0, "D").when(part % 5 == 1, "F").when(part % 5 == 2, "G").when(part % 5 == 3, "M")
    return j.select(
        F.col("l_suppkey").alias("player"), (F.col("o_custkey") % 40).alias("team"), F.col("l_orderkey").alias("match"), F.col("l_linenumber").alias("slot"), F.floor(seconds(F.col("o_orderdate")) / 86_400).alias("day"),
        F.col("l_quantity").alias("minutes"), F.when(F.col("l_returnflag") == "A", 1).otherwise(0).alias("goals"), (part % 4 > 0).alias("started"), position.alias("position"), F.when(part % 3 > 0, 5 + F.col("l_discount") * 40).alias("rating"), "l_partkey")


def _exposure_sql() -> str:
    """exposure of players by day: states at the end of each appearance, of a day's last one, of the day before."""
    starts = ", ".join(f"count(*) FILTER (started AND position = '{p}') OVER u AS start_{p}" for p in H.POSITIONS)
    recent = ", ".join(f"sum(minutes) OVER w{n} AS minutes_last{n}, count(*) OVER w{n} AS apps_last{n}, sum(started::INT) OVER w{n} AS starts_last{n}" for n in H.RECENT)
    frames = ", ".join(f"w{n} AS (PARTITION BY player ORDER BY day, match, slot, l_partkey, minutes ROWS BETWEEN {n - 1} PRECEDING AND CURRENT ROW)" for n in H.RECENT)
    names = ["apps", "starts", "mins", *(f"start_{p}" for p in H.POSITIONS), *(f"{x}_last{n}" for n in H.RECENT for x in ("minutes", "apps", "starts"))]
    known = " + ".join(f"start_{p}" for p in H.POSITIONS)
    return f"""{PLAYED_SQL}, xr AS (SELECT player, day, match, slot, count(*) OVER u AS apps, sum(started::INT) OVER u AS starts, sum(minutes) OVER u AS mins, {starts}, {recent},
            row_number() OVER (PARTITION BY player, day ORDER BY match DESC, slot DESC, l_partkey DESC, minutes DESC) AS back FROM p WINDOW u AS (PARTITION BY player ORDER BY day, match, slot, l_partkey, minutes ROWS UNBOUNDED PRECEDING), {frames}),
        xb AS (SELECT player, day, day - lag(day) OVER d AS days_since, {', '.join(f'coalesce(lag({n}) OVER d, 0) AS {n}' for n in names)} FROM xr WHERE back = 1 WINDOW d AS (PARTITION BY player ORDER BY day)),
        x AS (SELECT player, day, apps::BIGINT AS prior_appearances, starts::BIGINT AS prior_starts, mins::DOUBLE AS prior_minutes, days_since,
            {', '.join(f'minutes_last{n}::DOUBLE AS minutes_last{n}, apps_last{n}::BIGINT AS apps_last{n}, starts_last{n}::BIGINT AS starts_last{n}' for n in H.RECENT)}, {', '.join(f'CASE WHEN {known} > 0 THEN start_{p} / ({known}) ELSE 0 END::DOUBLE AS share_{p}' for p in H.POSITIONS)},
            CASE WHEN {known} = 0 THEN CASE WHEN apps > starts THEN 'sub' ELSE 'unknown' END WHEN start_D = greatest(start_D, start_F, start_G, start_M) THEN 'D' WHEN start_F = greatest(start_F, start_G, start_M) THEN 'F' WHEN start_G >= start_M THEN 'G' ELSE 'M' END AS position,
            CASE WHEN apps > 0 THEN (starts_last10 + 1.5) / (apps_last10 + 3.0) ELSE 0 END::DOUBLE AS availability, 3.0 / (apps + 3.0) AS uncertainty, mins / (mins + 270.0) AS exposure, apps = 0 AS unknown FROM xb)"""


@query("win18_player_exposure", f"WITH {_exposure_sql()} SELECT * FROM x")
def win18(spark, sf_dir):
    """Each player on each day as known before it: appearances, recent ones, shares of positions, availability."""
    return H.exposure(played(spark, sf_dir), ["player"], "day", list(ORDER))


@query("win20_scaled_substitutions", f"""
    WITH {_exposure_sql()}, a AS (SELECT player, day, sum(minutes) AS m, sum(goals) AS g FROM p GROUP BY ALL), pc AS (SELECT player, day, coalesce(sum(m) OVER w, 0) AS m, coalesce(sum(g) OVER w, 0) AS g FROM a WINDOW w AS (PARTITION BY player ORDER BY day RANGE BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
    d AS (SELECT day, sum(minutes) AS m, sum(goals) AS g FROM p GROUP BY day), dc AS (SELECT day, coalesce(sum(g) OVER w / nullif(sum(m) OVER w, 0), 0) AS rate FROM d WINDOW w AS (ORDER BY day RANGE BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
    pr AS (SELECT pc.player, pc.day, (pc.g + 270 * rate) / (pc.m + 270) AS prior, x.prior_appearances AS n, x.position AS pos FROM pc JOIN dc USING (day) JOIN x ON x.player = pc.player AND x.day = pc.day),
    s AS (SELECT match, max(day) AS day, max(player) FILTER (slot = 2) AS player_in, max(player) FILTER (slot = 1) AS player_out, max(CASE WHEN l_partkey % 7 > 0 THEN l_partkey % 100 END) FILTER (slot = 2) AS minute, max(l_partkey % 3 - 1) FILTER (slot = 1) AS lead FROM p GROUP BY match),
    j AS (SELECT s.*, coalesce(i.prior, 0) - coalesce(o.prior, 0) AS delta, i.n AS ni, o.n AS no_, i.pos AS pi, o.pos AS po, CASE WHEN i.pos IN ('G', 'D') THEN 'def' WHEN i.pos = 'M' THEN 'mid' WHEN i.pos = 'F' THEN 'att' END AS gi, CASE WHEN o.pos IN ('G', 'D') THEN 'def' WHEN o.pos = 'M' THEN 'mid' WHEN o.pos = 'F' THEN 'att' END AS go_
        FROM s LEFT JOIN pr i ON i.player = s.player_in AND i.day = s.day LEFT JOIN pr o ON o.player = s.player_out AND o.day = s.day)
    SELECT match, delta, delta * coalesce((90 - least(90, greatest(0, minute))) / 90.0, 1) * CASE WHEN lead < 0 THEN 0.85 ELSE 1 END AS scaled_delta, coalesce(pi = po, false) AS same_position, coalesce(gi <> go_ AND lead < 0, false) AS imbalance, coalesce(ni, 0) < 3 OR coalesce(no_, 0) < 3 AS low_history, coalesce(ni, 0) = 0 AS unknown_in, coalesce(no_, 0) = 0 AS unknown_out FROM j""")
def win20(spark, sf_dir):
    """What the second player of a match adds over the first, by what was known before the day, and how much of it lasts."""
    p = played(spark, sf_dir)
    rates = L.shrunk_prior(p, ["player"], "day", "goals", "minutes", 270.0).select("player", "day", F.col("prior_rate").alias("prior"))
    seen = H.exposure(p, ["player"], "day", list(ORDER)).select("player", "day", F.col("prior_appearances").alias("appearances"), "position")
    at, part = F.col("slot"), F.col("l_partkey")
    subs = p.groupBy("match").agg(F.max("day").alias("day"), F.max(F.when(at == 2, F.col("player"))).alias("player_in"), F.max(F.when(at == 1, F.col("player"))).alias("player_out"), F.max(F.when((at == 2) & (part % 7 > 0), part % 100)).alias("minute"), F.max(F.when(at == 1, part % 3 - 1)).alias("lead"))
    out = H.substitution_deltas(subs, rates.join(seen, ["player", "day"]), "day")
    return out.drop("day", "player_in", "player_out", "minute", "lead")


@query("win21_lineup_form", f"""
    WITH {PLAYED_SQL}, r AS (SELECT player, day, sum(rating) AS s, count(rating) AS n FROM p GROUP BY ALL), c AS (SELECT player, day, sum(s) OVER w AS s, sum(n) OVER w AS n FROM r WINDOW w AS (PARTITION BY player ORDER BY day RANGE BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING))
    SELECT match, avg(s / n) FILTER (n > 0) AS form, count(*) FILTER (n > 0) / count(*) AS coverage FROM p JOIN c USING (player, day) WHERE started GROUP BY match""")
def win21_form(spark, sf_dir):
    """Mean rating of a lineup's players before the day, and how many have one."""
    p = played(spark, sf_dir)
    return H.lineup_form(p.where("started").select("match", "player", "day"), p, ["match"], "day")


@query("win21_key_player_availability", f"""
    WITH {PLAYED_SQL}, t AS (SELECT team, player, day, sum(minutes) AS m FROM p GROUP BY ALL), q AS (SELECT DISTINCT team, match, day FROM p WHERE started), dd AS (SELECT DISTINCT team, day FROM q),
    c AS (SELECT dd.team, dd.day, t.player, sum(t.m) AS m, min(t.day) AS first FROM dd JOIN t ON t.team = dd.team AND t.day < dd.day GROUP BY ALL HAVING sum(t.m) > 0), k AS (SELECT *, row_number() OVER (PARTITION BY team, day ORDER BY m DESC, first, player) AS place FROM c),
    top AS (SELECT team, day, list(player) AS best FROM k WHERE place <= 6 GROUP BY ALL), xi AS (SELECT team, match, day, list(DISTINCT player) AS xi FROM p WHERE started GROUP BY ALL)
    SELECT xi.team, xi.match, len(list_intersect(xi, best)) / len(best) AS availability, coalesce(len(best), 0) / 6.0 AS coverage FROM xi LEFT JOIN top ON top.team = xi.team AND top.day = xi.day""")
def win21_key(spark, sf_dir):
    """How many of a side's six players with most minutes before a match start it."""
    p = played(spark, sf_dir)
    return H.key_players(p.where("started").select("team", "match", "player", "day"), p.select("team", "player", "day", "minutes"), "day")


# ---------------------------------------------------------------- windows, labels and goal dynamics

SPANS, HALF = ((0, 3600), (0, 43_200), (0, 86_400), (43_200, 86_400)), 1_705_276_800
CHANCES = {"shots": "CASE WHEN kind = 'click' THEN 1 END", "xg": "CASE WHEN kind = 'click' THEN x / 100.0 END"}


def _rolling_sql() -> str:
    sides = {"home": 0, "away": 1}
    one = lambda v, n, when: f"round(coalesce(sum(({v})::DOUBLE) FILTER (k % 2 = {n} AND et <= t AND {when}), 0), 6)"
    spans = ", ".join(one(v, n, f"et >= t - {hi} AND et <= t - {lo}") + f" AS {m}_{H.span_name(lo, hi)}_{s}" for m, v in CHANCES.items() for lo, hi in SPANS for s, n in sides.items())
    halves = ", ".join(one(v, n, f"(et >= {HALF}) = (t >= {HALF})") + f" AS {m}_half_{s}" for m, v in CHANCES.items() for s, n in sides.items())
    return f"""WITH {CLOCKED_SQL}, {SNAPSHOTS_SQL}, j AS (SELECT s.match, s.t, e.t AS et, e.kind, e.x, e.k FROM s LEFT JOIN e ON s.match = e.match), a AS (SELECT match, t, {spans}, {halves} FROM j GROUP BY match, t)
        SELECT *, round((xg_last_86400_home - xg_last_86400_away) / 1440, 6) AS xg_momentum, round((xg_last_43200_home - xg_last_43200_away) / 720 - (xg_43200_to_86400_home - xg_43200_to_86400_away) / 720, 6) AS xg_acceleration FROM a"""


@query("win8_rolling_windows", _rolling_sql())
def win8(spark, sf_dir):
    """Chances of both sides in several widths, in the current half, and how their difference moves."""
    e = clocked(spark, sf_dir)
    sided = e.withColumn("side", F.when(F.col("k") % 2 == 0, "home").when(F.col("k") % 2 == 1, "away"))
    out = H.rolling_sides(sided, pit.snapshot_schedule(e, ["purchase"], 21_600), {m: F.expr(v) for m, v in CHANCES.items()}, SPANS, lambda t: (t >= HALF).cast("int"))
    # as in the SQL, how the difference moves comes from the rounded sums; F.round would take a double's decimals for it, so that a tie goes another way
    out = out.withColumns({c: F.round(c, 6) for c in out.columns if c not in ("match", "t")})
    return H.pace(out, "xg", 43_200, 86_400).withColumns({c: F.round(F.col(c) * 1e6) / 1e6 for c in ("xg_momentum", "xg_acceleration")})


@query("lab5_sendoff_after", f"""
    WITH {CLOCKED_SQL}, {SNAPSHOTS_SQL}, n AS (SELECT s.match, s.t, count(e.idx) FILTER (k % 2 = 0) AS sendoffs_home, count(e.idx) FILTER (k % 2 = 1) AS sendoffs_away FROM s LEFT JOIN e ON e.match = s.match AND e.t <= s.t AND e.kind = 'error' AND e.k % 5 = 0 GROUP BY ALL)
    SELECT *, (max(sendoffs_home + sendoffs_away) OVER (PARTITION BY match) > sendoffs_home + sendoffs_away)::INT AS sendoff_after FROM n""")
def lab5(spark, sf_dir):
    """Whether somebody is sent off after a snapshot: the match's last snapshot has seen more than this one."""
    e = clocked(spark, sf_dir)
    off = (F.col("kind") == "error") & (F.col("k") % 5 == 0)
    sided = e.withColumn("side", F.when(F.col("k") % 2 == 0, "home").when(F.col("k") % 2 == 1, "away"))
    panel = pit.side_panel(sided, pit.snapshot_schedule(e, ["purchase"], 21_600), {"sendoffs": F.when(off, 1)}, F.lit(False), [])
    panel = panel.select("match", "t", *(F.col(f"sendoffs_{s}").cast("long").alias(f"sendoffs_{s}") for s in pit.SIDES))
    return H.sendoff_after(panel, ["sendoffs_home", "sendoffs_away"])


@query("fun12_goal_dynamics", f"""
    WITH {MATCHES_SQL}, {_states_sql('15, 45, 60, 89, 90')}, r AS ({_rates_sql('st', 'delta')}), v AS ({_wdl_sql('r', 'match, minute')}), n AS (SELECT match, minute, {NORMAL_SQL.format('w')} AS p_a, {NORMAL_SQL.format('d')} AS p_draw, {NORMAL_SQL.format('l')} AS p_b FROM v),
    g AS (SELECT *, greatest(1e-9, ra + rb) AS tot, greatest(1e-9, 90 - minute) AS rest FROM r)
    SELECT g.match, g.minute, p_a, p_draw, p_b, ra AS remaining_a, rb AS remaining_b, ra / tot AS next_goal_a, rb / tot AS next_goal_b, exp(-tot * least(5, rest) / rest) AS no_goal_5, {', '.join(f'1 - exp(-tot * least({h}, rest) / rest) AS goal_in_{h}' for h in I.HORIZONS)},
        sqrt(p_a * (1 - p_a) + p_draw * (1 - p_draw) + p_b * (1 - p_b)) AS uncertainty, -(p_a * ln(p_a) + p_draw * ln(p_draw) + p_b * ln(p_b)) / ln(3) AS entropy FROM g JOIN n ON n.match = g.match AND n.minute = g.minute""")
def fun12(spark, sf_dir):
    """The whole record of a state: forecast, goals to come, who scores next, a goal within 1 to 10 minutes."""
    out = I.envelope(I.states_at(match_events(spark, sf_dir), matches(spark, sf_dir), [15, 45, 60, 89, 90]))
    return out.select("match", "minute", "p_a", "p_draw", "p_b", "remaining_a", "remaining_b", "next_goal_a", "next_goal_b", "no_goal_5", *(f"goal_in_{h}" for h in I.HORIZONS), "uncertainty", "entropy")


# ---------------------------------------------------------------- payloads, contracts, results


@query("src15_substitutions", f"WITH {CLOCKED_SQL} SELECT match, CASE WHEN k % 10 > 0 THEN (t // 60 % 90)::INT END AS minute, k::BIGINT % 2 AS team, (k + 1)::BIGINT AS player_in, CASE WHEN k % 3 > 0 THEN (k + 2)::BIGINT END AS player_out FROM e WHERE kind = 'signup'")
def src15(spark, sf_dir):
    """Substitutions among a match's events, from payloads made of the events table, a payload an hour."""
    k = F.col("k")
    kind = F.when(F.col("kind") == "signup", "Subst").otherwise("Goal")
    event = F.struct(
        kind.alias("type"), F.struct(F.when(k % 10 > 0, F.floor(F.col("t") / 60) % 90).alias("elapsed")).alias("time"), F.struct((k % 2).alias("id")).alias("team"),
        F.struct((k + 1).alias("id")).alias("player"), F.when(k % 3 > 0, F.struct((k + 2).alias("id"))).alias("assist"))
    p = clocked(spark, sf_dir).groupBy("match", F.floor(F.col("t") / 3600).alias("hour")).agg(F.to_json(F.collect_list(event)).alias("payload"))
    return N.substitutions(p, "match", F.col("payload"))


@query("src16_player_matches", f"WITH {PLAYED_SQL} SELECT match, team, player, CASE WHEN l_partkey % 6 > 0 THEN minutes ELSE 0 END AS minutes, CASE WHEN l_partkey % 5 > 0 THEN rating END AS rating, coalesce(started, false) AS started FROM p")
def src16(spark, sf_dir):
    """A row a player and match from nested statistics, with unknown minutes, and ratings that are no numbers."""
    part = F.col("l_partkey")
    rating = F.when(part % 5 > 0, F.col("rating").cast("string")).otherwise(F.when(part % 2 == 0, "").otherwise("n/a"))
    games = F.struct(F.when(part % 6 > 0, F.col("minutes")).alias("minutes"), rating.alias("rating"), (~F.col("started")).alias("substitute"))
    player = F.struct(F.struct(F.col("player").alias("id")).alias("player"), F.array(F.struct(games.alias("games"))).alias("statistics"))
    p = played(spark, sf_dir).groupBy("match", "team").agg(F.collect_list(player).alias("players"))
    p = p.select("match", F.to_json(F.array(F.struct(F.struct(F.col("team").alias("id")).alias("team"), "players"))).alias("payload"))
    return N.player_matches(p, "match", F.col("payload"))


@query("src16_team_totals", "SELECT o_orderkey AS match, o_custkey AS team, CASE WHEN o_custkey % 4 > 0 THEN (o_custkey % 50) / 10.0 END AS total FROM orders")
def src16_totals(spark, sf_dir):
    c = F.col("o_custkey")
    value = F.when(c % 4 > 0, ((c % 50) / 10.0).cast("string")).when(c % 8 == 0, "")
    stats = F.array(F.struct(F.lit("Shots").alias("type"), F.lit("9").alias("value")), F.struct(F.lit("Expected_Goals").alias("type"), value.alias("value")))
    p = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("match"), F.to_json(F.array(F.struct(F.struct(c.alias("id")).alias("team"), stats.alias("statistics")))).alias("payload"))
    return N.team_totals(p, "match", F.col("payload"))


@query("src18_segment_texts", r"""WITH n AS (SELECT conv_id, turn, text, trim(regexp_replace(coalesce(text, ''), '[\s\x1c-\x1f]+', ' ', 'g')) AS norm FROM conversations)
    SELECT conv_id, turn, norm, sha256(coalesce(text, '')) AS content_hash, CASE WHEN norm = '' THEN 'empty' WHEN length(norm) < 3 THEN 'too_short' ELSE 'ok' END AS quality, floor(turn * 2.5)::INT AS clock_s, 'historical_weak_supervision_only' AS eligibility FROM n""")
def src18(spark, sf_dir):
    c = table(spark, sf_dir, "conversations").select("conv_id", "turn", "text")
    return X.segment_records(c, F.col("text"), F.col("turn") * 2.5).drop("text")


@query("prj10_schema_errors", """SELECT 'doc: ' || e AS error, count(*) AS n FROM (SELECT unnest(list_filter([CASE WHEN doc_id IS NULL THEN 'missing primary-key field doc_id' END, CASE WHEN source IS NULL OR source = '' THEN 'missing primary-key field source' END, CASE WHEN text IS NULL OR text = '' THEN 'text: required' END,
    CASE WHEN lang NOT IN ('en', 'de') THEN 'lang: not allowed' END], lambda x: x IS NOT NULL)) AS e FROM documents) GROUP BY e""")
def prj10(spark, sf_dir):
    errors = R.schema_errors("doc", ["doc_id", "source"], {"text": {"required": True}, "lang": {"enum": ["en", "de"]}})
    return table(spark, sf_dir, "documents").select(F.explode(errors).alias("error")).groupBy("error").agg(F.count("*").alias("n"))


DETAIL_SQL = "CASE k % 6 WHEN 0 THEN 'Red Card' WHEN 5 THEN NULL ELSE 'Yellow Card' END"


@query("prj18_card_kinds", f"""
    WITH {CLOCKED_SQL}, c AS (SELECT match, idx, k // 8 AS player, {DETAIL_SQL} AS detail FROM e WHERE kind = 'error'), n AS (SELECT *, count(*) FILTER (detail = 'Yellow Card') OVER (PARTITION BY match, player ORDER BY idx) AS y FROM c)
    SELECT match, idx, CASE WHEN detail = 'Yellow Card' THEN CASE WHEN y >= 2 THEN 'second_yellow' ELSE 'yellow' END WHEN detail = 'Red Card' THEN CASE WHEN y >= 1 THEN 'second_yellow_red' ELSE 'direct_red' END ELSE 'other' END AS card FROM n""")
def prj18(spark, sf_dir):
    """Bookings and reds told apart by what a player has had in the match so far."""
    k = F.col("k")
    c = clocked(spark, sf_dir).where("kind = 'error'").select("match", "idx", F.floor(k / 8).alias("player"), F.when(k % 6 == 0, "Red Card").when(k % 6 < 5, "Yellow Card").alias("detail"))
    return R.card_kinds(c, ["match", "player"], ["idx"], "detail").select("match", "idx", "card")


@query("prj13_canonical_results", f"""
    WITH ev2 AS (SELECT l_orderkey AS match, CASE WHEN l_suppkey % 2 = 0 THEN 'home' ELSE 'away' END AS side, CASE WHEN l_partkey % 50 > 0 THEN l_partkey % 125 END AS minute, CASE WHEN l_partkey % 9 = 0 THEN 'Missed Penalty' END AS detail FROM lineitem WHERE l_returnflag <> 'N'),
    g AS (SELECT match, {', '.join(f"count(*) FILTER (side = '{s}' AND minute > {lo} AND minute <= {hi}) AS {n}_events_{s}" for n, lo, hi in (('reg', 0, 90), ('et', 90, 120)) for s in ('home', 'away'))} FROM ev2 WHERE detail IS NULL GROUP BY match),
    f AS (SELECT o_orderkey AS match, CASE WHEN o_custkey % 10 > 0 THEN o_custkey % 3 END AS ft_home, o_orderkey % 2 AS ft_away, CASE WHEN o_custkey % 5 = 0 THEN 1 END AS et_home, CASE WHEN o_custkey % 20 = 0 THEN 4 END AS pen_home FROM orders)
    SELECT f.match, {', '.join(f'coalesce({n}_events_{s}, 0) AS {n}_events_{s}' for n in ('reg', 'et') for s in ('home', 'away'))}, CASE WHEN pen_home IS NOT NULL THEN 'penalty_shootout' WHEN et_home IS NOT NULL THEN 'after_extra_time' ELSE 'regulation' END AS result_type,
        CASE WHEN ft_home = coalesce(reg_events_home, 0) AND ft_away = coalesce(reg_events_away, 0) THEN 'exact' ELSE 'mismatch' END AS status FROM f LEFT JOIN g ON g.match = f.match""")
def prj13(spark, sf_dir):
    """Official results beside those that the events give, and how a match was decided."""
    c, part = F.col("o_custkey"), F.col("l_partkey")
    f = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("match"), F.when(c % 10 > 0, c % 3).alias("ft_home"), (F.col("o_orderkey") % 2).alias("ft_away"), F.when(c % 5 == 0, 1).alias("et_home"), F.when(c % 20 == 0, 4).alias("pen_home"))
    goals = table(spark, sf_dir, "lineitem").where("l_returnflag <> 'N'").select(F.col("l_orderkey").alias("match"), F.when(F.col("l_suppkey") % 2 == 0, "home").otherwise("away").alias("side"), F.when(part % 50 > 0, part % 125).alias("minute"), F.when(part % 9 == 0, "Missed Penalty").alias("detail"))
    return R.canonical_results(f, goals).drop("ft_home", "ft_away", "et_home", "pen_home")


@query("src1_src2_typed_csv", "SELECT o_orderkey, o_custkey, CASE WHEN o_orderkey % 7 > 0 THEN epoch_us(o_orderdate) // 1000000 END AS ordered FROM orders")
def src1(spark, sf_dir):
    """Orders written as CSV, with dates that can't be read, and read back by a schema; columns that must be there are asked for first."""
    o = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", F.when(F.col("o_orderkey") % 7 > 0, F.date_format("o_orderdate", "yyyy-MM-dd HH:mm:ss")).otherwise("no date").alias("o_orderdate"))
    path = f"{shared_folder(spark)}/csv-{uuid.uuid4().hex}"
    R.require_columns(o, ["o_orderkey", "o_orderdate"], "orders").write.csv(path, header=True)
    back = S.read_csv(spark, path, "o_orderkey LONG, o_custkey LONG, o_orderdate STRING", ["o_orderdate"])
    return back.select("o_orderkey", "o_custkey", seconds(F.col("o_orderdate")).alias("ordered"))


@query("mod1_chronological_split", "SELECT CASE WHEN o_orderdate < TIMESTAMP '1997-01-01' THEN 'train' ELSE 'test' END AS side, count(*) AS n FROM orders WHERE o_orderdate IS NOT NULL GROUP BY 1")
def mod1(spark, sf_dir):
    train, test = E.chronological_split(table(spark, sf_dir, "orders"), "o_orderdate", F.lit("1997-01-01").cast("timestamp_ntz"))
    return train.select(F.lit("train").alias("side")).unionByName(test.select(F.lit("test").alias("side"))).groupBy("side").agg(F.count("*").alias("n"))
