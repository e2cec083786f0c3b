"""Queries of in-play models, replays, side panels and evaluation over folds."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import probs as P
from ..operators import evaluation as E
from ..operators import inplay as I
from ..operators import pit
from ..operators.aggregates import forecast_metrics
from ..operators.process import with_possession
from ..sources.tables import CLOCKED_SQL, clocked, table
from ..streaming import ledger as L
from ..streaming import live
from .function_queries import FORECAST_SQL, GRID, forecasts
from .pit_queries import SNAPSHOTS_SQL
from .registry import Registry

query = Registry()

#: Orders as matches with ratings and, for two in three, a market; their lines as goals and red cards with a minute.
MATCHES_SQL = """mt AS (SELECT o_orderkey AS match, (o_custkey % 400 - 200)::DOUBLE AS delta, CASE WHEN o_custkey % 3 > 0 THEN 0.2 + (o_custkey % 5) * 0.1 END AS market_a, CASE WHEN o_custkey % 3 > 0 THEN 0.2 + (o_orderkey % 4) * 0.1 END AS market_b FROM orders),
    ev AS (SELECT l_orderkey AS match, CASE WHEN l_partkey % 50 > 0 THEN l_partkey % 100 END AS minute, CASE WHEN l_returnflag = 'A' THEN 'goal' WHEN l_returnflag = 'R' AND l_linenumber % 2 = 0 THEN 'red' ELSE 'other' END AS kind, CASE WHEN l_suppkey % 2 = 0 THEN 'a' ELSE 'b' END AS side FROM lineitem)"""


def matches(spark, sf_dir):
    c, o = F.col("o_custkey"), F.col("o_orderkey")
    return table(spark, sf_dir, "orders").select(o.alias("match"), (c % 400 - 200).cast("double").alias("delta"), F.when(c % 3 > 0, 0.2 + (c % 5) * 0.1).alias("market_a"), F.when(c % 3 > 0, 0.2 + (o % 4) * 0.1).alias("market_b"))


def match_events(spark, sf_dir):
    kind = F.when(F.col("l_returnflag") == "A", "goal").when((F.col("l_returnflag") == "R") & (F.col("l_linenumber") % 2 == 0), "red").otherwise("other")
    return table(spark, sf_dir, "lineitem").select(
        F.col("l_orderkey").alias("match"), F.when(F.col("l_partkey") % 50 > 0, F.col("l_partkey") % 100).cast("int").alias("minute"), kind.alias("kind"), F.when(F.col("l_suppkey") % 2 == 0, "a").otherwise("b").alias("side"))


def _states_sql(minutes: str) -> str:
    counts = ", ".join(f"count(ev.match) FILTER (ev.kind = '{k}' AND ev.side = '{s}')::INT AS {n}_{s}" for k, n in (("goal", "goals"), ("red", "reds")) for s in "ab")
    return f"""st AS (SELECT mt.match, mt.delta, mt.market_a, mt.market_b, m.minute, {counts} FROM mt CROSS JOIN (SELECT unnest([{minutes}]) AS minute) m LEFT JOIN ev ON ev.match = mt.match AND ev.minute <= m.minute GROUP BY ALL)"""


def _rates_sql(source: str, delta: str) -> str:
    """Rates for the rest of the match from states, by the fixed values of the model."""
    left = "greatest(0, 90 - minute) / 90.0"

    def one(sign: str, lead: str, own: str, other: str) -> str:
        return f"least(5, greatest(0.01, 1.35 * exp({sign}0.2 * {delta} / 100) * {left} * CASE WHEN {lead} < 0 THEN 1 - 0.14 * ({lead}) WHEN {lead} > 0 THEN greatest(0.2, 1 - 0.05 * ({lead})) ELSE 1 END * pow(0.7, {own}) * pow(1.18, {other})))"

    return f"SELECT *, {one('', '(goals_a - goals_b)', 'reds_a', 'reds_b')} AS ra, {one('-', '(goals_b - goals_a)', 'reds_b', 'reds_a')} AS rb FROM {source}"


def _wdl_sql(rates: str, keys: str) -> str:
    """(keys, w, d, l) from rates."""
    return f"""SELECT {keys}, sum(p) FILTER (x > 0) / sum(p) AS w, sum(p) FILTER (x = 0) / sum(p) AS d, sum(p) FILTER (x < 0) / sum(p) AS l
        FROM (SELECT {keys}, i - j + goals_a - goals_b AS x, exp(-ra) * pow(ra, i) / factorial(i::INT) * exp(-rb) * pow(rb, j) / factorial(j::INT) AS p FROM {rates}, ({GRID})) GROUP BY {keys}"""


NORMAL_SQL = "greatest(coalesce({0}, 0), 1e-12) / (greatest(coalesce(w, 0), 1e-12) + greatest(coalesce(d, 0), 1e-12) + greatest(coalesce(l, 0), 1e-12))"


@query("str8_replay", f"""
    WITH {MATCHES_SQL}, {_states_sql('15, 45, 60, 90')}, r AS ({_rates_sql('st', 'delta')}), v AS ({_wdl_sql('r', 'match, minute')}),
    n AS (SELECT match, minute, {NORMAL_SQL.format('w')} AS p_a, {NORMAL_SQL.format('d')} AS p_draw, {NORMAL_SQL.format('l')} AS p_b FROM v),
    e AS (SELECT *, -(p_a * ln(p_a) + p_draw * ln(p_draw) + p_b * ln(p_b)) / ln(3) AS entropy, 1.96 * sqrt(p_draw * (1 - p_draw) / (80 + 0.5 * minute)) AS half FROM n)
    SELECT r.match, r.minute, goals_a, goals_b, reds_a, reds_b, p_a, p_draw, p_b, ra + rb AS remaining, greatest(0, p_draw - half) AS draw_low, least(1, p_draw + half) AS draw_high, entropy,
        CASE WHEN entropy < 0.55 THEN 'low' WHEN entropy < 0.85 THEN 'medium' ELSE 'high' END AS band FROM r JOIN e ON e.match = r.match AND e.minute = r.minute""")
def str8(spark, sf_dir):
    """Every match replayed through decision minutes, from what was known at each."""
    out = I.replay(I.states_at(match_events(spark, sf_dir), matches(spark, sf_dir), [15, 45, 60, 90]))
    return out.select("match", "minute", "goals_a", "goals_b", "reds_a", "reds_b", "p_a", "p_draw", "p_b", "remaining", "draw_low", "draw_high", "entropy", "band")


MARKET_SQL = "CASE WHEN market_a + market_b > 0 THEN 400 * log10(least(0.9999, greatest(0.0001, market_a / (market_a + market_b))) / (1 - least(0.9999, greatest(0.0001, market_a / (market_a + market_b))))) ELSE delta END"


@query("mod27_inplay_models", f"""
    WITH {MATCHES_SQL}, {_states_sql('30, 60')}, z AS (SELECT *, {MARKET_SQL} AS md, 1 / (1 + pow(10, -delta / 400)) AS q FROM st), r2 AS ({_rates_sql('z', 'delta')}), r6 AS ({_rates_sql('z', 'md')}),
    v AS (SELECT 'M2_remaining_poisson' AS model, * FROM ({_wdl_sql('r2', 'match, minute')}) UNION ALL SELECT 'M6_market_inplay', * FROM ({_wdl_sql('r6', 'match, minute')})
        UNION ALL SELECT 'M0_static_b1', match, minute, q * q + 0.4 * q * (1 - q), 1.2 * q * (1 - q), (1 - q) * (1 - q) + 0.4 * q * (1 - q) FROM z)
    SELECT match, minute, model, {NORMAL_SQL.format('w')} AS p_a, {NORMAL_SQL.format('d')} AS p_draw, {NORMAL_SQL.format('l')} AS p_b FROM v""")
def mod27(spark, sf_dir):
    """Fixed-parameter models on one table of states: before the match, by ratings, by the market."""
    states = I.states_at(match_events(spark, sf_dir), matches(spark, sf_dir), [30, 60])
    return I.predictions(states).select("match", "minute", "model", "p_a", "p_draw", "p_b")


LIVE_SQL = f"""{MATCHES_SQL}, all_e AS (SELECT l_orderkey * 10 + l_linenumber AS event_id, l_orderkey AS match, l_shipdate AS ts, CASE WHEN l_partkey % 50 > 0 THEN l_partkey % 100 END AS minute, CASE WHEN l_returnflag = 'A' THEN 'goal' WHEN l_returnflag = 'R' AND l_linenumber % 2 = 0 THEN 'red' ELSE 'other' END AS kind, CASE WHEN l_suppkey % 2 = 0 THEN 'a' ELSE 'b' END AS side FROM lineitem),
    once AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY event_id ORDER BY ts NULLS FIRST, minute NULLS FIRST, kind, side, match) AS rn FROM all_e) WHERE rn = 1),
    st AS (SELECT once.match, any_value(delta) AS delta, max(minute) AS minute, {', '.join(f"count(*) FILTER (kind = '{k}' AND side = '{s}')::INT AS {n}_{s}" for k, n in (('goal', 'goals'), ('red', 'reds')) for s in 'ab')} FROM once JOIN mt ON mt.match = once.match GROUP BY once.match HAVING max(minute) IS NOT NULL)"""


@query("str6_live_records", f"""
    WITH {LIVE_SQL}, r AS ({_rates_sql('st', 'delta')}), v AS ({_wdl_sql('r', 'match, minute')})
    SELECT v.match, v.minute::INT AS minute, goals_a, goals_b, reds_a, reds_b, 1.0::DOUBLE AS completeness, {NORMAL_SQL.format('w')} AS p_a, {NORMAL_SQL.format('d')} AS p_draw, {NORMAL_SQL.format('l')} AS p_b FROM v JOIN r ON r.match = v.match""")
def str6(spark, sf_dir):
    """Records from live states: here all events have come, some of them repeatedly; the tests run it on a stream."""
    lines = table(spark, sf_dir, "lineitem")
    kind = F.when(F.col("l_returnflag") == "A", "goal").when((F.col("l_returnflag") == "R") & (F.col("l_linenumber") % 2 == 0), "red").otherwise("other")
    e = lines.select((F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("event_id"), F.col("l_orderkey").alias("match"), F.col("l_shipdate").cast("timestamp").alias("ts"), F.when(F.col("l_partkey") % 50 > 0, F.col("l_partkey") % 100).cast("int").alias("minute"), kind.alias("kind"), F.when(F.col("l_suppkey") % 2 == 0, "a").otherwise("b").alias("side"))
    m = matches(spark, sf_dir).select("match", "delta", F.lit("2100-01-01").cast("timestamp").alias("decision_ts"))
    out = live.live_records(e, m).where("minute is not null")
    return out.select("match", "minute", "goals_a", "goals_b", "reds_a", "reds_b", "completeness", "p_a", "p_draw", "p_b")


RESULT_SQL = """pr AS (SELECT o_orderkey AS match, 0.2 + (o_custkey % 5) * 0.1 AS pa, 0.1 + (o_orderkey % 3) * 0.05 AS pd, o_custkey % 11 > 0 AS early, o_orderkey % 13 > 0 AS known FROM orders),
    rs AS (SELECT o_orderkey AS match, v, CASE (o_orderkey + v * (o_orderkey % 17 = 0)::INT) % 3 WHEN 0 THEN 'A' WHEN 1 THEN 'D' ELSE 'B' END AS outcome, o_orderkey % 7 > 0 AS final FROM orders, (VALUES (0), (1)) t(v))"""


@query("str2_rescored_ledger", f"""
    WITH {RESULT_SQL}, s AS (SELECT DISTINCT pr.match, outcome, pa, pd, 1 - pa - pd AS pb FROM pr JOIN rs ON rs.match = pr.match WHERE final AND early AND known)
    SELECT match, outcome, 'v1' AS scorer, (pow(pa - (outcome = 'A')::INT, 2) + pow(pa + pd - (outcome IN ('A', 'D'))::INT, 2)) / 2 AS rps,
        -ln(greatest(CASE outcome WHEN 'A' THEN pa WHEN 'D' THEN pd ELSE pb END, 1e-12)) AS log_loss FROM s""")
def str2(spark, sf_dir):
    """Scores of a first delivery of results, then of one that repeats all and corrects some: a correction adds a row, a repeat none."""
    o, k, c = table(spark, sf_dir, "orders"), F.col("o_orderkey"), F.col("o_custkey")
    kickoff = F.col("o_orderdate").cast("timestamp")
    made = F.when(c % 11 > 0, kickoff - F.expr("INTERVAL 1 HOUR")).otherwise(kickoff)
    a, d = 0.2 + (c % 5) * 0.1, 0.1 + (k % 3) * 0.05
    source = F.when(k % 13 > 0, made).otherwise(made + F.expr("INTERVAL 6 SECONDS"))
    predictions = o.select(k.alias("match"), F.lit("m").alias("model"), made.alias("made"), source.alias("source"), kickoff.alias("kickoff"), a.alias("p_a"), d.alias("p_draw"), (1 - a - d).alias("p_b"))
    of = lambda v: F.element_at(F.array(*map(F.lit, "ADB")), ((k + F.when(k % 17 == 0, v).otherwise(0)) % 3 + 1).cast("int"))
    results = lambda v: o.select(k.alias("match"), F.when(k % 7 > 0, L.FINAL).otherwise("open").alias("status"), of(v).alias("outcome"), F.lit(None).cast("int").alias("goals_a"), F.lit(None).cast("int").alias("goals_b"))
    first = L.first_writes(L.score_rows(predictions, results(0), "v1").where("score_key is not null"), None, "score_key", "score_key")
    both = results(0).unionByName(results(1)).distinct()
    again = L.first_writes(L.score_rows(predictions, both, "v1").where("score_key is not null"), first.select("score_key"), "score_key", "score_key")
    return first.unionByName(again).select("match", "outcome", "scorer", "rps", "log_loss")


@query("str5_session_counts", f"""
    WITH {CLOCKED_SQL}, g AS (SELECT match * 1000 + k AS key, count(*) AS times, arg_min(kind, idx) AS event FROM e GROUP BY 1), x AS (SELECT DISTINCT match * 1000 + u.k AS key FROM e, (SELECT unnest(range(0, 100)) AS k) u)
    SELECT event, sum(n)::BIGINT AS n FROM (SELECT event, 1 AS n FROM g UNION ALL SELECT 'duplicate', times - 1 FROM g WHERE times > 1 UNION ALL SELECT 'missed', 1 FROM x WHERE key NOT IN (SELECT key FROM g)) GROUP BY event""")
def str5(spark, sf_dir):
    """A session's log: each key once, repeats counted, expected keys that never came."""
    e = clocked(spark, sf_dir)
    log = e.select((F.col("match") * 1000 + F.col("k")).alias("event_key"), F.col("kind").alias("event"), F.col("idx").alias("at"))
    expected = e.select("match").distinct().select(F.explode(F.sequence(F.col("match") * 1000, F.col("match") * 1000 + 99)).alias("event_key"))
    return live.session_counts(log, expected)


# ---------------------------------------------------------------- both sides' states

#: What an event adds, as SQL over (kind, x, k, idx).
MEASURES = {
    "goals": "CASE WHEN kind = 'purchase' THEN 1 END", "reds": "CASE WHEN kind = 'error' AND k % 5 = 0 THEN 1 END", "yellows": "CASE WHEN kind = 'error' AND k % 5 > 0 THEN 1 END", "subs": "CASE WHEN kind = 'signup' THEN 1 END",
    "shots": "CASE WHEN kind = 'click' THEN 1 END", "on_target": "CASE WHEN kind = 'click' AND x > 50 THEN 1 END", "xg": "CASE WHEN kind = 'click' THEN x / 100.0 END", "xg_seen": "CASE WHEN kind = 'click' AND x IS NOT NULL THEN 1 END",
    "final_third": "CASE WHEN idx * 7 % 121 >= 80 THEN 1 END", "box": "CASE WHEN idx * 7 % 121 >= 102 AND idx * 11 % 81 BETWEEN 18 AND 62 THEN 1 END", "set_pieces": "CASE WHEN kind = 'view' AND k % 10 = 0 THEN 1 END", "won": "CASE WHEN new = 1 THEN 1 END",
}
END, ROLLING, SOON = 1_706_000_000, (("shots", 3600), ("xg", 86_400)), 43_200


def _panel_sql() -> str:
    sides = {"home": 0, "away": 1}
    past = ", ".join(f"round(coalesce(sum(({v})::DOUBLE) FILTER (et <= t AND k % 2 = {n}), 0), 6) AS {m}_{s}" for m, v in MEASURES.items() for s, n in sides.items())
    last = ", ".join(f"round(coalesce(sum(({MEASURES[m]})::DOUBLE) FILTER (et <= t AND et > t - {w} AND k % 2 = {n}), 0), 6) AS {m}_last_{w}_{s}" for m, w in ROLLING for s, n in sides.items())
    goal = f"kind = 'purchase' AND et > t AND et <= {END}"
    ahead = ", ".join(f"min(et) FILTER ({goal} AND k % 2 = {n}) AS nx_{s}, count(*) FILTER ({goal} AND k % 2 = {n})::BIGINT AS remaining_{s}" for s, n in sides.items())
    names = ", ".join(f"{m}_{s}" for m in [*MEASURES, *(f"{m}_last_{w}" for m, w in ROLLING)] for s in sides)
    return f"""WITH {CLOCKED_SQL}, {SNAPSHOTS_SQL}, o AS (SELECT *, CASE WHEN k % 2 IS DISTINCT FROM lag(k % 2) OVER (PARTITION BY match ORDER BY t, idx) THEN 1 ELSE 0 END AS new FROM e),
    j AS (SELECT s.match, s.t, o.t AS et, o.kind, o.x, o.k, o.idx, o.new FROM s LEFT JOIN o ON s.match = o.match), a AS (SELECT match, t, {past}, {last}, {ahead} FROM j GROUP BY match, t)
    SELECT match, t, {names}, remaining_home, remaining_away, least(nx_home, nx_away) - t AS next_goal, CASE WHEN nx_home = least(nx_home, nx_away) THEN 'home' WHEN nx_away = least(nx_home, nx_away) THEN 'away' ELSE 'none' END AS next_goal_side,
        coalesce((nx_home - t <= {SOON})::INT, 0) AS goal_in_{SOON}_home, coalesce((nx_away - t <= {SOON})::INT, 0) AS goal_in_{SOON}_away, 11 - reds_home AS players_home, 11 - reds_away AS players_away,
        CASE WHEN won_home + won_away > 0 THEN won_home / (won_home + won_away) END AS possession_home FROM a"""


@query("win5_win8_side_panel", _panel_sql())
def side_panel(spark, sf_dir):
    """WIN5 to WIN8, LAB2, LAB3, LAB5: score, cards, players, chances, territory and possession of both sides, and what comes."""
    e = clocked(spark, sf_dir)
    s = pit.snapshot_schedule(e, ["purchase"], 21_600)
    e = with_possession(e.withColumn("team", F.col("k") % 2))
    before = F.lag("possession").over(Window.partitionBy("match").orderBy("t", "idx"))
    e = e.withColumns({"new": F.when(before.eqNullSafe(F.col("possession")), 0).otherwise(1), "side": F.when(F.col("k") % 2 == 0, "home").when(F.col("k") % 2 == 1, "away")})
    goal = (F.col("kind") == "purchase") & (F.col("t") <= END)
    out = pit.side_panel(e, s, {m: F.expr(v) for m, v in MEASURES.items()}, goal, [SOON], ROLLING)
    sums = [f"{m}_{x}" for m in [*MEASURES, *(f"{m}_last_{w}" for m, w in ROLLING)] for x in pit.SIDES]
    won = F.col("won_home") + F.col("won_away")
    out = out.withColumns({c: F.round(c, 6) for c in sums} | {"players_home": 11 - F.col("reds_home"), "players_away": 11 - F.col("reds_away"), "possession_home": F.when(won > 0, F.col("won_home") / won)})
    return out


# ---------------------------------------------------------------- evaluation over folds


def _rps_sql(a: str, d: str) -> str:
    return f"(pow({a} - (outcome = 'A')::INT, 2) + pow({a} + {d} - (outcome IN ('A', 'D'))::INT, 2)) / 2"


YEARS_SQL = """y AS (SELECT year(l_shipdate) AS test_year, l_suppkey, l_discount, l_quantity, CASE l_returnflag WHEN 'A' THEN 'A' WHEN 'N' THEN 'D' ELSE 'B' END AS outcome FROM lineitem),
    c AS (SELECT test_year, count(*) AS n, count(*) FILTER (outcome = 'A') AS na, count(*) FILTER (outcome = 'D') AS nd, count(*) FILTER (outcome = 'B') AS nb FROM y GROUP BY 1),
    b AS (SELECT test_year, sum(n) OVER w AS n, sum(na) OVER w AS na, sum(nd) OVER w AS nd, sum(nb) OVER w AS nb FROM c WINDOW w AS (ORDER BY test_year ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
    p AS (SELECT test_year, n::BIGINT AS n_train, (na + 1) / (n + 3) AS pa, (nd + 1) / (n + 3) AS pd, (nb + 1) / (n + 3) AS pb FROM b WHERE n > 0)"""


def _metrics_sql(by: str) -> str:
    return f"count(*) AS n, avg({_rps_sql('pa', 'pd')}) AS rps, avg(-ln(CASE outcome WHEN 'A' THEN pa WHEN 'D' THEN pd ELSE pb END)) AS log_loss, avg(pow(pd - (outcome = 'D')::INT, 2)) AS draw_brier"


def _outcomes(spark, sf_dir):
    outcome = F.when(F.col("l_returnflag") == "A", "A").when(F.col("l_returnflag") == "N", "D").otherwise("B")
    return table(spark, sf_dir, "lineitem").select(F.year("l_shipdate").alias("test_year"), outcome.alias("outcome"), "l_suppkey", "l_discount", "l_quantity")


@query("mod2_year_folds", f"""
    WITH {YEARS_SQL}, s AS (SELECT y.*, p.pa, p.pd, p.pb, p.n_train, least(9, floor(p.pd * 10)) AS bin FROM y JOIN p ON p.test_year = y.test_year),
    r AS (SELECT test_year, sum(n * gap) / sum(n) AS draw_calibration_error FROM (SELECT test_year, bin, count(*) AS n, abs(avg(pd) - avg((outcome = 'D')::INT)) AS gap FROM s GROUP BY ALL) GROUP BY test_year),
    m AS (SELECT test_year, any_value(n_train) AS n_train, {_metrics_sql('test_year')} FROM s GROUP BY test_year)
    SELECT m.test_year, n_train, n, rps, log_loss, draw_brier, draw_calibration_error, 0.40 * rps + 0.25 * log_loss + 0.20 * draw_brier + 0.15 * draw_calibration_error AS composite FROM m JOIN r ON r.test_year = m.test_year""")
def mod2(spark, sf_dir):
    """Each year forecast from all years before it, and its composite score."""
    y = _outcomes(spark, sf_dir)
    fitted = E.prior_rates(y, F.col("test_year"), "outcome")
    scored = y.join(F.broadcast(fitted), "test_year")  # one row a year
    out = E.composite(E.fold_metrics(scored, ["test_year"])).join(fitted.select("test_year", "n_train"), "test_year")
    return out.select("test_year", "n_train", "n", "rps", "log_loss", "draw_brier", "draw_calibration_error", "composite")


@query("mod5_nested_selection", f"""
    WITH {FORECAST_SQL}, m AS (SELECT l_suppkey % 8 AS held, m AS model, CASE m WHEN 'raw' THEN {_rps_sql('pa', 'pd')} WHEN 'blend' THEN {_rps_sql('(0.5 * pa + 0.5 / 3)', '(0.5 * pd + 0.5 / 3)')} ELSE {_rps_sql('1 / 3.0', '1 / 3.0')} END AS s FROM p, (SELECT unnest(['raw', 'blend', 'uniform']) AS m)),
    fs AS (SELECT held, model, sum(s) AS total, count(*) AS n FROM m GROUP BY ALL), i AS (SELECT *, (sum(total) OVER w - total) / (sum(n) OVER w - n) AS inner_score FROM fs WINDOW w AS (PARTITION BY model)),
    r AS (SELECT *, row_number() OVER (PARTITION BY held ORDER BY inner_score, model) AS k FROM i) SELECT held, model, inner_score AS "inner", total / n AS "outer" FROM r WHERE k = 1""")
def mod5(spark, sf_dir):
    """The model that is best on the other folds, and what it scores on the held one."""
    f, third = forecasts(spark, sf_dir), F.lit(1 / 3)
    p = [F.col(c) for c in ("pa", "pd", "pb")]
    models = {"raw": p, "blend": [0.5 * c + 0.5 / 3 for c in p], "uniform": [third] * 3}
    each = F.array(*(F.struct(F.lit(m).alias("model"), P.rps(*c, F.col("outcome")).alias("s")) for m, c in models.items()))
    rows = f.select((F.col("l_suppkey") % 8).alias("held"), F.explode(each).alias("m")).select("held", "m.*")
    return E.nested_selection(rows.groupBy("held", "model").agg(F.sum("s").alias("total"), F.count("*").alias("n")), "held", "model", "total", "n")


def _factory(train):
    """Outcome rates of the training rows, and two models of the rating difference."""
    n = train.agg(F.count("*").alias("_n"), *(F.count_if(F.col("outcome") == y).alias(f"_{y}") for y in "ADB"))
    delta = F.col("l_quantity") * 10 - 250

    def prior(df):
        return df.join(F.broadcast(n)).withColumns({p: (F.col(f"_{y}") + 1) / (F.col("_n") + 3) for y, p in zip("ADB", ("pa", "pd", "pb"))}).drop("_n", "_A", "_D", "_B")

    def ternary(df):
        return df.withColumns(dict(zip(("pa", "pd", "pb"), P.ternary_probs(delta))))

    def gaussian(df):
        draw, win = P.gaussian_draw(delta), P.expected_score(delta)
        return df.withColumns({"pa": (1 - draw) * win, "pd": draw, "pb": (1 - draw) * (1 - win)})

    return {"historical_prior": prior, "ternary_elo": ternary, "gaussian_draw": gaussian}


def _models_sql(train: str, test: str) -> str:
    """All models of _factory on test rows (fold), fitted on train rows of earlier folds (fold before)."""
    return f"""e AS (SELECT {test}.*, 1 / (1 + pow(10, -(l_quantity * 10 - 250) / 400)) AS q, 0.3 * exp(-pow(l_quantity * 10 - 250, 2) / 115200) AS g FROM {test}),
    s AS (SELECT e.fold, 'historical_prior' AS model, outcome, (na + 1) / (n + 3) AS pa, (nd + 1) / (n + 3) AS pd, (nb + 1) / (n + 3) AS pb, e.l_discount FROM e JOIN {train} t ON t.fold = e.fold
        UNION ALL SELECT fold, 'ternary_elo', outcome, q * q + 0.4 * q * (1 - q), 1.2 * q * (1 - q), (1 - q) * (1 - q) + 0.4 * q * (1 - q), l_discount FROM e UNION ALL SELECT fold, 'gaussian_draw', outcome, (1 - g) * q, g, (1 - g) * (1 - q), l_discount FROM e)"""


@query("mod24_walk_forward", f"""
    WITH {YEARS_SQL}, te AS (SELECT 1 AS fold, * FROM y WHERE test_year >= 1999), tr AS (SELECT 1 AS fold, sum(n) AS n, sum(na) AS na, sum(nd) AS nd, sum(nb) AS nb FROM c WHERE test_year < 1999), {_models_sql('tr', 'te')}
    SELECT model, {_metrics_sql('model')}, count(*) FILTER (pd - (0.2137 + l_discount) >= 0.03) AS edges FROM s GROUP BY model""")
def mod24(spark, sf_dir):
    """Models fitted before 1999, a row of metrics each, and how many edges over the market they see."""
    y = _outcomes(spark, sf_dir).withColumn("p_market", 0.2137 + F.col("l_discount"))
    metrics, _, edges = E.walk_forward(y, F.col("test_year") >= 1999, _factory)
    n = edges.groupBy("model").agg(F.count("*").alias("edges"))
    return metrics.join(n, "model", "left").na.fill(0, ["edges"]).select("model", "n", "rps", "log_loss", "draw_brier", "edges")


@query("mod25_over_folds", f"""
    WITH {YEARS_SQL}, te AS (SELECT test_year AS fold, * FROM y WHERE test_year IN (SELECT test_year FROM p)), tr AS (SELECT test_year AS fold, n, na, nd, nb FROM b), {_models_sql('tr', 'te')}
    SELECT fold AS test_year, model, {_metrics_sql('fold, model')} FROM s GROUP BY fold, model""")
def mod25(spark, sf_dir):
    """The callback over folds: models made from all earlier years, scored on each year."""
    y = _outcomes(spark, sf_dir)
    years = sorted(r["test_year"] for r in y.select("test_year").distinct().collect())  # a few years
    scored = E.over_folds(y, "test_year", _factory, years)
    return forecast_metrics(scored, ["test_year", "model"]).select("test_year", "model", "n", "rps", "log_loss", "draw_brier")
