"""Player histories, rolling windows, payloads and results on small cases, by hand or by replay."""

import json
import random

import pytest
from pyspark.sql import functions as F

from pitspark.operators import evaluation as E
from pitspark.operators import history as H
from pitspark.operators import inplay as I
from pitspark.operators import projections as R
from pitspark.sources import extract as X
from pitspark.sources import nested as N


def rows(df, *columns):
    return sorted((tuple(r) for r in df.select(*columns).collect()), key=str)


def test_exposure_by_hand(spark):
    apps = [(1, 10, 1, 90.0, True, "M"), (1, 10, 2, 30.0, False, None), (1, 12, 3, 60.0, True, "D"), (1, 15, 4, None, None, "D"), (2, 10, 1, 5.0, False, None), (2, 11, 5, 5.0, False, "G")]
    out = H.exposure(spark.createDataFrame(apps, "player long, day long, id long, minutes double, started boolean, position string"), ["player"], "day", ["id"])
    got = {(r["player"], r["day"]): r for r in out.collect()}
    first = got[1, 10]
    assert (first["prior_appearances"], first["unknown"], first["position"], first["days_since"], first["availability"], first["uncertainty"]) == (0, True, "unknown", None, 0.0, 1.0)
    # both rows of day 10 count on day 12, and neither sees the other
    second = got[1, 12]
    assert (second["prior_appearances"], second["prior_starts"], second["prior_minutes"], second["days_since"], second["position"], second["share_M"]) == (2, 1, 120.0, 2, "M", 1.0)
    # a tie of positions goes to the first by code point; an unknown minute is 0 and an unknown start none
    third = got[1, 15]
    assert (third["position"], third["share_D"], third["minutes_last5"], third["availability"]) == ("D", 0.5, 180.0, (2 + 1.5) / 6)
    assert got[2, 11]["position"] == "sub" and got[2, 11]["exposure"] == 5 / 275
    assert H.exposure(spark.createDataFrame([], "player long, day long, id long, minutes double, started boolean, position string"), ["player"], "day", ["id"]).count() == 0


def test_recent_appearances_against_a_replay(spark):
    dice = random.Random(3)
    apps = [(dice.randrange(4), dice.randrange(30), i, float(dice.randrange(91)), dice.random() < 0.6, dice.choice("GDMF")) for i in range(300)]
    out = H.exposure(spark.createDataFrame(apps, "player long, day long, id long, minutes double, started boolean, position string"), ["player"], "day", ["id"])
    for r in out.collect():
        before = sorted((a for a in apps if a[0] == r["player"] and a[1] < r["day"]), key=lambda a: (a[1], a[2]))
        assert r["prior_appearances"] == len(before) and r["minutes_last10"] == sum(a[3] for a in before[-10:]) and r["starts_last5"] == sum(a[4] for a in before[-5:])


def test_substitutions_are_scaled_by_what_is_left(spark):
    priors = spark.createDataFrame([(1, 5, 0.9, 10, "D"), (2, 5, 0.4, 10, "F"), (3, 5, 0.1, 2, "D")], "player long, day long, prior double, appearances long, position string")
    subs = [(1, 1, 2, 5, 60, -1), (2, 1, 3, 5, None, None), (3, None, 2, 5, 120, 1), (4, 1, 9, 5, -4, 0)]
    out = H.substitution_deltas(spark.createDataFrame(subs, "id long, player_in long, player_out long, day long, minute int, lead int"), priors, "day")
    got = {r["id"]: r for r in out.collect()}
    assert got[1]["delta"] == pytest.approx(0.5) and got[1]["scaled_delta"] == pytest.approx(0.5 / 3 * 0.85) and got[1]["imbalance"] and not got[1]["low_history"]
    assert got[2]["scaled_delta"] == pytest.approx(0.8) and got[2]["same_position"] and got[2]["low_history"] and not got[2]["unknown_out"]
    assert got[3]["delta"] == pytest.approx(-0.4) and got[3]["scaled_delta"] == 0 and got[3]["unknown_in"]
    assert got[4]["scaled_delta"] == pytest.approx(0.9) and got[4]["unknown_out"]


def test_form_of_a_lineup(spark):
    records = spark.createDataFrame([(1, 1, 6.0), (1, 2, 8.0), (1, 5, 1.0), (2, 4, None), (3, 4, 5.0)], "player long, day long, rating double")
    xi = spark.createDataFrame([(7, 1, 5), (7, 2, 5), (7, 3, 5), (7, 4, 5), (8, 2, 5)], "match long, player long, day long")
    assert rows(H.lineup_form(xi, records, ["match"], "day"), "match", "form", "coverage") == [(7, 6.0, 0.5), (8, None, 0.0)]


def test_key_players_are_the_same_however_days_are_cut(spark):
    dice = random.Random(9)
    played = [(dice.randrange(2), dice.randrange(12), dice.randrange(200), float(dice.choice((0, 10, 45, 90)))) for _ in range(400)]
    xi = [(t, m, dice.randrange(12), d) for t in (0, 1) for m, d in ((t * 1000 + i, dice.randrange(-5, 260)) for i in range(60)) for _ in range(5)]
    want = set()
    for team, match, day in {(t, m, d) for t, m, _, d in xi}:
        total, first = {}, {}
        for t, p, d, m in played:
            if t == team and d < day:
                total[p], first[p] = total.get(p, 0) + m, min(first.get(p, d), d)
        top = sorted((p for p in total if total[p] > 0), key=lambda p: (-total[p], first[p], p))[:4]
        have = {p for t, m, p, _ in xi if (t, m) == (team, match)}
        want.add((team, match, round(len(have & set(top)) / len(top), 9) if top else None, len(top) / 4))
    a, b = spark.createDataFrame(xi, "team long, match long, player long, day long"), spark.createDataFrame(played, "team long, player long, day long, minutes double")
    for days in (1, 7, 1000):
        got = {(r[0], r[1], None if r[2] is None or r[2] != r[2] else round(r[2], 9), r[3]) for r in H.key_players(a, b, "day", 4, days).collect()}
        assert got == want
    lost = H.key_players(spark.createDataFrame([(0, 1, None, 300), (0, 2, None, -9)], "team long, match long, player long, day long"), b, "day", 4)
    assert sorted((r[1], r[2] if r[2] == r[2] else None, r[3]) for r in lost.collect()) == [(1, 0.0, 1.0), (2, None, 0.0)]


def test_windows_hold_both_of_their_ends(spark):
    dice = random.Random(5)
    events = [(dice.randrange(2), dice.randrange(100), dice.choice(("home", "away", None)), dice.choice((None, 1.0, 2.0))) for _ in range(150)]
    at = [(m, t) for m in (0, 1, 2) for t in range(0, 120, 10)]
    spans = ((0, 10), (0, 20), (10, 20))
    out = H.rolling_sides(spark.createDataFrame(events, "match long, t long, side string, x double"), spark.createDataFrame(at, "match long, t long"), {"x": F.col("x")}, spans, lambda t: (t >= 45).cast("int"))
    got = H.pace(out, "x", 10, 20).collect()
    assert len(got) == len(at)
    for r in got:
        for s in ("home", "away"):
            mine = [(t, x or 0) for m, t, side, x in events if m == r["match"] and side == s]
            for lo, hi in spans:
                assert r[f"x_{H.span_name(lo, hi)}_{s}"] == sum(x for t, x in mine if r["t"] - hi <= t <= r["t"] - lo)
            assert r[f"x_half_{s}"] == sum(x for t, x in mine if t <= r["t"] and (t >= 45) == (r["t"] >= 45))
        assert r["x_momentum"] == pytest.approx((r["x_last_20_home"] - r["x_last_20_away"]) * 3)
        assert r["x_acceleration"] == pytest.approx((r["x_last_10_home"] - r["x_last_10_away"] - r["x_10_to_20_home"] + r["x_10_to_20_away"]) * 6)


def test_a_sendoff_after_a_snapshot(spark):
    panel = spark.createDataFrame([(1, 0, 0, 0), (1, 5, 1, 0), (1, 9, 1, 1), (2, 0, None, 0), (2, 3, 0, 0)], "match long, t long, a long, b long")
    assert rows(H.sendoff_after(panel, ["a", "b"]), "match", "t", "sendoff_after") == [(1, 0, 1), (1, 5, 1), (1, 9, 0), (2, 0, 0), (2, 3, 0)]


def test_goal_dynamics_at_the_end_of_a_match(spark):
    df = spark.createDataFrame([(1.2, 0.8, 45.0), (0.01, 0.01, 0.0), (0.5, 1.5, 2.0)], "a double, b double, rest double")
    got = [r.asDict() for r in df.select(*(c.alias(n) for n, c in I.goal_dynamics(F.col("a"), F.col("b"), F.col("rest")).items())).collect()]
    assert got[0]["next_goal_a"] == pytest.approx(0.6) and got[0]["goal_in_5"] == pytest.approx(1 - 2.718281828459045 ** (-2 * 5 / 45)) and got[0]["no_goal_5"] + got[0]["goal_in_5"] == pytest.approx(1)
    # beyond what is left all horizons are the same
    assert got[2]["goal_in_3"] == got[2]["goal_in_10"] > got[2]["goal_in_1"]
    assert all(0 <= got[1][f"goal_in_{h}"] < 0.03 for h in I.HORIZONS)


def test_payloads_of_players(spark):
    events = [{"type": "subst", "time": {"elapsed": 60}, "team": {"id": 1}, "player": {"id": 5}, "assist": {"id": 6}}, {"type": "Subst", "player": {"id": 7}}, {"type": None}, {"type": "Goal", "player": {"id": 5}}]
    df = spark.createDataFrame([(1, json.dumps(events)), (2, None), (3, "{"), (4, "[]")], "m long, p string")
    assert rows(N.substitutions(df, "m", F.col("p")), "m", "minute", "team", "player_in", "player_out") == [(1, 60, 1, 5, 6), (1, None, None, 7, None)]
    one = lambda i, **games: {"player": {"id": i}, "statistics": [{"games": games}]}
    team = [{"team": {"id": 1}, "players": [one(5, minutes=90, rating="7.2", substitute=False), one(6, minutes=None, rating="", substitute=True), one(7, rating="-"), {"player": {"id": 8}, "statistics": []}]}]
    got = N.player_matches(spark.createDataFrame([(1, json.dumps(team)), (2, None)], "m long, p string"), "m", F.col("p"))
    assert rows(got, "player", "minutes", "rating", "started") == [(5, 90.0, 7.2, True), (6, 0.0, None, False), (7, 0.0, None, False), (8, 0.0, None, False)]
    totals = [{"team": {"id": 1}, "statistics": [{"type": "expected_goals", "value": "1.4"}]}, {"team": {"id": 2}, "statistics": [{"type": "shots", "value": "3"}]}, {"team": {"id": 3}, "statistics": [{"type": "Expected_Goals", "value": ""}]}]
    got = N.team_totals(spark.createDataFrame([(1, json.dumps(totals))], "m long, p string"), "m", F.col("p"))
    assert rows(got, "team", "total") == [(1, 1.4), (2, None), (3, None)]


def test_segments_keep_a_hash_of_the_text_as_it_is(spark):
    df = spark.createDataFrame([(1, " a \n b ", 1.9), (2, None, None), (3, "\t", 0.0), (4, "go", 3.0), (5, "ziel\x1cda", 4.0)], "id long, text string, at double")
    got = {r["id"]: r for r in X.segment_records(df, F.col("text"), F.col("at")).collect()}
    assert {i: (r["norm"], r["quality"], r["clock_s"]) for i, r in got.items()} == {1: ("a b", "ok", 1), 2: ("", "empty", None), 3: ("", "empty", 0), 4: ("go", "too_short", 3), 5: ("ziel da", "ok", 4)}
    assert got[2]["content_hash"] == "e3b0c44298fc1c149afbf4c8996fb92427ae41e4649b934ca495991b7852b855" != got[3]["content_hash"]


def test_cards_results_and_schemas(spark):
    cards = [(1, 7, 1, "Yellow Card"), (1, 7, 2, "Red Card"), (1, 8, 3, "red card"), (1, 9, 4, "Yellow Card"), (1, 9, 5, "Second Yellow card"), (1, 9, 6, None), (2, 7, 7, "Red Card")]
    got = R.card_kinds(spark.createDataFrame(cards, "match long, player long, idx long, detail string"), ["match", "player"], ["idx"], "detail")
    assert [c for _, c in rows(got, "idx", "card")] == ["yellow", "second_yellow_red", "direct_red", "yellow", "second_yellow", "other", "direct_red"]
    f = spark.createDataFrame([(1, 1, 0, None, None), (2, 0, 0, 1, 4), (3, None, 0, 1, None)], "match long, ft_home int, ft_away int, et_home int, pen_home int")
    goals = [(1, "home", 90, "Normal Goal"), (1, "away", 12, "Missed Penalty"), (1, "away", None, None), (2, "home", 91, None), (2, "away", 120, "Own Goal"), (2, "home", 121, None), (3, "away", 1, "Goal cancelled")]
    got = R.canonical_results(f, spark.createDataFrame(goals, "match long, side string, minute int, detail string"))
    assert rows(got, "match", "reg_events_home", "reg_events_away", "et_events_home", "et_events_away", "result_type", "status") == [(1, 1, 0, 0, 0, "regulation", "exact"), (2, 0, 0, 1, 1, "penalty_shootout", "exact"), (3, 0, 0, 0, 0, "after_extra_time", "mismatch")]
    errors = spark.createDataFrame([(1, "a", "x"), (None, "", "y")], "id long, name string, kind string").select("kind", R.schema_errors("s", ["id", "name"], {"name": {"required": True}, "kind": {"enum": ["x"]}}).alias("e"))
    assert rows(errors, "kind", "e") == [("x", []), ("y", ["s: missing primary-key field id", "s: missing primary-key field name", "s: name: required", "s: kind: not allowed"])]


def test_a_split_refuses_an_empty_side(spark):
    df = spark.createDataFrame([(1,), (2,), (None,)], "d int")
    train, test = E.chronological_split(df, "d", F.lit(2))
    assert (rows(train, "d"), rows(test, "d")) == ([(1,)], [(2,)])
    with pytest.raises(ValueError, match="training"):
        E.chronological_split(df, "d", F.lit(1))
    with pytest.raises(ValueError, match="test"):
        E.chronological_split(df, "d", F.lit(3))
