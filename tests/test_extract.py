"""Provider extraction, fold evaluation and refreshes on small cases worked out by hand."""

import json

import pytest
from pyspark.sql import functions as F

from pitspark.operators import evaluation as E
from pitspark.sources import extract as X


def test_who_begins_a_match(spark):
    spell = lambda at, why=None: {k: v for k, v in (("from", at), ("start_reason", why)) if v is not None}
    squad = {
        10: [spell("00:00")], 11: [spell("00:00", "Tactical Shift"), spell("46:02")], 12: [spell(None, "Starting XI")], 13: [spell("30:00", "Tactical Shift"), spell("00:00", "Starting XI")],
        20: [], 21: [spell("00:01", "Substitution - On (Injury)")], 22: [spell(None)], 23: [spell("71:30")], 24: [spell("late")], 25: [spell(None, "Substitution - On (Tactical)")],
    }
    lineup = [{"player_id": i, "positions": p} for i, p in squad.items()] + [{"player_id": 26}]
    payload = json.dumps([{"team_name": "home", "lineup": lineup}, {"team_name": "away", "lineup": [{"player_id": 30, "positions": [spell("0:00")]}]}, {"team_name": "none"}])
    df = spark.createDataFrame([(1, payload), (2, "[]"), (3, None), (4, "{")], "m long, p string")
    assert sorted(tuple(r) for r in X.starting_xi(df, "m", F.col("p")).collect()) == [(1, "away", 30)] + [(1, "home", i) for i in (10, 11, 12, 13)]


def test_events_of_a_provider_in_its_real_form(spark):
    shot = {"id": "a1", "index": 5, "period": 1, "minute": 3, "second": 12, "type": {"id": 16, "name": "Shot"}, "team": {"id": 1, "name": "A"}, "location": [109.1, 38.0], "shot": {"statsbomb_xg": 0.4, "outcome": {"id": 97, "name": "Goal"}, "end_location": [120.0, 40.0, 1.0]}}
    rows = [
        shot, {**shot, "minute": 5, "shot": {"outcome": {"id": 100, "name": "Saved"}}}, {**shot, "minute": 6, "shot": {"xg": 0.9}},
        {"minute": 9, "type": {"name": "Own Goal For"}, "team": {"name": "B"}}, {"minute": 9, "type": {"name": "Bad Behaviour"}, "team": {"name": "B"}, "bad_behaviour": {"card": {"id": 5, "name": "Red Card"}}},
        {"minute": 9, "type": {"name": "Foul Committed"}, "team": {"name": "B"}}, {"type": {"name": "Substitution"}, "team": {"name": "A"}}, {"minute": 1, "type": {"name": "Pass"}},
    ]
    df = spark.createDataFrame([(1, json.dumps(r)) for r in rows], "m long, p string")
    got = sorted((r.minute, r.team, r.kind, r.detail or "", r.xg, r.xg_known) for r in X.extract_events(df, "m", F.col("p")).collect())
    assert got == [(3, "A", "goal", "", None, None), (3, "A", "shot", "", 0.4, True), (5, "A", "shot", "", 0.0, False), (6, "A", "shot", "", 0.0, False), (9, "B", "card", "Red Card", None, None), (9, "B", "goal", "", None, None)]


def test_paths_ids_and_unknown_kinds(spark):
    row = spark.createDataFrame([("a\\b c/Game 1/2/", "null", "strange")], "p string, i string, k string")
    game, half = X.game_of(F.col("p"))
    assert tuple(row.select(game, half, X.normal_game(F.col("p")), X.verbatim_id(F.col("i"))).first()) == ("a/b c/Game 1", 2, "a/b_c/game_1/2", None)
    rows, has = X.normalised(row, {"event_type": "k", "player": "i"}, {"event_type": "string", "player": "string", "xg": "double"}, ["goal"])
    assert has == {"event_type": True, "player": True, "xg": False}
    with pytest.raises(Exception, match="unknown event_type strange"):
        rows.collect()


def test_bundle(spark, tmp_path):
    m = X.write_bundle({"a": spark.range(3), "b": spark.range(0)}, str(tmp_path))
    assert sorted((r.name, r.rows) for r in spark.read.json(str(tmp_path / "manifest")).collect()) == sorted((r.name, r.rows) for r in m.collect()) == [("a", 3), ("b", 0)]


def test_nested_selection_never_sees_the_held_fold(spark):
    """Model x is best on fold 1 alone, so that fold 1 must choose y, and the others x."""
    rows = [(1, "x", 1.0, 10), (1, "y", 9.0, 10), (2, "x", 5.0, 10), (2, "y", 4.0, 10), (3, "x", 5.0, 10), (3, "y", 4.0, 10)]
    got = {r.held: (r.model, round(r.inner, 6), r.outer) for r in E.nested_selection(spark.createDataFrame(rows, "held long, model string, total double, n long"), "held", "model", "total", "n").collect()}
    assert got == {1: ("y", 0.4, 0.9), 2: ("x", 0.3, 0.5), 3: ("x", 0.3, 0.5)}


def test_year_folds_split_by_time(spark):
    df = spark.createDataFrame([(y,) for y in (2000, 2001, 2002, 2003)], "y int")
    years = spark.createDataFrame([(2002,), (2003,)], "test_year int")
    got = sorted((r.test_year, r.role, r.y) for r in E.year_folds(df, F.col("y"), years).collect())
    assert got == [(2002, "test", 2002), (2002, "train", 2000), (2002, "train", 2001), (2003, "test", 2003), (2003, "train", 2000), (2003, "train", 2001), (2003, "train", 2002)]


def test_a_result_moves_ratings_once_and_leaves_open_matches(spark):
    matches = spark.createDataFrame([(1, 10, 20, None, None), (2, 10, 30, None, None), (3, 20, 30, 1, 1)], "id long, a long, b long, ga long, gb long")
    results = spark.createDataFrame([(1, 2, 0)], "id long, ga long, gb long")
    new, ratings, ahead = E.refresh(matches, results, spark.createDataFrame([(10, 1500.0), (20, 1500.0)], "team long, rating double"))
    assert {r.id: (r.ga, r.gb) for r in new.collect()} == {1: (2, 0), 2: (None, None), 3: (1, 1)}
    moved = 40 * 1.5 * (1 - 1 / (1 + 10 ** (-65 / 400)))
    assert {r.team: round(r.rating, 6) for r in ratings.collect()} == {10: round(1500 + moved, 6), 20: round(1500 - moved, 6)}
    (row,) = ahead.collect()
    p = 1 / (1 + 10 ** (-moved / 400))
    assert (row.id, round(row.pa, 9)) == (2, round(p * p + 0.4 * p * (1 - p), 9))


def test_recovery_by_hand(spark):
    truth = spark.createDataFrame([("m", "goal", 100), ("m", "goal", 200), ("m", "card", 100)], "m string, cls string, t long")
    said = spark.createDataFrame([("m", "goal", 104), ("m", "goal", 98), ("m", "goal", 300), ("m", "sub", 100)], "m string, cls string, s long")
    got = {r.cls: (r.true_events, r.emitted, r.recovered, r.false_ones, r.recall, r.timing_median, r.timing_p90) for r in E.coverage_recovery(truth, said, ["m"], "cls", "t", "s", 10).collect()}
    assert got == {"goal": (2, 3, 1, 1, 0.5, 3.0, 2), "card": (1, 0, 0, 0, 0.0, None, None), "sub": (0, 1, 0, 1, None, None, None)}
