"""Reconciliation of events against a fold of one list, as the rule reads."""

import random

from pyspark.sql import functions as F

from pitspark.operators import reconcile as R
from pitspark.operators import selection as S

SCHEMA = "n long, match_id string, event_type string, team_id string, minute int, source_name string, provider_event_id string, player_id string, attrs map<string,string>"


def fold(rows, tolerance):
    """{row number: anchor} by going through the candidates one by one."""
    clusters, out = [], {}
    for r in sorted(rows, key=lambda r: (r[4] or 0, R.SOURCE_RANK.get(r[5], R.OTHER_RANK), r[5], r[0])):
        for c in clusters:
            if c["group"] == r[1:4] and ((r[6] is not None and r[6] in c["ids"]) or abs((r[4] or 0) - c["anchor"]) <= tolerance):
                break
        else:
            c = {"group": r[1:4], "anchor": r[4] or 0, "ids": set()}
            clusters.append(c)
        c["ids"].add(r[6])
        out[r[0]] = c["anchor"]
    return out


def test_clusters_are_those_of_the_fold(spark):
    rng = random.Random(0)
    rows = [
        (i, rng.choice(["m1", "m2", None]), rng.choice(["goal", "red_card"]), rng.choice(["a", None]), rng.choice([None, *range(0, 90)]), rng.choice(["official_feed", "api_football", "martj42", "who"]), rng.choice([None, None, f"p{rng.randrange(60)}"]), None, None)
        for i in range(500)
    ]
    for tolerance in (0, 1, 4):
        got = {r.n: r.anchor for r in R.clustered(spark.createDataFrame(rows, SCHEMA), tolerance).collect()}
        assert got == fold(rows, tolerance)


def test_verdicts(spark):
    rows = [
        (1, "m", "goal", "a", 10, "api_football", None, "7", {"goal_type": "header"}), (2, "m", "goal", "a", 11, "official_feed", None, "7", None), (3, "m", "goal", "a", 12, "official_feed", None, "8", None),
        (4, "m", "red_card", "a", 50, "martj42", None, "3", {"red_type": "straight"}), (5, "m", "red_card", "a", 51, "api_football", None, "3", {"red_type": "second"}),
        (6, "m", "corner", "b", 20, "martj42", None, None, None), (7, "m", "kickoff", "b", None, "api_football", "k", None, {"kickoff_utc": "x"}), (8, "m", "kickoff", "b", 88, "api_football", "k", None, {"kickoff_utc": "x"}),
    ]
    clusters, raw = R.reconcile_events(spark.createDataFrame(rows, SCHEMA))
    got = {(r.event_type, r.anchor): r for r in clusters.collect()}
    assert set(got) == {("goal", 10), ("goal", 12), ("red_card", 50), ("corner", 20), ("kickoff", 0)}
    g = got["goal", 10]
    assert (g.minute, g.player_id, g.canonical_source, g.contributing_sources, g.reconciliation_status, g.source_confidence) == (11, "7", "official_feed", ["api_football", "official_feed"], "reconciled", "high")
    assert g.provider_disagreement == {"_minute_spread": ["10", "11"]} and g.approved_feature_eligible
    assert (got["goal", 12].reconciliation_status, got["goal", 12].source_confidence) == ("single_source", "medium")
    c = got["red_card", 50]
    assert c.provider_disagreement == {"_minute_spread": ["50", "51"], "red_type": ["second", "straight"]} and (c.reconciliation_status, c.source_confidence, c.is_critical, c.approved_feature_eligible) == ("unresolved", "low", True, False)
    assert (got["corner", 20].source_confidence, got["corner", 20].is_critical, got["corner", 20].provider_disagreement) == ("low", False, {})
    assert got["kickoff", 0].provider_disagreement == {"_minute_spread": ["0", "88"]} and got["kickoff", 0].reconciliation_status == "single_source"
    assert raw.count() == len(rows) and {(r.n, r.anchor) for r in raw.where("event_type = 'kickoff'").collect()} == {(7, 0), (8, 0)}
    empty, none = R.reconcile_events(spark.createDataFrame([], SCHEMA))
    assert empty.count() == none.count() == 0


def test_a_match_of_many_candidates_is_no_row(spark):
    """A quarter of a million candidates of one match: the fold sees its distinct clocks only."""
    many = spark.range(250_000).select(
        F.col("id").alias("n"), F.lit("m").alias("match_id"), F.lit("goal").alias("event_type"), F.lit("a").alias("team_id"), (F.col("id") % 120).cast("int").alias("minute"),
        F.when(F.col("id") % 2 == 0, "official_feed").otherwise("who").alias("source_name"), F.lit(None).cast("string").alias("provider_event_id"), F.lit("7").alias("player_id"), F.lit(None).cast("map<string,string>").alias("attrs"))
    clusters, raw = R.reconcile_events(many, tolerance=2)
    assert clusters.count() == 40 and raw.count() == 250_000
    assert {r.reconciliation_status for r in clusters.collect()} == {"reconciled"}


def test_anchor_clusters_number_them_in_order(spark):
    rows = [("m", t, i) for i, t in enumerate([5, 6, 7, 9, 5, 30, 31, 33])]
    got = S.anchor_clusters(spark.createDataFrame(rows, "match string, minute int, o int"), ["match"], "minute", "o", 2)
    assert sorted((r.minute, r.o, r.cluster) for r in got.collect()) == sorted(zip([5, 6, 7, 9, 5, 30, 31, 33], range(8), [1, 1, 1, 2, 1, 3, 3, 4]))
