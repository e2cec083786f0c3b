"""Work that must not be repeated: payloads parsed twice, rankings of all players each day, models that nobody asks for."""

import heapq
import random

import pandas as pd
from pyspark.sql import functions as F

from pitspark.operators import fits
from pitspark.operators import history as H
from pitspark.sources import nested as N


def test_a_days_ranking_looks_at_those_who_played(monkeypatch):
    draw, seen, plain = random.Random(5), [], heapq.nsmallest
    rows, total, first = [], {}, {}
    for day in range(60):
        for p in range(200 if day == 0 else 3):
            player = p if day == 0 else draw.randrange(200)
            minutes = -40.0 if day == 30 and p == 0 else float(draw.randrange(90))
            rows.append((7, day, 2, 0, player, True, minutes, 0))
        rows.append((7, day, 1, day, draw.randrange(200), True, 0.0, 0))

    def counted(k, pool):
        pool = list(pool)
        seen.append(len(pool))
        return plain(k, pool)

    monkeypatch.setattr(H.heapq, "nsmallest", counted)
    got = H._ranked(4)(pd.DataFrame(rows, columns=["team", "day", "tag", "match", "player", "known", "minutes", "first"]))
    want = {}
    for day in range(60):
        best = {p for _, _, p in plain(4, ((-m, first[p], p) for p, m in total.items() if m > 0))}
        for _, _, tag, match, player, *_ in (r for r in rows if r[1] == day and r[2] == 1):
            want[match] = len(best & {player}) / len(best) if best else None
        for r in (r for r in rows if r[1] == day and r[2] == 2):
            total[r[4]] = total.get(r[4], 0.0) + r[6]
            first.setdefault(r[4], day)
    assert {m: None if pd.isna(a) else a for m, a in zip(got["match"], got["availability"])} == want
    assert sum(n > 10 for n in seen) <= 2


def test_a_lineup_is_parsed_once(spark):
    df = spark.createDataFrame([(1, '{"team": 3, "startXI": [{"id": 5, "pos": "G"}], "substitutes": null}'), (2, None)], "k long, p string")
    out = N.lineup_players(df, "k", F.col("p"))
    assert "Union" not in out._jdf.queryExecution().optimizedPlan().toString()
    assert [tuple(r) for r in out.collect()] == [(1, 3, 5, "G", True)] and out.columns == ["k", "team", "player", "pos", "starts"]


def test_an_ensemble_fits_on_all_rows_when_asked(spark):
    rows = spark.range(240).select((F.col("id") % 40).alias("g"), (F.rand(3) - 0.5).alias("a"), (F.rand(4) - 0.5).alias("b")).withColumn("y", (F.col("a") + F.col("b") > 0).cast("double"))
    calls = []

    def head(column):
        def fit(df):
            calls.append(column)
            return fits.M.logistic(df, [column], "y")

        return fit

    choice = fits.ensemble(rows, {"one": head("a"), "two": head("b")}, "y", "g", k=2)
    assert len(calls) == 4
    assert choice.predict(rows).count() == 240 and choice.predict(rows).count() == 240 and len(calls) <= 6
