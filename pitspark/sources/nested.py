"""Nested provider payloads as flat rows: odds, lineups, substitutions, player matches."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

ODDS = "struct<books: array<struct<book: string, markets: array<struct<market: string, outcomes: array<struct<name: string, price: double>>>>>>>"
LINEUP = "struct<team: bigint, startXI: array<struct<id: bigint, pos: string>>, substitutes: array<struct<id: bigint, pos: string>>>"


def flatten_odds(df: DataFrame, key: str, payload: Column, market: str, names: tuple[str, str, str]) -> DataFrame:
    """(key, book, home, draw, away) of one market; outcomes that a book lacks are null."""
    books = df.select(key, F.explode_outer(F.from_json(payload, ODDS)["books"]).alias("_b"))
    markets = books.select(key, F.col("_b.book").alias("book"), F.explode_outer("_b.markets").alias("_m")).where(F.col("_m.market") == market)
    rows = markets.select(key, "book", F.explode_outer("_m.outcomes").alias("_o"))
    return rows.groupBy(key, "book").agg(*(F.max(F.when(F.col("_o.name") == n, F.col("_o.price"))).alias(side) for n, side in zip(names, ("home", "draw", "away"))))


def lineup_players(df: DataFrame, key: str, payload: Column) -> DataFrame:
    """(key, team, player, pos, starts) of starters and bench."""
    rows = df.select(key, F.from_json(payload, LINEUP).alias("_l"))
    # both parts in one explode: a payload is read once
    def of(part: str, starts: bool) -> Column:
        return F.transform(F.col(f"_l.{part}"), lambda p: F.struct(p["id"].alias("player"), p["pos"].alias("pos"), F.lit(starts).alias("starts")))

    each = [of("startXI", True), of("substitutes", False)]
    every = F.concat(*(F.coalesce(x, F.array().cast("array<struct<player: bigint, pos: string, starts: boolean>>")) for x in each))
    return rows.select(key, F.col("_l.team").alias("team"), F.explode(every).alias("_p")).select(key, "team", "_p.*")


EVENTS = "array<struct<type: string, detail: string, time: struct<elapsed: int>, team: struct<id: bigint>, player: struct<id: bigint>, assist: struct<id: bigint>>>"
PLAYERS = "array<struct<team: struct<id: bigint>, players: array<struct<player: struct<id: bigint>, statistics: array<struct<games: struct<minutes: double, rating: string, substitute: boolean>>>>>>>"
TOTALS = "array<struct<team: struct<id: bigint>, statistics: array<struct<type: string, value: string>>>>"


def substitutions(df: DataFrame, key: str, payload: Column) -> DataFrame:
    """(key, minute, team, player_in, player_out) of the substitutions among a match's events: who comes on is the player, who goes off the assist."""
    e = df.select(key, F.explode(F.from_json(payload, EVENTS)).alias("e"))
    return e.where(F.lower("e.type") == "subst").select(key, F.col("e.time.elapsed").alias("minute"), F.col("e.team.id").alias("team"), F.col("e.player.id").alias("player_in"), F.col("e.assist.id").alias("player_out"))


def player_matches(df: DataFrame, key: str, payload: Column) -> DataFrame:
    """(key, team, player, minutes, rating, started): the first statistics of each player; unknown minutes are 0, a rating that is no number is null, unknown substitutes did not start."""
    t = df.select(key, F.explode(F.from_json(payload, PLAYERS)).alias("t"))
    p = t.select(key, F.col("t.team.id").alias("team"), F.explode("t.players").alias("p"))
    games = F.get("p.statistics", F.lit(0))["games"]
    return p.select(key, "team", F.col("p.player.id").alias("player"), F.coalesce(games["minutes"], F.lit(0.0)).alias("minutes"), games["rating"].try_cast("double").alias("rating"), F.coalesce(~games["substitute"], F.lit(False)).alias("started"))


def team_totals(df: DataFrame, key: str, payload: Column, kind: str = "expected_goals") -> DataFrame:
    """(key, team, total) of one statistic; a side without it, or with an empty one, has null."""
    t = df.select(key, F.explode(F.from_json(payload, TOTALS)).alias("t"))
    ours = F.filter("t.statistics", lambda x: (F.lower(x["type"]) == kind) & (x["value"] != ""))
    return t.select(key, F.col("t.team.id").alias("team"), F.try_element_at(ours, F.lit(-1))["value"].try_cast("double").alias("total"))
