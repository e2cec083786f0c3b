"""What players, lineups and substitutions are worth by what was known on the days before.

An appearance is a row (player, day, ...). Rows of one day never see each other: running sums are taken to the
end of a day and handed to the next day that a key has.
"""

from __future__ import annotations

import heapq
from collections.abc import Callable, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import pit

# The vocabulary of positions and their groups, how many appearances count as recent, and what priors are worth.
POSITIONS = ("G", "D", "M", "F")
GROUPS = {"G": "def", "D": "def", "M": "mid", "F": "att"}
RECENT = (5, 10)
PSEUDO_MINUTES, PSEUDO_APPEARANCES, BEHIND_SCALE, FULL_TIME = 270.0, 3.0, 0.85, 90.0


def exposure(apps: DataFrame, keys: Sequence[str], day: str, order: Sequence[str]) -> DataFrame:
    """(keys, day, ...) for each day on which a key appears: exposure and recency as they stood before it.

    apps: keys, day (whole number), order (columns that tell the appearances of a day apart; of rows that agree in all of
    them any may be the later one), minutes, started, position.
    prior_appearances, prior_starts, prior_minutes; minutes_last, apps_last and starts_last over the 5 and 10 appearances
    before; days_since the last one (null: none); share_<p>: starts in a position of all starts in known ones;
    position: the most frequent one of the starts (ties to the first by code point; sub: never started; unknown: never seen);
    availability: starts of the last 10 shrunk to a half; uncertainty and exposure by pseudo-counts; unknown.
    """
    started, one = F.coalesce(F.col("started").cast("int"), F.lit(0)), F.col("position")
    minutes = F.coalesce(F.col("minutes").cast("double"), F.lit(0.0))
    w = Window.partitionBy(*keys).orderBy(day, *order)
    upto = w.rowsBetween(Window.unboundedPreceding, 0)
    running = {"apps": F.count("*").over(upto), "starts": F.sum(started).over(upto), "minutes": F.sum(minutes).over(upto)}
    running |= {f"start_{p}": F.count_if((started == 1) & (one == p)).over(upto) for p in POSITIONS}
    for n in RECENT:
        last = w.rowsBetween(1 - n, 0)
        running |= {f"minutes_last{n}": F.sum(minutes).over(last), f"apps_last{n}": F.count("*").over(last), f"starts_last{n}": F.sum(started).over(last)}
    ends = apps.select(*keys, day, *order, F.struct(*(c.alias(n) for n, c in running.items())).alias("_s")).groupBy(*keys, day).agg(F.max_by("_s", "_s.apps").alias("_s"))
    days = Window.partitionBy(*keys).orderBy(day)
    rows = ends.select(*keys, day, F.lag("_s").over(days).alias("_s"), (F.col(day) - F.lag(day).over(days)).alias("days_since"))
    have = {n: F.coalesce(F.col(f"_s.{n}"), F.lit(0)) for n in running}
    known = sum((have[f"start_{p}"] for p in POSITIONS[1:]), have[f"start_{POSITIONS[0]}"])
    # by code point the earlier position wins a tie: of (count, -place) the greatest
    places = {p: -i for i, p in enumerate(sorted(POSITIONS))}
    best = F.array_max(F.array(*(F.struct(have[f"start_{p}"].alias("n"), F.lit(places[p]).alias("at"), F.lit(p).alias("p")) for p in POSITIONS)))["p"]
    last = RECENT[-1]
    return rows.select(
        *keys, day, have["apps"].alias("prior_appearances"), have["starts"].alias("prior_starts"), have["minutes"].cast("double").alias("prior_minutes"), "days_since",
        *(have[f"{what}_last{n}"].alias(f"{what}_last{n}") for n in RECENT for what in ("minutes", "apps", "starts")),
        *(F.when(known > 0, have[f"start_{p}"] / known).otherwise(0.0).alias(f"share_{p}") for p in POSITIONS),
        F.when(known > 0, best).when(have["apps"] > have["starts"], "sub").otherwise("unknown").alias("position"),
        F.when(have["apps"] > 0, (have[f"starts_last{last}"] + PSEUDO_APPEARANCES / 2) / (have[f"apps_last{last}"] + PSEUDO_APPEARANCES)).otherwise(0.0).alias("availability"),
        (PSEUDO_APPEARANCES / (have["apps"] + PSEUDO_APPEARANCES)).alias("uncertainty"), (have["minutes"] / (have["minutes"] + PSEUDO_MINUTES)).alias("exposure"), (have["apps"] == 0).alias("unknown"))


def context_scale(minute: Column, lead: Column) -> Column:
    """How much of a substitution's difference lasts: the share of the match that is left, less when the side is behind; what is unknown takes nothing off."""
    left = F.greatest(F.lit(0.0), (FULL_TIME - F.least(F.lit(FULL_TIME), F.greatest(F.lit(0.0), minute.cast("double")))) / FULL_TIME)
    return F.coalesce(left, F.lit(1.0)) * F.when(lead < 0, BEHIND_SCALE).otherwise(1.0)


def position_group(position: Column) -> Column:
    out = F.when(F.lit(False), "")
    for p, group in GROUPS.items():
        out = out.when(position == p, group)
    return out


def substitution_deltas(subs: DataFrame, priors: DataFrame, day: str) -> DataFrame:
    """subs (player_in, player_out, day, minute, lead, ...) with what comes on less what goes off.

    priors: (player, day, prior, appearances, position) as they stood before the day, a row for each player and day. A
    player without one counts 0, and is unknown. delta; scaled_delta by context_scale; same_position; imbalance: another
    group of positions while behind; low_history: a player with fewer than three appearances before.
    """
    out = subs
    for side in ("in", "out"):
        p = priors.select(F.col("player").alias("_p"), F.col(day).alias("_d"), F.col("prior").alias(f"_v_{side}"), F.col("appearances").alias(f"_n_{side}"), F.col("position").alias(f"_pos_{side}"))
        out = out.join(p, (F.col(f"player_{side}") == F.col("_p")) & (F.col(day) == F.col("_d")), "left").drop("_p", "_d")
    value = {s: F.coalesce(F.col(f"_v_{s}"), F.lit(0.0)) for s in ("in", "out")}
    few = {s: F.coalesce(F.col(f"_n_{s}") < PSEUDO_APPEARANCES, F.lit(True)) for s in ("in", "out")}
    groups = [position_group(F.col(f"_pos_{s}")) for s in ("in", "out")]
    delta = value["in"] - value["out"]
    return out.select(
        *subs.columns, delta.alias("delta"), (delta * context_scale(F.col("minute"), F.col("lead"))).alias("scaled_delta"),
        F.coalesce(F.col("_pos_in") == F.col("_pos_out"), F.lit(False)).alias("same_position"), F.coalesce((groups[0] != groups[1]) & (F.col("lead") < 0), F.lit(False)).alias("imbalance"),
        (few["in"] | few["out"]).alias("low_history"), *((F.coalesce(F.col(f"_n_{s}"), F.lit(0)) == 0).alias(f"unknown_{s}") for s in ("in", "out")))


def lineup_form(xi: DataFrame, records: DataFrame, keys: Sequence[str], day: str) -> DataFrame:
    """(keys, form, coverage) of lineups (keys, player, day): the mean of their players' mean ratings before the day.

    records: (player, day, rating); a null rating is none. Players without one leave the mean and lower the coverage.
    """
    daily = records.where("rating is not null and player is not null").groupBy("player", F.col(day).alias("rated")).agg(F.sum("rating").alias("s"), F.count("*").alias("n"))
    upto = Window.partitionBy("player").orderBy("rated").rowsBetween(Window.unboundedPreceding, 0)
    known = daily.select("player", "rated", (F.sum("s").over(upto) / F.sum("n").over(upto)).alias("mean"))
    rows = pit.asof_join(xi, known, "player", day, "rated", ["mean"], strict=True)
    return rows.groupBy(*keys).agg(F.avg("asof_mean").alias("form"), (F.count("asof_mean") / F.count("*")).alias("coverage"))


def _ranked(k: int) -> Callable[[pd.DataFrame], pd.DataFrame]:
    """A side's stretch of days in their order: each lineup is held against the k players with most minutes until then."""

    def fold(pdf: pd.DataFrame) -> pd.DataFrame:
        minutes: dict[int, float] = {}
        first: dict[int, int] = {}
        top: set[int] = set()
        # minutes only grow but for negative ones: the next best are among the best and those who have played since
        moved: set[int] = set()
        fell = False
        ranked_at = None
        lineups: dict[int, tuple[set[int], set[int]]] = {}  # a match to its players and the ranked ones
        out = []
        rows = pdf.sort_values(["day", "tag"], kind="stable")
        for day, tag, match, player, known, played, since in zip(*(rows[c].tolist() for c in ("day", "tag", "match", "player", "known", "minutes", "first"))):
            if tag == 0:
                minutes[player], first[player] = played, since
                moved.add(player)
            elif tag == 1:
                if day != ranked_at:
                    ranked_at = day
                    if moved:
                        pool = minutes if fell else top | moved
                        top = {p for _, _, p in heapq.nsmallest(k, ((-minutes[p], first[p], p) for p in pool if minutes[p] > 0))}
                        moved, fell = set(), False
                lineup = lineups.setdefault(match, (set(), top))[0]
                if known:
                    lineup.add(player)
            else:
                minutes[player] = minutes.get(player, 0.0) + played
                moved.add(player)
                fell = fell or not played >= 0
                first.setdefault(player, day)
        for match, (lineup, best) in lineups.items():
            out.append((rows["team"].iloc[0], match, len(best & lineup) / len(best) if best else None, len(best) / k))
        return pd.DataFrame(out, columns=["team", "match", "availability", "coverage"])

    return fold


def key_players(xi: DataFrame, played: DataFrame, day: str, k: int = 6, days: int = 365) -> DataFrame:
    """(team, match, availability, coverage): how many of a side's k players with most minutes before the day are in the lineup.

    xi: (team, match, player, day); played: (team, player, day, minutes). Ties go to who played first, then to the smaller
    player; a side without minutes before has a null availability. A match has one day; a null player is in no ranking. A side is cut into stretches of ``days``: each starts
    from its players' minutes before, a row a player, so a task holds a stretch of a side and not its whole history.
    """
    at = lambda c: F.floor(F.col(c) / days)
    played = played.where("player is not null").groupBy("team", "player", F.col(day).alias("day")).agg(F.sum(F.coalesce(F.col("minutes").cast("double"), F.lit(0.0))).alias("minutes"))
    known = F.col("player").isNotNull()
    asked = xi.select("team", "match", F.coalesce("player", F.lit(0)).alias("player"), F.col(day).alias("day"), F.lit(1).alias("tag"), known.alias("known")).where("day is not null and match is not null")
    sums = played.groupBy("team", "player", at("day").alias("part")).agg(F.sum("minutes").alias("m"), F.min("day").alias("first"))
    parts = asked.select("team", at("day").alias("part")).distinct()
    since = sums.groupBy("team", "player").agg(F.min("part").alias("_from"), F.min("first").alias("first"))
    carried = since.join(parts, "team").where("part > _from").select("team", "player", "part", "first")
    marks = sums.select("team", "player", "part", "m", F.lit(0).alias("ask")).unionByName(carried.select("team", "player", "part", "first", F.lit(1).alias("ask")), allowMissingColumns=True)
    before = F.sum("m").over(Window.partitionBy("team", "player").orderBy("part").rangeBetween(Window.unboundedPreceding, -1))
    start = marks.withColumn("minutes", before).where("ask = 1").select("team", "player", "part", "first", "minutes", (F.col("part") * days).alias("day"), F.lit(0).alias("tag"))
    rows = start.unionByName(asked.withColumn("part", at("day")), allowMissingColumns=True).unionByName(played.select("*", at("day").alias("part"), F.lit(2).alias("tag")), allowMissingColumns=True)
    # whole numbers stay whole in pandas only without nulls
    rows = rows.na.fill(0, ["match", "first"]).na.fill(0.0, ["minutes"]).na.fill(True, ["known"])
    return rows.groupBy("team", "part").applyInPandas(_ranked(k), "team long, match long, availability double, coverage double")


def span_name(lo: int, hi: int) -> str:
    return f"last_{hi}" if lo == 0 else f"{lo}_to_{hi}"


def rolling_sides(events: DataFrame, snapshots: DataFrame, measures: dict[str, Column], spans: Sequence[tuple[int, int]], half: Callable[[Column], Column]) -> DataFrame:
    """(match, t, ...): what both sides did in spans of seconds before t, with both ends included, and in the current half.

    events: (match, t, side home or away, ...). A span (lo, hi) is [t - hi, t - lo]: <m>_last_<hi>_<side>, or
    <m>_<lo>_to_<hi>_<side>. <m>_half_<side>: since the half of t began; half maps a clock to its half. An event enters a
    span by a row lo seconds later and leaves it by one hi seconds later, after a snapshot of that clock: running sums do all.
    """
    e = events.select("match", "t", F.col("side").alias("_side"), *(v.cast("double").alias(m) for m, v in measures.items()))
    e = e.where(F.col("_side").isin(*pit.SIDES) & F.coalesce(*measures).isNotNull())
    enter, leave = sorted({0, *(lo for lo, _ in spans)}), sorted({hi for _, hi in spans})
    moved = F.explode(F.array(*(F.struct(F.lit(tag).alias("tag"), F.lit(w).alias("_by")) for tag, by in ((1, enter), (3, leave)) for w in by)))
    moves = e.withColumn("_m", moved).select("match", (F.col("t") + F.col("_m._by")).alias("t"), F.col("_m.tag").alias("tag"), F.col("_m._by").alias("_by"), "_side", *measures)
    asked = snapshots.select("match", "t", F.lit(2).alias("tag")).distinct()
    rows = moves.unionByName(asked, allowMissingColumns=True).select("match", (F.col("t") * 4 + F.col("tag")).alias("c"), half(F.col("t")).alias("_half"), "_by", "_side", *measures)
    rows = pit.dealt(rows, "match", [events, snapshots])
    tag = F.col("c") % 4
    now = Window.partitionBy("match", "_half").orderBy("c").rangeBetween(Window.unboundedPreceding, 0)
    past = Window.partitionBy("match").orderBy("c").rangeBetween(Window.unboundedPreceding, 0)
    halves = {f"{m}_half_{s}": F.coalesce(F.sum(F.when((tag == 1) & (F.col("_by") == 0) & (F.col("_side") == s), F.col(m))).over(now), F.lit(0.0)) for m in measures for s in pit.SIDES}
    rows = rows.withColumns(halves)
    sums = {}
    for m in measures:
        for lo, hi in spans:
            value = F.when((tag == 1) & (F.col("_by") == lo), F.col(m)).when((tag == 3) & (F.col("_by") == hi), -F.col(m))
            sums |= {f"{m}_{span_name(lo, hi)}_{s}": F.coalesce(F.sum(F.when(F.col("_side") == s, value)).over(past), F.lit(0.0)) for s in pit.SIDES}
    out = rows.select("match", F.floor(F.col("c") / 4).cast("long").alias("t"), tag.alias("tag"), *(x.alias(n) for n, x in sums.items()), *halves)
    return out.where("tag = 2").drop("tag")


def pace(panel: DataFrame, measure: str, short: int, long: int) -> DataFrame:
    """panel of rolling_sides, with spans (0, short), (0, long) and (short, long), with <m>_momentum, the sides' difference a minute over ``long``, and <m>_acceleration, that over ``short`` less that of the time before."""
    gap = lambda *span: F.col(f"{measure}_{span_name(*span)}_home") - F.col(f"{measure}_{span_name(*span)}_away")
    new, old = gap(0, short) / (short / 60.0), gap(short, long) / ((long - short) / 60.0)
    return panel.withColumns({f"{measure}_momentum": gap(0, long) / (long / 60.0), f"{measure}_acceleration": new - old})


def sendoff_after(panel: DataFrame, counts: Sequence[str]) -> DataFrame:
    """panel (match, t, counts so far) with sendoff_after: the match's last snapshot counts more than this one."""
    total = sum((F.coalesce(F.col(c), F.lit(0)) for c in counts[1:]), F.coalesce(F.col(counts[0]), F.lit(0)))
    ends = panel.groupBy("match").agg(F.max_by(total, "t").alias("_end"))
    return panel.join(ends, "match").withColumn("sendoff_after", (F.col("_end") > total).cast("int")).drop("_end")
