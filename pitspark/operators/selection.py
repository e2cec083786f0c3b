"""Top-k, tie-breaks, seeded samples, set operations and reconciliation."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .reconcile import anchors


def first_by(df: DataFrame, keys: Sequence[str], *order: Column, n: int = 1) -> DataFrame:
    """The first n rows of each key."""
    return df.withColumn("_rn", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where(F.col("_rn") <= n).drop("_rn")


def complete_snapshot(preds: DataFrame, unit: str, snapshot: str, model: str, required: Sequence[str], valid: Column) -> DataFrame:
    """(unit, snapshot, reason): the latest snapshot at which all required models have a valid row, else why there is none."""
    each = preds.groupBy(unit, snapshot).agg(F.collect_set(F.when(valid, F.col(model))).alias("have"))
    full = F.size(F.array_except(F.array(*map(F.lit, required)), "have")) == 0
    out = each.groupBy(unit).agg(F.max(F.when(full, F.col(snapshot))).alias(snapshot))
    return out.withColumn("reason", F.when(F.col(snapshot).isNull(), "no_complete_snapshot"))


def group_table(sides: DataFrame, group: str, team: str, scored: str, conceded: str) -> DataFrame:
    """Points, difference, goals and place of each team in its group; ties by name."""
    pts = F.when(F.col(scored) > F.col(conceded), 3).when(F.col(scored) == F.col(conceded), 1).otherwise(0)
    t = sides.groupBy(group, team).agg(F.sum(pts).alias("points"), F.sum(F.col(scored) - F.col(conceded)).alias("gd"), F.sum(scored).alias("gf"))
    return t.withColumn("place", F.row_number().over(Window.partitionBy(group).orderBy(F.desc("points"), F.desc("gd"), F.desc("gf"), team)))


def head_to_head(matches: DataFrame, table: DataFrame, group: str, team: str, rounds: int = 3) -> DataFrame:
    """Places after breaking ties on points by the matches among the tied, again within those still tied.

    matches: a row for each side (group, team, opponent, scored, conceded). A block of
    equals is a number; each round splits the blocks, which is enough for groups of four.
    """
    ranked = table.withColumn("block", F.dense_rank().over(Window.partitionBy(group).orderBy(F.desc("points"))))
    for _ in range(rounds):
        side = ranked.select(group, team, "block")
        rival = side.select(F.col(group).alias("_g"), F.col(team).alias("_t"), F.col("block").alias("_b"))
        inner = matches.join(side, [group, team]).join(rival, (F.col(group) == F.col("_g")) & (F.col("opponent") == F.col("_t")) & (F.col("block") == F.col("_b")))
        pts = F.when(F.col("scored") > F.col("conceded"), 3).when(F.col("scored") == F.col("conceded"), 1).otherwise(0)
        mini = inner.groupBy(group, team).agg(F.sum(pts).alias("_p"), F.sum(F.col("scored") - F.col("conceded")).alias("_d"), F.sum("scored").alias("_f"))
        ranked = ranked.join(mini, [group, team], "left").na.fill(0, ["_p", "_d", "_f"])
        ranked = ranked.withColumn("block", F.dense_rank().over(Window.partitionBy(group).orderBy("block", F.desc("_p"), F.desc("_d"), F.desc("_f")))).drop("_p", "_d", "_f")
    order = Window.partitionBy(group).orderBy("block", F.desc("gd"), F.desc("gf"), team)
    return ranked.withColumn("place", F.row_number().over(order))


def seeded_sample(df: DataFrame, stratum: str, unit: str, n: int, seed: str) -> DataFrame:
    """The first n of each stratum in the order of a seeded hash."""
    at = F.sha2(F.concat(F.lit(f"{seed}:"), F.col(unit).cast("string")), 256)
    return first_by(df.withColumn("_at", at), [stratum], F.col("_at"), n=n).drop("_at")


def even_allocation(df: DataFrame, group: str, league: str, order: Sequence[str], per_group: int, per_league: int, total: int) -> DataFrame:
    """Rows taken in turn from each group, at most so many of a group and of a league, and in all; ties by group, then order."""
    rank = F.row_number().over(Window.partitionBy(group).orderBy(*order))
    capped = df.withColumn("_r", rank).where(F.col("_r") <= per_group)
    capped = capped.withColumn("_l", F.row_number().over(Window.partitionBy(league).orderBy("_r", group, *order))).where(F.col("_l") <= per_league)
    return capped.orderBy("_r", group, *order).limit(total).drop("_r", "_l")


def widest_threshold(df: DataFrame, cls: str, score: str, hit: Column, precision: float, least: int) -> DataFrame:
    """(class, threshold, n): the lowest score down to which the precision holds, rows of equal score together."""
    steps = df.groupBy(cls, score).agg(F.count("*").alias("_n"), F.sum(hit.cast("int")).alias("_k"))
    w = Window.partitionBy(cls).orderBy(F.desc(score)).rowsBetween(Window.unboundedPreceding, 0)
    steps = steps.withColumns({"n": F.sum("_n").over(w), "k": F.sum("_k").over(w)})
    ok = (F.col("n") >= least) & (F.col("k") >= precision * F.col("n"))
    return steps.groupBy(cls).agg(F.min(F.when(ok, F.col(score))).alias("threshold"), F.max(F.when(ok, F.col("n"))).alias("n"))


def apply_corrections(events: DataFrame, key: str, version: str, action: str) -> DataFrame:
    """The latest version of each event; retracted ones go. Applying it twice changes nothing."""
    return first_by(events, [key], F.desc(version)).where(F.col(action) != "retract")


def upsert(base: DataFrame, updates: DataFrame, key: str) -> DataFrame:
    """Rows of base, replaced by updates of their key, and new ones."""
    columns = [c for c in base.columns if c != key]
    b, u = base.alias("b"), updates.alias("u")
    chosen = (F.when(F.col(f"u.{key}").isNotNull(), F.col(f"u.{c}")).otherwise(F.col(f"b.{c}")).alias(c) for c in columns)
    return b.join(u, F.col(f"b.{key}") == F.col(f"u.{key}"), "full_outer").select(F.coalesce(f"u.{key}", f"b.{key}").alias(key), *chosen)


def anchor_clusters(candidates: DataFrame, keys: Sequence[str], minute: str, order: str, tolerance: int) -> DataFrame:
    """(keys, minute, order, cluster): in order, a row joins the first cluster whose anchor (its first row's minute) is within tolerance, else starts one; clusters are numbered from 1."""
    found = anchors(candidates.select(*keys, minute), keys, minute, tolerance)
    numbers = found.select(*keys, "anchor").distinct().withColumn("cluster", F.row_number().over(Window.partitionBy(*keys).orderBy("anchor")))
    at = candidates.select(*keys, F.col(minute).cast("long").alias(minute), order).join(found, [*keys, minute])
    return at.join(numbers, [*keys, "anchor"]).select(*keys, minute, order, "cluster")


def reconcile_scores(events: DataFrame, reported: DataFrame) -> DataFrame:
    """reported (match, home, away, pen_home, pen_away) with the score that events (match, side, kind, shootout) give.

    Goals and scored penalties count for their side, own goals for the other one; shoot-outs are kept apart, and null where
    neither side has a count. A match is ok if both scores agree, else an exception; without events it is nil-nil.
    """
    kind, side = F.col("kind"), F.col("side")
    scored, own = kind.isin("goal", "penalty_scored") & ~F.col("shootout"), (kind == "own_goal") & ~F.col("shootout")
    sums = events.groupBy("match").agg(*(F.count_if((scored & (side == s)) | (own & (side == o))).alias(f"derived_{s}") for s, o in (("home", "away"), ("away", "home"))))
    out = reported.join(sums, "match", "left").na.fill(0, ["derived_home", "derived_away"])
    exact = F.col("derived_home").eqNullSafe(F.coalesce("home", F.lit(0))) & F.col("derived_away").eqNullSafe(F.coalesce("away", F.lit(0)))
    some = F.col("pen_home").isNotNull() | F.col("pen_away").isNotNull()
    pens = {f"shootout_{s}": F.when(some, F.coalesce(f"pen_{s}", F.lit(0))) for s in ("home", "away")}
    return out.withColumns({**pens, "exact": exact, "status": F.when(exact, "ok").otherwise("exception")}).drop("pen_home", "pen_away")


def integrity(df: DataFrame, checks: Sequence[tuple[str, Column]]) -> DataFrame:
    """(check, violations) of row checks, from one pass."""
    row = df.agg(*(F.count_if(~F.coalesce(ok, F.lit(False))).alias(n) for n, ok in checks))
    return row.select(F.expr(f"stack({len(checks)}, " + ", ".join(f"'{n}', `{n}`" for n, _ in checks) + ") as (check, violations)"))


def duplicate_keys(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    return df.groupBy(*keys).agg(F.count("*").alias("n")).where("n > 1")


def disagreements(df: DataFrame, key: str, fields: Sequence[str]) -> DataFrame:
    """(key, field, n): fields in which the sources of a key differ; null is no opinion."""
    row = df.groupBy(key).agg(*(F.count_distinct(c).alias(c) for c in fields))
    return row.select(key, F.expr(f"stack({len(fields)}, " + ", ".join(f"'{c}', `{c}`" for c in fields) + ") as (field, n)")).where("n > 1")
