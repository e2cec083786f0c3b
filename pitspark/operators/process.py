"""The process layer: territory, possessions, phases, chances on events (match, idx, t, kind, team, px, py)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import probs as P


def territory(events: DataFrame) -> DataFrame:
    g = events.groupBy("match", "team").agg(
        F.count_if(F.col("px") >= 80).alias("final_third"), F.count_if(P.in_box(F.col("px"), F.col("py"))).alias("box"), F.count_if(F.col("px") >= 100).alias("deep")
    )
    total = F.sum("final_third").over(Window.partitionBy("match"))
    return g.withColumn("tilt", F.when(total > 0, F.col("final_third") / total))


def with_possession(events: DataFrame) -> DataFrame:
    """Adds ``possession``: the number of the unbroken spell of one team within its match."""
    w = Window.partitionBy("match").orderBy("t", "idx")
    new = F.when(F.col("team").eqNullSafe(F.lag("team").over(w)) & (F.row_number().over(w) > 1), 0).otherwise(1)
    return events.withColumn("_new", new).withColumn("possession", F.sum("_new").over(w.rowsBetween(Window.unboundedPreceding, 0))).drop("_new")


def possessions(events: DataFrame) -> DataFrame:
    return with_possession(events).groupBy("match", "possession", "team").agg(
        F.count("*").alias("actions"), (F.max("t") - F.min("t")).alias("seconds"), F.bool_or(F.col("px") >= 80).alias("reached_final"),
        F.bool_or(P.in_box(F.col("px"), F.col("py"))).alias("reached_box"), F.max_by("kind", F.struct("t", "idx")).alias("ended"),
    )


def phases(spells: DataFrame, shot: str, sustained_s: int = 12, sustained_actions: int = 6) -> DataFrame:
    held = (F.col("actions") >= sustained_actions) | (F.col("seconds") >= sustained_s)
    phase = F.when(F.col("ended") == shot, "shot").when(F.col("reached_box"), "box").when(held, "sustained").when(F.col("reached_final"), "final_third")
    return spells.withColumn("phase", phase.otherwise("build_up"))


def chances(shots: DataFrame, xg: str) -> DataFrame:
    near = (P.shot_distance(F.col("px"), F.col("py")) <= 12) & (P.shot_angle(F.col("px"), F.col("py")) >= 0.35)
    big = F.coalesce(F.col(xg) >= 0.3, F.lit(False)) | near
    return shots.groupBy("match", "team").agg(F.count("*").alias("shots"), F.count(xg).alias("covered"), F.sum(xg).alias("xg"), F.count_if(big).alias("big"))


def attacking_x(events: DataFrame, shot: Column) -> DataFrame:
    mean = F.avg(F.when(shot, F.col("px"))).over(Window.partitionBy("match", "team"))
    return events.withColumn("ax", F.when(mean >= 60, F.col("px")).when(mean < 60, 120 - F.col("px")))
