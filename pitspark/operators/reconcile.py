"""Events of several sources as one: clusters around anchors, verdicts, disagreements and raw versions.

The rule: in the order of their clocks, a candidate joins the first cluster of its group (match, type, team) that holds its
provider id or whose anchor, the clock of its first candidate, is within a tolerance; else it starts one. Two
observations make it a job without long rows:

- A candidate whose provider id came before goes where that one went, and changes no anchor. So each candidate stands at its id's
  first clock, and the distinct clocks of a group say all about its anchors, however many candidates share them.
- Clocks further apart than the tolerance start a cluster in any case. Between such gaps a sorted run is folded, one clock after the
  other, with the last anchor in hand.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .joins import written

#: Sources by rank, 1 the best, and the rank of any other.
SOURCE_RANK = {
    "official_feed": 1, "fifa_official": 1, "api_football": 2, "the_odds_api": 2, "football_data_org": 3, "secondary_provider": 3, "approved_announcement": 4,
    "open_dataset": 5, "martj42": 5, "jfjelstul": 5,
}
OTHER_RANK = 9
#: Attributes on which sources must agree, by event type; the types listed here are critical.
IDENTITY = {
    "goal": ("player_id", "goal_type"), "penalty": ("taker_player_id", "outcome", "phase"), "yellow_card": ("player_id",), "second_yellow": ("player_id",), "red_card": ("player_id", "red_type"),
    "substitution": ("player_off_id", "player_on_id"), "kickoff": ("kickoff_utc",), "final_whistle": ("final_whistle_utc",), "match_status": ("status",), "match_minute": (),
}
GROUP = ("match_id", "event_type", "team_id")


def rank_of(source: Column) -> Column:
    table = F.create_map(*(F.lit(x) for pair in SOURCE_RANK.items() for x in pair))
    return F.coalesce(F.element_at(table, source), F.lit(OTHER_RANK))


def anchors(clocks: DataFrame, keys: Sequence[str], clock: str, tolerance: int) -> DataFrame:
    """(keys, clock, anchor) of distinct (keys, clock): the anchor that each clock joins, going up.

    A run between gaps is one key of the shuffle, so a group is spread over tasks by its runs; a task holds one anchor.
    """
    before = F.lag(clock).over(Window.partitionBy(*keys).orderBy(clock))
    starts = F.when(before.isNull() | (F.col(clock) - before > tolerance), 1).otherwise(0)
    runs = clocks.select(*keys, F.col(clock).cast("long").alias(clock)).distinct().withColumn("_start", starts)
    runs = runs.withColumn("_run", F.sum("_start").over(Window.partitionBy(*keys).orderBy(clock))).drop("_start")

    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, anchor = None, 0
        for batch in batches:
            out = []
            for row in zip(*(batch.column(c).to_pylist() for c in [*keys, "_run", clock])):
                if row[:-1] != own:
                    own, anchor = row[:-1], row[-1]
                elif row[-1] - anchor > tolerance:
                    anchor = row[-1]
                out.append(anchor)
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in [*keys, clock]), pa.array(out, pa.int64())], names=[*keys, clock, "anchor"])

    kinds = dict(runs.dtypes)
    schema = ", ".join(f"`{c}` {kinds[c]}" for c in [*keys, clock]) + ", anchor long"
    dealt = runs.repartition(*keys, "_run").sortWithinPartitions(*keys, "_run", clock)
    return dealt.mapInArrow(fold, schema)


def _same(left: DataFrame, right: DataFrame, columns: Sequence[str]) -> DataFrame:
    """A left join on columns that may be null; right's own columns are added."""
    renamed = right.withColumnsRenamed({c: f"_r_{c}" for c in columns})
    on = [left[c].eqNullSafe(renamed[f"_r_{c}"]) for c in columns]
    return left.join(renamed, on, "left").drop(*(f"_r_{c}" for c in columns))


def clustered(candidates: DataFrame, tolerance: int = 1) -> DataFrame:
    """candidates (match_id, event_type, team_id, minute, source_name, provider_event_id, ..) with ``anchor``, which names a cluster within its group; no minute is minute 0."""
    rows = candidates.withColumn("_at", F.coalesce(F.col("minute").cast("long"), F.lit(0).cast("long")))
    ids = rows.where("provider_event_id is not null").groupBy(*GROUP, "provider_event_id").agg(F.min("_at").alias("_first"))
    rows = written(_same(rows, ids, [*GROUP, "provider_event_id"]).withColumn("_at", F.coalesce("_first", "_at")).drop("_first"))
    return _same(rows, anchors(rows.select(*GROUP, "_at"), GROUP, "_at", tolerance), [*GROUP, "_at"]).drop("_at")


def reconcile_events(candidates: DataFrame, tolerance: int = 1) -> tuple[DataFrame, DataFrame]:
    """(clusters, raw versions): a verdict for each cluster, and every candidate with its cluster's anchor.

    Clusters: group, anchor, the best source's minute and player_id (by rank, name, then minute), canonical_source, contributing_sources,
    reconciliation_status (unresolved if sources differ in an identity attribute, reconciled with two sources, else single_source), source_confidence,
    provider_disagreement (attribute to its values, ``_minute_spread`` to the minutes), is_critical, approved_feature_eligible.
    A candidate's attributes are its columns ``player_id`` and ``attrs`` (a map of strings); null is no opinion. Raw versions stay rows:
    none is merged away, and no row holds a cluster.
    """
    raw = written(clustered(candidates, tolerance))
    key = [*GROUP, "anchor"]
    attribute = lambda name: F.col("player_id").cast("string") if name == "player_id" else F.element_at("attrs", F.lit(name))
    names = sorted({a for attrs in IDENTITY.values() for a in attrs})
    asked = F.array(*(F.struct(F.lit(a).alias("a"), F.coalesce(attribute(a), F.element_at("attrs", F.lit(a))).alias("v"), F.col("event_type").isin(*(t for t, x in IDENTITY.items() if a in x)).alias("counts")) for a in names))
    told = raw.select(*key, F.explode(F.filter(asked, lambda x: x["counts"] & x["v"].isNotNull())).alias("x")).select(*key, "x.a", "x.v")
    values = told.groupBy(*key, "a").agg(F.sort_array(F.collect_set("v")).alias("v")).where(F.size("v") > 1)
    minute = F.coalesce(F.col("minute").cast("long"), F.lit(0).cast("long"))
    spread = raw.groupBy(*key, minute.alias("m")).agg(F.lit(1)).groupBy(*key).agg(F.sort_array(F.collect_set("m")).alias("m")).where(F.size("m") > 1)
    both = values.withColumn("hard", F.lit(True)).unionByName(spread.select(*key, F.lit("_minute_spread").alias("a"), F.transform("m", lambda x: x.cast("string")).alias("v"), F.lit(False).alias("hard")))
    disagreement = both.groupBy(*key).agg(F.map_from_entries(F.sort_array(F.collect_list(F.struct("a", "v")))).alias("_d"), F.max("hard").alias("_hard"))
    best = F.min(F.struct(rank_of(F.col("source_name")).alias("rank"), F.col("source_name").alias("source"), minute.alias("order"), F.col("minute").alias("minute"), F.coalesce(F.col("player_id").cast("string"), F.element_at("attrs", F.lit("player_id"))).alias("player")))
    heads = raw.groupBy(*key).agg(best.alias("_b"), F.sort_array(F.collect_set("source_name")).alias("contributing_sources"))
    out = _same(heads, disagreement, key)
    status = F.when(F.coalesce("_hard", F.lit(False)), "unresolved").when(F.size("contributing_sources") >= 2, "reconciled").otherwise("single_source")
    confidence = F.when(F.col("reconciliation_status") == "reconciled", "high").when((F.col("reconciliation_status") == "single_source") & (F.col("_b.rank") <= 2), "medium").otherwise("low")
    critical = F.coalesce(F.col("event_type").isin(*IDENTITY), F.lit(False))
    out = out.withColumns({"reconciliation_status": status, "is_critical": critical})
    clusters = out.select(
        *key, F.col("_b.minute").alias("minute"), F.col("_b.player").alias("player_id"), F.col("_b.source").alias("canonical_source"), "contributing_sources", "reconciliation_status", confidence.alias("source_confidence"),
        F.coalesce("_d", F.create_map().cast("map<string,array<string>>")).alias("provider_disagreement"), "is_critical", (~(F.col("is_critical") & (F.col("reconciliation_status") == "unresolved"))).alias("approved_feature_eligible"))
    return clusters, raw
