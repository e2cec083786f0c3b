"""Events, labels and commentary of providers as flat canonical rows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

EVENT = """struct<type: struct<name: string>, team: struct<name: string>, minute: int, shot: struct<statsbomb_xg: double, outcome: struct<name: string>>,
    foul_committed: struct<card: struct<name: string>>, bad_behaviour: struct<card: struct<name: string>>>"""
XI = "array<struct<team_name: string, lineup: array<struct<player_id: bigint, positions: array<struct<`from`: string, start_reason: string>>>>>>"

#: What action labels mean, and whether a label speaks for one canonical event.
LABELS = {
    "Goal": "goal", "Penalty": "penalty_awarded", "Yellow card": "yellow_card", "Red card": "red_card", "Yellow->red card": "second_yellow", "Substitution": "substitution", "Corner": "corner",
    "Offside": "offside", "Foul": "foul", "Shots on target": "shot_on_target", "Shots off target": "shot", "Kick-off": "kickoff",
}


def extract_events(df: DataFrame, key: str, payload: Column) -> DataFrame:
    """(key, minute, team, kind, detail, xg, xg_known): a row for each goal, card, substitution and shot of a nested event; others and those without a minute are left out.

    A shot that scores is a shot and a goal; an own goal counts for the side it helps; a card's detail is its name. A shot without a quality has xg 0.0 and ``xg_known`` false.
    """
    e = df.select(key, F.from_json(payload, EVENT).alias("e")).where("e.minute is not null")
    kind, card = F.col("e.type.name"), F.coalesce("e.foul_committed.card.name", "e.bad_behaviour.card.name")
    scored = F.col("e.shot.outcome.name").eqNullSafe(F.lit("Goal"))

    def one(test: Column, name: str, detail: Column | None = None, xg: Column | None = None) -> Column:
        text, number = F.lit(None).cast("string") if detail is None else detail, F.lit(None).cast("double") if xg is None else xg
        return F.when(test, F.struct(F.lit(name).alias("kind"), text.alias("detail"), number.alias("xg")))

    rows = F.array(
        one(kind == "Shot", "shot", xg=F.col("e.shot.statsbomb_xg")), one(((kind == "Shot") & scored) | (kind == "Own Goal For"), "goal"),
        one(kind.isin("Foul Committed", "Bad Behaviour") & card.isNotNull(), "card", card), one(kind == "Substitution", "sub"))
    out = e.select(key, F.col("e.minute").alias("minute"), F.col("e.team.name").alias("team"), F.explode(F.filter(rows, lambda r: r.isNotNull())).alias("r"))
    shot = F.col("r.kind") == "shot"
    return out.select(key, "minute", "team", "r.kind", "r.detail", F.when(shot, F.coalesce("r.xg", F.lit(0.0))).alias("xg"), F.when(shot, F.col("r.xg").isNotNull()).alias("xg_known"))


def starting_xi(df: DataFrame, key: str, payload: Column) -> DataFrame:
    """(key, team, player) of those who are on the pitch when a match begins.

    A player's positions are spells with a clock mm:ss. Who has none does not play. The earliest spell decides: it starts the
    match if its clock reads no time played, or, without a clock, if the provider gives starting as its reason.
    """
    p = df.select(key, F.explode(F.from_json(payload, XI)).alias("t")).select(key, F.col("t.team_name").alias("team"), F.explode("t.lineup").alias("p"))

    def played(spell: Column) -> Column:
        clock = F.split(spell["from"], ":")
        return 60 * F.try_to_number(F.get(clock, F.lit(0)), F.lit("9999")) + F.try_to_number(F.get(clock, F.lit(1)), F.lit("99"))

    spells = F.transform("p.positions", lambda x: F.struct(F.coalesce(played(x), F.when(x["start_reason"] == "Starting XI", 0)).alias("at")))
    begins = F.array_min(F.transform(spells, lambda x: x["at"]))
    return p.where(F.coalesce(begins == 0, F.lit(False))).select(key, "team", F.col("p.player_id").alias("player"))


def game_of(path: Column) -> tuple[Column, Column]:
    """(game, half) of a path whose last part may be the half: parts joined by /, and 0 without a half."""
    parts = F.split(F.rtrim(F.replace(path, F.lit("\\"), F.lit("/")), F.lit("/")), "/")
    last = F.element_at(parts, -1)
    digits = last.rlike("^[0-9]+$")
    game = F.when(digits, F.slice(parts, F.lit(1), F.size(parts) - 1)).otherwise(parts)
    return F.array_join(game, "/"), F.when(digits, last.cast("int")).otherwise(0)


def normal_game(path: Column) -> Column:
    """Lower-cased parts without outer blanks, inner ones as underscores; empty parts go."""
    parts = F.filter(F.transform(F.split(F.replace(path, F.lit("\\"), F.lit("/")), "/"), lambda x: F.trim(x)), lambda x: x != "")
    return F.array_join(F.transform(parts, lambda x: F.replace(F.lower(x), F.lit(" "), F.lit("_"))), "/")


def canonical_label(label: Column) -> Column:
    """The canonical event of an action label; other for one that has none."""
    out = F.when(F.lit(False), "")
    for name, canonical in LABELS.items():
        out = out.when(label == name, canonical)
    return out.otherwise("other")


def label_events(df: DataFrame, clock: str = "game_time", position: str = "position", label: str = "label") -> DataFrame:
    """df with half (before the dash of the game clock, 0 if none), t_s (position in ms as seconds) and canonical."""
    half = F.try_element_at(F.split(F.col(clock), " - "), F.lit(1)).try_cast("int")
    t_s = F.coalesce(F.col(position).try_cast("double"), F.lit(0.0)) / 1000.0
    return df.withColumns({"half": F.coalesce(half, F.lit(0)), "t_s": t_s, "canonical": canonical_label(F.col(label))})


def plain_text(text: Column) -> Column:
    """Runs of whitespace as one space, none at the ends; null is empty."""
    return F.trim(F.regexp_replace(F.coalesce(text, F.lit("")), r"(?U)[\s\x1c-\x1f]+", " "))


def segment_records(df: DataFrame, text: Column, start: Column) -> DataFrame:
    """Commentary segments with norm, content_hash (of the text as it is, null as empty), quality, clock_s (whole seconds) and causal use.

    A segment's time is the broadcast's and not its publication's, so it may never be used as known at a decision.
    """
    norm = plain_text(text)
    quality = F.when(norm == "", "empty").when(F.length(norm) < 3, "too_short").otherwise("ok")
    return df.withColumns({"norm": norm, "content_hash": F.sha2(F.coalesce(text, F.lit("")), 256), "quality": quality, "clock_s": start.cast("int"), "eligibility": F.lit("historical_weak_supervision_only")})


def match_key(competition: Column, season: Column, home: Column, away: Column, date: Column) -> Column:
    """A provider-neutral match id from the parts as they are."""
    parts = [F.lower(F.trim(competition)), *(F.trim(x.cast("string")) for x in (season, date, home, away))]
    return F.concat_ws("/", *(F.replace(x, F.lit(" "), F.lit("_")) for x in parts))


def verbatim_id(raw: Column) -> Column:
    """The provider's id as it is; none is made up."""
    text = raw.cast("string")
    return F.when(~text.isin("", "null"), text)


def normalised(df: DataFrame, mapping: dict[str, str], fields: dict[str, str], kinds: Sequence[str]) -> tuple[DataFrame, dict[str, bool]]:
    """Provider rows as the canonical fields (name to type), missing ones null, and which of them the provider has.

    mapping: canonical field to provider column. An event_type outside of ``kinds`` fails the job.
    """
    has = {f: mapping.get(f) in df.columns for f in fields}
    columns = {f: (F.col(f"`{mapping[f]}`") if has[f] else F.lit(None)).cast(t) for f, t in fields.items()}
    if has.get("event_type"):
        kind = columns["event_type"]
        columns["event_type"] = F.when(kind.isin(list(kinds)), kind).otherwise(F.raise_error(F.concat(F.lit("unknown event_type "), F.coalesce(kind, F.lit("null")))))
    return df.select(*(c.alias(f) for f, c in columns.items())), has


def write_bundle(tables: dict[str, DataFrame], folder: str) -> DataFrame:
    """Writes each table as Parquet below a folder, and a manifest (name, path, rows) beside them, which is returned."""
    spark, rows = next(iter(tables.values())).sparkSession, []
    for name, df in tables.items():
        path = f"{folder.rstrip('/')}/{name}"
        df.write.mode("overwrite").parquet(path)
        rows.append((name, path, spark.read.parquet(path).count()))
    manifest = spark.createDataFrame(rows, "name string, path string, rows long")
    manifest.coalesce(1).write.mode("overwrite").json(f"{folder.rstrip('/')}/manifest")
    return manifest
