"""Projections, filters, predicates and guards."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def require_columns(df: DataFrame, required: Sequence[str], name: str) -> DataFrame:
    """Fails at once, without a job, when columns are missing."""
    missing = sorted(set(required) - set(df.columns))
    if missing:
        raise ValueError(f"{name} lacks columns: {missing}")
    return df


def outcome(df: DataFrame, a: str = "goals_a", b: str = "goals_b") -> DataFrame:
    """A, D or B and a draw flag; null goals give null."""
    result = F.when(F.col(a) > F.col(b), "A").when(F.col(a) == F.col(b), "D").when(F.col(a) < F.col(b), "B")
    return df.withColumns({"outcome": result, "is_draw": (result == "D").cast("int")})


def deltas(df: DataFrame, pairs: Sequence[tuple[str, str, str]]) -> DataFrame:
    """Signed and absolute differences of the pairs that are there."""
    new = {n: F.col(a) - F.col(b) for a, b, n in pairs if {a, b} <= set(df.columns)}
    return df.withColumns(new | {f"abs_{n}": F.abs(c) for n, c in new.items()})


def low_block_risk(df: DataFrame) -> DataFrame:
    """High where a favourite meets an outsider, few goals are expected and a draw helps; absent columns take defaults."""

    def get(name: str, default: float) -> Column:
        return F.col(name) if name in df.columns else F.lit(default)

    def unit(x: Column) -> Column:
        return F.least(F.lit(1.0), F.greatest(F.lit(0.0), x))

    low, gap = unit((2.7 - get("market_total_goals", 2.5)) / 1.2), unit(get("abs_elo_delta", 0.0) / 450.0)
    return df.withColumn("low_block_risk", low * gap * (0.5 + 0.5 * unit(get("mutual_draw_utility", 0.0))))


def travel_fatigue(df: DataFrame) -> DataFrame:
    """Each side's fatigue from short rest, miles of the last week, shifted time zones and heat, four parts of 0 to 1; their mean and difference.

    Absent columns take defaults; fixed values: 4 days' rest over 3, 3,000 miles, 4 zones, heat of 80 to 105.
    """

    def get(name: str, default: float) -> Column:
        return F.col(name) if name in df.columns else F.lit(default)

    def unit(x: Column) -> Column:
        return F.least(F.lit(1.0), F.greatest(F.lit(0.0), x))

    heat = unit((get("heat_index", 75.0) - 80) / 25)
    each = {s: unit((4 - get(f"rest_days_{s}", 4.0)) / 3) + unit(get(f"travel_miles_last7_{s}", 0.0) / 3000) + unit(F.abs(get(f"timezone_shift_{s}", 0.0)) / 4) + heat for s in "ab"}
    return df.withColumns({f"travel_fatigue_{s}": x for s, x in each.items()} | {"travel_fatigue": (each["a"] + each["b"]) / 4.0, "travel_fatigue_delta": each["a"] - each["b"]})


def stage_filter(df: DataFrame, date: str, stage: str, word: str, first: int, last: int) -> DataFrame:
    return df.where(F.year(date).between(first, last) & F.contains(F.lower(stage), F.lit(word)))


def leakage_safe(df: DataFrame, forbidden: Sequence[str]) -> DataFrame:
    """Numeric columns without the forbidden ones; not finite and null become 0."""
    kinds = {"double", "float", "int", "bigint", "smallint", "tinyint", "boolean"}

    def safe(name: str, kind: str) -> Column:
        c = F.col(name)
        if kind in ("double", "float"):
            c = F.when(F.isnan(c) | c.isin(float("inf"), float("-inf")), 0.0).otherwise(c)
        return (F.coalesce(c, F.lit(0).cast(kind)) if kind != "boolean" else c).alias(name)

    return df.select(*(safe(n, k) for n, k in df.dtypes if k in kinds and n not in forbidden))


def exclude_locked(df: DataFrame, locked: Column) -> DataFrame:
    return df.where(~F.coalesce(locked, F.lit(False)))


def assert_unlocked(df: DataFrame, locked: Column) -> DataFrame:
    """Fails when a locked row is read."""
    return df.where(F.assert_true(~F.coalesce(locked, F.lit(False)), F.lit("a locked row")).isNull())


def known_by(fact: Column, decision: Column) -> Column:
    return F.coalesce(fact <= decision, F.lit(False))


def live_safe(published: Column, decision: Column, lag_s: int) -> Column:
    return F.coalesce(published + lag_s <= decision, F.lit(False))


def plane(rights: Column, published: Column, timed: Column) -> Column:
    return F.when(~rights, "blocked").when(published, "live").when(timed, "historical").otherwise("static")


def contract_errors(contract: dict[str, dict]) -> Column:
    """A contract as one array of messages, empty for a row that keeps it."""
    found = []
    for name, rule in contract.items():
        c = F.col(name)
        if rule.get("required"):
            found.append(F.when(c.isNull() | (c.cast("string") == ""), f"{name}: required"))
        if "enum" in rule:
            found.append(F.when(~c.isin(rule["enum"]), f"{name}: not allowed"))
        if "min" in rule:
            found.append(F.when(c < rule["min"], f"{name}: below {rule['min']}"))
    return F.array_compact(F.array(*found))


def gated(df: DataFrame, gates: Sequence[tuple[str, Column]]) -> tuple[DataFrame, DataFrame]:
    """Rows that pass all gates, and the others with the first reason."""
    reason = F.coalesce(*(F.when(F.coalesce(test, F.lit(True)), name) for name, test in gates))
    marked = df.withColumn("reason", reason)
    return marked.where("reason IS NULL").drop("reason"), marked.where("reason IS NOT NULL")


def score_by_provider(goals: DataFrame, own_to_other: dict[str, bool], key: str) -> DataFrame:
    """home, away, unknown per key of (provider, side 0 or 1, own): who benefits from an own goal is the provider's convention."""
    swap = F.create_map(*(x for p, v in own_to_other.items() for x in (F.lit(p), F.lit(v))))[F.col("provider")]
    side = F.when(swap.isNotNull(), F.when(F.col("own") & swap, 1 - F.col("side")).otherwise(F.col("side")))
    return goals.groupBy(key).agg(F.count_if(side == 0).alias("home"), F.count_if(side == 1).alias("away"), F.count_if(side.isNull()).alias("unknown"))


def reorient(df: DataFrame, same: Column, home: str, draw: str, away: str) -> DataFrame:
    return df.withColumns({"p_team_a": F.when(same, F.col(home)).otherwise(F.col(away)), "p_draw": F.col(draw), "p_team_b": F.when(same, F.col(away)).otherwise(F.col(home))})


def bucket(x: Column, steps: Sequence[tuple[float, str]], last: str) -> Column:
    """The name of the first step that x does not exceed."""
    out = F.when(x <= steps[0][0], steps[0][1])
    for top, name in steps[1:]:
        out = out.when(x <= top, name)
    return out.otherwise(last)


def card_class(cards: DataFrame, player: Sequence[str], order: str) -> DataFrame:
    nth = F.count("*").over(Window.partitionBy(*player).orderBy(order).rowsBetween(Window.unboundedPreceding, 0))
    return cards.withColumn("card", F.when(nth == 1, "yellow").when(nth == 2, "second_yellow").otherwise("after"))


def card_kinds(cards: DataFrame, player: Sequence[str], order: Sequence[str], detail: str) -> DataFrame:
    """cards with card: yellow, second_yellow, second_yellow_red (a red one after a booking), direct_red or other.

    detail names the card, in any case; a booking counts from its own row on.
    """
    name = F.lower(F.coalesce(detail, F.lit("")))
    yellow = name.contains("yellow")
    so_far = F.count_if(yellow).over(Window.partitionBy(*player).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0))
    booked = F.when(so_far >= 2, "second_yellow").otherwise("yellow")
    return cards.withColumn("card", F.when(yellow, booked).when(name.contains("red"), F.when(so_far >= 1, "second_yellow_red").otherwise("direct_red")).otherwise("other"))


def canonical_results(fixtures: DataFrame, goals: DataFrame) -> DataFrame:
    """fixtures (match, ft_home, ft_away, et_home, pen_home) with the events' goals by period, result_type and status.

    goals: (match, side home or away, minute, detail); missed and cancelled ones are none, and one without a minute is in
    no period. Regulation is (0, 90], extra time (90, 120]. status: exact if the events give the official regulation score.
    """
    name = F.lower(F.coalesce("detail", F.lit("")))
    counted = goals.where(~name.contains("missed") & ~name.contains("cancel"))
    m = F.col("minute")
    spans = {"reg": (m > 0) & (m <= 90), "et": (m > 90) & (m <= 120)}
    sums = counted.groupBy("match").agg(*(F.count_if(test & (F.col("side") == s)).alias(f"{span}_events_{s}") for span, test in spans.items() for s in ("home", "away")))
    names = [f"{span}_events_{s}" for span in spans for s in ("home", "away")]
    out = fixtures.join(sums, "match", "left").na.fill(0, names)
    kind = F.when(F.col("pen_home").isNotNull(), "penalty_shootout").when(F.col("et_home").isNotNull(), "after_extra_time").otherwise("regulation")
    same = (F.col("ft_home") == F.col("reg_events_home")) & (F.col("ft_away") == F.col("reg_events_away"))
    return out.withColumns({"result_type": kind, "status": F.when(same, "exact").otherwise("mismatch")})


def schema_errors(schema: str, key: Sequence[str], contract: dict[str, dict]) -> Column:
    """What a row of a schema breaks: parts of its primary key that are not there, then contract_errors, each with the schema's name before it."""
    lost = [F.when(F.col(c).isNull() | (F.col(c).cast("string") == ""), f"missing primary-key field {c}") for c in key]
    every = F.concat(F.array_compact(F.array(*lost)), contract_errors(contract))
    return F.transform(every, lambda e: F.concat(F.lit(f"{schema}: "), e))


def permitted(df: DataFrame, rights: DataFrame, source: str, right: str) -> DataFrame:
    """Rows whose source grants a right; the rights table has a row for each source."""
    return df.join(rights.where(F.col("right") == right).select(source), source, "left_semi")
