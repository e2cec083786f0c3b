"""In-play models with fixed parameters on a table of states, and replays of matches through decision minutes.

A state: match, minute, goals_a, goals_b, reds_a, reds_b, delta (rating difference), and, where known, market_a,
market_b (probabilities before the match) and xg_a, xg_b. Everything is columns: a model is a function of a DataFrame
that adds p_a, p_draw, p_b.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import probs as P

Model = Callable[[DataFrame], DataFrame]

# Goals of a side before a match between equals, what a hundred rating points change, how many
# observations a forecast is worth at the start, what a minute adds and what known chances add.
BASE_RATE, PER_HUNDRED = 1.35, 0.20
EVIDENCE, PER_MINUTE, CHANCES = 80.0, 0.5, 25.0
#: Fields a state must have for a record, and the entropy bands of a replay.
FIELDS = ("delta", "minute", "goals_a", "goals_b", "reds_a", "reds_b")


def pregame_rates(delta: Column) -> list[Column]:
    return [BASE_RATE * F.exp(PER_HUNDRED * delta / 100.0), BASE_RATE * F.exp(-PER_HUNDRED * delta / 100.0)]


def market_delta(market_a: Column, market_b: Column, fallback: Column) -> Column:
    """The rating difference that a market's two-way share stands for; the fallback where it has none."""
    share = P.clip(market_a / (market_a + market_b), 1e-4, 1 - 1e-4)
    return F.when(market_a.isNotNull() & market_b.isNotNull() & (market_a + market_b > 0), 400.0 * F.log10(share / (1 - share))).otherwise(fallback)


def _known(df: DataFrame, name: str) -> Column:
    return F.col(name) if name in df.columns else F.lit(None).cast("double")


def _normal(df: DataFrame) -> DataFrame:
    return df.withColumns(dict(zip(("p_a", "p_draw", "p_b"), P.normalize(F.col("p_a"), F.col("p_draw"), F.col("p_b")))))


def static(df: DataFrame) -> DataFrame:
    """The forecast before the match, whatever happens."""
    return _normal(df.withColumns(dict(zip(("p_a", "p_draw", "p_b"), P.ternary_probs(F.col("delta"))))))


def _remaining(df: DataFrame, delta: Column) -> DataFrame:
    a, b = pregame_rates(delta)
    rates = P.remaining_rates(a, b, F.col("minute").cast("double"), F.col("goals_a") - F.col("goals_b"), F.col("reds_a"), F.col("reds_b"), _known(df, "xg_a"), _known(df, "xg_b"))
    df = df.withColumns(dict(zip(("rate_a", "rate_b"), rates)))
    return _normal(P.with_wdl(df, F.col("rate_a"), F.col("rate_b"), F.col("goals_a") - F.col("goals_b"), names=("p_a", "p_draw", "p_b")))


def remaining_poisson(df: DataFrame) -> DataFrame:
    """Goals still to come are Poisson with rates from the ratings and the state."""
    return _remaining(df, F.col("delta"))


def market_inplay(df: DataFrame) -> DataFrame:
    """The same from the market's share before the match; the ratings where there is no market."""
    return _remaining(df, market_delta(_known(df, "market_a"), _known(df, "market_b"), F.col("delta")))


MODELS: dict[str, Model] = {"M0_static_b1": static, "M2_remaining_poisson": remaining_poisson, "M6_market_inplay": market_inplay}


def predictions(states: DataFrame, models: Sequence[str] = tuple(MODELS)) -> DataFrame:
    """The states once for each model, with model, p_a, p_draw and p_b."""
    scored = None
    for name in models:
        part = MODELS[name](states).drop("rate_a", "rate_b").withColumn("model", F.lit(name))
        scored = part if scored is None else scored.unionByName(part)
    return scored


def states_at(events: DataFrame, matches: DataFrame, minutes: Sequence[int]) -> DataFrame:
    """(match, minute, goals_a, .., reds_b, and the other columns of matches) at each decision minute.

    events: (match, minute, kind goal or red, side a or b). An event counts from its minute on; one without a minute
    never does. Each event becomes one row of sums at the first decision that knows it, and the decisions' sums run on.
    """
    at = F.array(*map(F.lit, sorted(minutes)))
    first = F.get(F.filter(at, lambda m: m >= F.col("minute")), F.lit(0))
    sums = events.withColumn("minute", first).where("minute is not null").groupBy("match", "minute").agg(
        *(F.count_if((F.col("kind") == kind) & (F.col("side") == side)).alias(f"{name}_{side}") for kind, name in (("goal", "goals"), ("red", "reds")) for side in "ab"))
    grid = matches.withColumn("minute", F.explode(at))
    names = [f"{n}_{s}" for n in ("goals", "reds") for s in "ab"]
    w = _running()
    joined = grid.join(sums, ["match", "minute"], "left")
    return joined.withColumns({n: F.coalesce(F.sum(n).over(w), F.lit(0)).cast("int") for n in names})


def _running():
    from pyspark.sql import Window

    return Window.partitionBy("match").orderBy("minute").rowsBetween(Window.unboundedPreceding, 0)


def replay(states: DataFrame) -> DataFrame:
    """States with the remaining-goals forecast, the draw's interval, entropy and its band (fixed values: low below 0.55, medium below 0.85)."""
    df = remaining_poisson(states)
    known = _known(states, "xg_a").isNotNull() & _known(states, "xg_b").isNotNull()
    worth = EVIDENCE + F.greatest(F.lit(0.0), F.col("minute").cast("double")) * PER_MINUTE + F.when(known, CHANCES).otherwise(0.0)
    half = 1.96 * F.sqrt(F.col("p_draw") * (1 - F.col("p_draw")) / worth)
    entropy = P.entropy(F.col("p_a"), F.col("p_draw"), F.col("p_b"))
    df = df.withColumns({"remaining": F.col("rate_a") + F.col("rate_b"), "draw_low": F.greatest(F.lit(0.0), F.col("p_draw") - half), "draw_high": F.least(F.lit(1.0), F.col("p_draw") + half), "entropy": entropy})
    return df.withColumn("band", F.when(F.col("entropy") < 0.55, "low").when(F.col("entropy") < 0.85, "medium").otherwise("high"))


HORIZONS = (1, 3, 5, 10)


def goal_dynamics(rate_a: Column, rate_b: Column, left: Column) -> dict[str, Column]:
    """Goals to come as columns, from both sides' rates for the ``left`` minutes: expected ones, who scores next, and one within 1, 3, 5 and 10 minutes."""
    total, left = F.greatest(F.lit(1e-9), rate_a + rate_b), F.greatest(F.lit(1e-9), left.cast("double"))

    def none(minutes: int) -> Column:
        return F.exp(-total * F.least(F.lit(float(minutes)), left) / left)

    out = {"remaining_a": rate_a, "remaining_b": rate_b, "next_goal_a": rate_a / total, "next_goal_b": rate_b / total, "no_goal_5": none(5)}
    return out | {f"goal_in_{h}": 1 - none(h) for h in HORIZONS}


def envelope(states: DataFrame, model: str = "M2_remaining_poisson") -> DataFrame:
    """The states with all that a model's record holds: its forecast, the goal dynamics of the ratings' rates, uncertainty and entropy."""
    rated = remaining_poisson(states)
    rates = goal_dynamics(F.col("rate_a"), F.col("rate_b"), F.greatest(F.lit(0.0), 90.0 - F.col("minute")))
    rated = rated.withColumns(rates)
    df = rated if MODELS[model] is remaining_poisson else MODELS[model](rated)
    p = [F.col(c) for c in ("p_a", "p_draw", "p_b")]
    spread = F.sqrt(sum((c * (1 - c) for c in p[1:]), p[0] * (1 - p[0])))
    return df.withColumns({"uncertainty": spread, "entropy": P.entropy(*p), "model": F.lit(model)}).drop("rate_a", "rate_b")


def prediction_records(states: DataFrame, source_ts: Column, decision_ts: Column) -> DataFrame:
    """Replayed states with completeness, the share of FIELDS that are known; a source later than its decision fails the job."""
    have = [F.col(f).isNotNull().cast("double") for f in FIELDS]
    safe = states.withColumn("completeness", F.round(sum(have[1:], have[0]) / len(FIELDS), 4))
    late = source_ts > decision_ts
    safe = safe.withColumn("leak", F.when(late, F.raise_error(F.lit("a source is later than its decision"))).otherwise(F.lit(False)))
    return replay(safe.where(~F.col("leak"))).drop("leak")
