"""Probability, rating, odds, pitch and text functions as columns."""

from __future__ import annotations

import math
from collections.abc import Callable, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import arrow_udf, pandas_udf

REFERENCE_RATE = 1.35  # goals per side and 90 minutes


def clip(x: Column, low: float, high: float) -> Column:
    return F.greatest(F.lit(low), F.least(F.lit(high), x))


def normalize(*p: Column, eps: float = 1e-12) -> list[Column]:
    """Clip to [eps, 1] and divide by the sum."""
    clipped = [clip(x, eps, 1.0) for x in p]
    total = sum(clipped[1:], clipped[0])
    return [x / total for x in clipped]


# ---------------------------------------------------------------- ratings


# The rating scale of 400 points, the tie weight 0.4, the draw's peak 0.30 and width 240.


def expected_score(delta: Column, scale: float = 400.0) -> Column:
    return 1 / (1 + F.pow(F.lit(10.0), -delta / scale))


def ternary_probs(delta: Column, r: float = 0.4, home: float = 0.0) -> list[Column]:
    """Win, draw, loss from a rating difference: of the expected score p, each side wins its square and r times p (1 - p)."""
    p = expected_score(delta + home)
    tie = r * p * (1 - p)
    win, loss = p * p + tie, (1 - p) * (1 - p) + tie
    return [clip(x, 1e-9, 1.0) for x in (win, 1 - win - loss, loss)]


def gaussian_draw(delta: Column, peak: float = 0.30, width: float = 240.0) -> Column:
    return peak * F.exp(-delta * delta / (2 * width * width))


def margin_multiplier(goal_diff: Column) -> Column:
    """1 up to one goal, 1.5 for two, (11 + difference) / 8 beyond."""
    n = F.abs(goal_diff)
    return F.when(n <= 1, 1.0).when(n == 2, 1.5).otherwise((11 + n) / 8.0)


# ---------------------------------------------------------------- odds


def implied(odds: Column) -> Column:
    """Null for odds that pay nothing."""
    return F.when(odds > 1, 1 / odds)


def no_vig(*odds: Column) -> list[Column]:
    raw = [implied(o) for o in odds]
    total = sum(raw[1:], raw[0])
    return [x / total for x in raw]


def kelly(p: Column, odds: Column, fraction: float = 1.0) -> Column:
    return F.when(odds > 1, F.greatest(F.lit(0.0), (p * odds - 1) / (odds - 1)) * fraction).otherwise(0.0)


def bet_risk(p: Column, odds: Column) -> dict[str, Column]:
    """Mean, variance and deviation of the profit per unit staked (odds - 1 if it comes, else -1), and their ratio, 0 without spread."""
    q = clip(p, 1e-9, 1 - 1e-9)
    ev = q * (odds - 1) - (1 - q)
    var = F.greatest(F.lit(0.0), q * (odds - 1) * (odds - 1) + (1 - q) - ev * ev)
    return {"ev": ev, "var": var, "sd": F.sqrt(var), "sharpe": F.when(var > 0, ev / F.sqrt(var)).otherwise(0.0)}


# ---------------------------------------------------------------- uncertainty


def entropy(*p: Column) -> Column:
    """Entropy of normalised probabilities, 1 at most."""
    q = normalize(*p)
    return -sum((x * F.log(F.greatest(x, F.lit(1e-12))) for x in q[1:]), q[0] * F.log(F.greatest(q[0], F.lit(1e-12)))) / math.log(len(p))


def risk_band(top: Column, entropy_: Column) -> Column:
    """Low from a top probability of 0.68 and entropy up to 0.55, medium from 0.55 and up to 0.75, else high."""
    return F.when((top >= 0.68) & (entropy_ <= 0.55), "low").when((top >= 0.55) & (entropy_ <= 0.75), "medium").otherwise("high")


def standard_error(p: Column, n_eff: float = 150.0, eps: float = 1e-9) -> Column:
    q = clip(p, eps, 1 - eps)
    return F.sqrt(q * (1 - q) / n_eff)


def categorical_covariance(*p: Column) -> Column:
    return F.array(*(F.array(*((a * (1 - a)) if i == j else -a * b for j, b in enumerate(p))) for i, a in enumerate(p)))


def temperature(t: float, *p: Column) -> list[Column]:
    powered = [F.pow(clip(x, 1e-12, 1.0), 1.0 / t) for x in p]
    total = sum(powered[1:], powered[0])
    return [x / total for x in powered]


# ---------------------------------------------------------------- goals


def poisson_pmf(rate: Column, k: Column) -> Column:
    return F.exp(-rate) * F.pow(rate, k) / F.factorial(k)


def poisson_array(rate: Column, most: int) -> Column:
    """Probabilities of 0 .. most goals; what lies beyond is left out."""
    return F.array(*(F.exp(-rate) * F.pow(rate, F.lit(k)) / math.factorial(k) for k in range(most + 1)))


def poisson_vector(rate: Column, most: int) -> Column:
    """Probabilities of 0 .. most goals, the tail in the last."""
    body = poisson_array(rate, most - 1)
    return F.concat(body, F.array(1 - F.aggregate(body, F.lit(0.0), lambda a, x: a + x)))


def _pmf(rate: np.ndarray, most: int) -> np.ndarray:
    """A row of probabilities of 0 .. most goals for each rate; what lies beyond is left out."""
    out = np.empty((len(rate), most + 1))
    out[:, 0] = np.exp(-rate)
    for k in range(1, most + 1):
        out[:, k] = out[:, k - 1] * rate / k
    return out


def _doubles(x: pa.Array) -> np.ndarray:
    """Doubles with NaN for null."""
    return pc.fill_null(x.cast(pa.float64()), math.nan).to_numpy(zero_copy_only=False)


def _struct(values: np.ndarray, names: Sequence[str], unknown: np.ndarray) -> pa.StructArray:
    """A struct a row of values; its fields are null where something was unknown."""
    return pa.StructArray.from_arrays([pa.array(v, pa.float64(), mask=unknown) for v in values.T], names=list(names))


#: Rows that are computed at once inside a batch, so that the arrays of all scores stay small.
CHUNK = 4096


def _chunked(run: Callable[[slice], np.ndarray], n: int, wide: int) -> np.ndarray:
    out = np.empty((n, wide))
    for at in range(0, n, CHUNK):
        out[at : at + CHUNK] = run(slice(at, at + CHUNK))
    return out


def with_wdl(df: DataFrame, home: Column, away: Column, diff: Column | None = None, most: int = 8, names: tuple[str, str, str] = ("win", "draw", "loss")) -> DataFrame:
    """df with win, draw, loss when home and away goals still to come (0 .. most) are Poisson and the score differs by diff.

    With the running sums of the away side's probabilities, each outcome is a sum over the home side's goals; whole Arrow
    batches at once. Null where a rate or the difference is.
    """
    kind = "struct<" + ", ".join(f"`{n}`: double" for n in names) + ">"

    @arrow_udf(kind)
    def wdl(h: pa.Array, a: pa.Array, d: pa.Array) -> pa.Array:
        rates, now = [_doubles(h), _doubles(a)], np.asarray(pc.fill_null(d.cast(pa.int64()), 0), np.int64)

        def run(part: slice) -> np.ndarray:
            p, q = (_pmf(r[part], most) for r in rates)
            below = np.zeros((len(p), most + 2))  # fewer than k away goals
            np.cumsum(q, axis=1, out=below[:, 1:])
            at = np.clip(now[part, None] + np.arange(most + 2), 0, most + 1)
            reached = np.take_along_axis(below, at, 1)
            total = p.sum(1) * below[:, -1]
            win, draw = (p * reached[:, :-1]).sum(1) / total, (p * np.diff(reached, axis=1)).sum(1) / total
            return np.stack([win, draw, 1 - (win + draw)], 1)

        unknown = np.asarray(pc.or_(pc.or_(pc.is_null(h), pc.is_null(a)), pc.is_null(d)))
        return _struct(_chunked(run, len(now), 3), names, unknown)

    now = diff if diff is not None else F.lit(0)
    out = df.withColumn("_wdl", wdl(home.cast("double"), away.cast("double"), now.cast("int")))
    return out.withColumns({n: F.col("_wdl").getField(n) for n in names}).drop("_wdl")


def _scores(h: np.ndarray, a: np.ndarray, rho: float, inflation: float, most: int) -> np.ndarray:
    """Rows of the normalised probabilities of all scores, home goals first: what lies beyond ``most`` goes to the last row
    and column, the four lowest scores are corrected (by no less than 0.001) and draws weigh 1 + inflation."""
    p, q = _pmf(h, most), _pmf(a, most)
    grid = p[:, :, None] * q[:, None, :]
    grid[:, most, :] += np.maximum(0.0, 1 - p.sum(1))[:, None] * q
    grid[:, :, most] += np.maximum(0.0, 1 - q.sum(1))[:, None] * p
    if rho:
        for i, j, tau in ((0, 0, 1 - h * a * rho), (0, 1, 1 + h * rho), (1, 0, 1 + a * rho), (1, 1, np.full(len(h), 1 - rho))):
            grid[:, i, j] *= np.maximum(0.001, tau)
    goals = np.arange(most + 1)
    grid[:, goals, goals] *= 1 + inflation
    grid = grid.reshape(len(h), -1)
    return grid / grid.sum(1, keepdims=True)


def with_score_grid(df: DataFrame, home: Column, away: Column, rho: float = 0.0, inflation: float = 0.0, most: int = 8, name: str = "grid") -> DataFrame:
    """df with the normalised score grid, an array of (i, j, p): null where a rate is. Whole Arrow batches at once."""
    wide = (most + 1) ** 2

    @arrow_udf("array<struct<i: int, j: int, p: double>>")
    def grid(h: pa.Array, a: pa.Array) -> pa.Array:
        rates = [_doubles(h), _doubles(a)]
        p = _chunked(lambda part: _scores(rates[0][part], rates[1][part], rho, inflation, most), len(h), wide)
        i, j = (np.tile(x, len(h)).astype(np.int32) for x in np.divmod(np.arange(wide), most + 1))
        cells = pa.StructArray.from_arrays([pa.array(i), pa.array(j), pa.array(p.ravel())], names=["i", "j", "p"])
        known = np.asarray(pc.and_(pc.is_valid(h), pc.is_valid(a)))
        return pa.ListArray.from_arrays(pa.array(np.arange(len(h) + 1, dtype=np.int32) * wide), cells, mask=pa.array(~known))

    return df.withColumn(name, grid(home.cast("double"), away.cast("double")))


def _masses(h: np.ndarray, a: np.ndarray, passed: np.ndarray, rho: float, inflation: float, most: int) -> np.ndarray:
    """For rows of rates the sums of their score grids over the columns of ``passed``; rows with the same two rates share one grid."""
    pairs, row = np.unique(np.stack([h, a], 1).view(complex).ravel(), return_inverse=True)
    got = _chunked(lambda part: _scores(pairs[part].real, pairs[part].imag, rho, inflation, most) @ passed, len(pairs), passed.shape[1])
    return got[row]


def with_grid_masses(df: DataFrame, home: Column, away: Column, tests: dict[str, Callable], rho: float = 0.0, inflation: float = 0.0, most: int = 8) -> DataFrame:
    """df with the probability of the scores that pass each test, a function of home and away goals: sums of the score grid, which no row has to carry."""
    i, j = np.divmod(np.arange((most + 1) ** 2), most + 1)
    passed = np.stack([np.asarray(test(i, j), float) for test in tests.values()], 1)
    kind = "struct<" + ", ".join(f"`{n}`: double" for n in tests) + ">"

    @arrow_udf(kind)
    def masses(h: pa.Array, a: pa.Array) -> pa.Array:
        return _struct(_masses(_doubles(h), _doubles(a), passed, rho, inflation, most), list(tests), np.asarray(pc.or_(pc.is_null(h), pc.is_null(a))))

    out = df.withColumn("_masses", masses(home.cast("double"), away.cast("double")))
    return out.withColumns({n: F.col("_masses").getField(n) for n in tests}).drop("_masses")


def grid_mass(grid: str, test) -> Column:
    """The probability of the scores (i, j) that pass a test."""
    return F.aggregate(F.filter(grid, lambda c: test(c["i"], c["j"])), F.lit(0.0), lambda s, c: s + c["p"])


#: Fixed values of the in-play update: what a red card takes from a side and gives to the other, what each goal
#: behind adds and each goal ahead takes, how much surprising chances count, and the rates that are possible.
RED_COST, RED_GAIN, BEHIND, AHEAD, XG_WEIGHT, LOWEST_RATE, HIGHEST_RATE = 0.30, 0.18, 0.14, 0.05, 0.35, 0.01, 5.0


def remaining_rates(rate_a: Column, rate_b: Column, minute: Column, diff: Column, reds_a: Column, reds_b: Column, xg_a: Column, xg_b: Column) -> list[Column]:
    """Rates of both sides for the rest of ninety minutes, from those before the match and the state: score, red cards and chances so far (null: unknown)."""
    played = clip(minute, 0.0, 120.0)
    left = F.greatest(F.lit(0.0), (90.0 - played) / 90.0)

    def one(rate: Column, lead: Column, reds: Column, theirs: Column, xg: Column) -> Column:
        score = F.when(lead < 0, 1 - BEHIND * lead).when(lead > 0, F.greatest(F.lit(0.2), 1 - AHEAD * lead)).otherwise(1.0)
        cards = F.pow(F.lit(max(0.05, 1 - RED_COST)), reds) * F.pow(F.lit(1 + RED_GAIN), theirs)
        surprise = clip(xg - rate * F.greatest(F.lit(1e-6), played / 90.0), -2.0, 2.0)
        chances = F.when(xg.isNull(), 1.0).otherwise(F.exp(XG_WEIGHT * surprise / F.greatest(F.lit(0.5), rate)))
        return clip(rate * left * score * cards * chances, LOWEST_RATE, HIGHEST_RATE)

    return [one(rate_a, diff, reds_a, reds_b, xg_a), one(rate_b, -diff, reds_b, reds_a, xg_b)]


def dixon_coles(i: Column, j: Column, home: Column, away: Column, rho: float) -> Column:
    """The correction of the four lowest scores."""
    return (
        F.when((i == 0) & (j == 0), 1 - home * away * rho).when((i == 0) & (j == 1), 1 + home * rho)
        .when((i == 1) & (j == 0), 1 + away * rho).when((i == 1) & (j == 1), F.lit(1 - rho)).otherwise(1.0)
    )


def scoreline_likelihood(d: np.ndarray, a: np.ndarray, b: np.ndarray, x: Sequence[float], correct: bool, least: float) -> np.ndarray:
    """For rows of goals (a, b) with log rates mu +- beta * d, and x = (mu, beta, rho): the negative log likelihood, its gradient and the
    upper half of its second derivatives, a row of the result each. A correction's factor counts as at least ``least``."""
    mu, beta, rho = x
    with np.errstate(all="ignore"):
        la, lb, zero = np.exp(mu + beta * d), np.exp(mu - beta * d), np.zeros(len(d))
        out = [la + lb - a * (mu + beta * d) - b * (mu - beta * d), la + lb - a - b, d * (la - lb - a + b), zero]
        out += [la + lb, d * (la - lb), zero, d * d * (la + lb), zero, zero]
        if correct:
            # the factor is 1 + rho g, with g = sign * exp(m mu + s beta d)
            low = [(a == i) & (b == j) for i, j in ((0, 0), (0, 1), (1, 0), (1, 1))]
            g, m, s = (np.select(low, v, 0.0) for v in ((-la * lb, la, lb, zero - 1), (zero + 2, zero + 1, zero + 1, zero), (zero, d, -d, zero)))
            factor = 1 + rho * g
            first = [rho * g * m / factor, rho * g * s / factor, g / factor]
            both = [rho * g * m * m, rho * g * m * s, g * m, rho * g * s * s, g * s, zero]
            second = [y / factor - first[i] * first[j] for y, (i, j) in zip(both, ((0, 0), (0, 1), (0, 2), (1, 1), (1, 2), (2, 2)))]
            held = factor <= least
            out = [out[0] - np.log(np.maximum(factor, least)), *(x - np.where(held, 0.0, y) for x, y in zip(out[1:], (*first, *second)))]
    return np.stack(out)


def remaining_rate(minutes: Column, rate: float = REFERENCE_RATE) -> Column:
    return rate * F.greatest(F.lit(0.0), minutes) / 90.0


def goal_within(rate: Column) -> Column:
    return 1 - F.exp(-rate)


# ---------------------------------------------------------------- scores of forecasts


def rps(a: Column, d: Column, b: Column, outcome: Column) -> Column:
    """Ranked probability score of one forecast, outcomes in the order A, D, B."""
    first, second = (outcome == "A").cast("double"), (outcome.isin("A", "D")).cast("double")
    return (F.pow(a - first, 2) + F.pow(a + d - second, 2)) / 2


def log_loss(a: Column, d: Column, b: Column, outcome: Column) -> Column:
    return -F.log(clip(F.when(outcome == "A", a).when(outcome == "D", d).when(outcome == "B", b), 1e-12, 1.0))


def wilson_lower(k: Column, n: Column, z: float = 1.96) -> Column:
    p = k / n
    return F.when(n > 0, (p + z * z / (2 * n) - z * F.sqrt(p * (1 - p) / n + z * z / (4 * n * n))) / (1 + z * z / n)).otherwise(0.0)


# ---------------------------------------------------------------- places and text


def haversine_km(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    a = F.pow(F.sin(F.radians(lat2 - lat1) / 2), 2) + F.cos(F.radians(lat1)) * F.cos(F.radians(lat2)) * F.pow(F.sin(F.radians(lon2 - lon1) / 2), 2)
    return 2 * 6371.0 * F.asin(F.sqrt(a))


def third(x: Column) -> Column:
    return F.when(x < 40, "defensive").when(x < 80, "middle").when(x >= 80, "final")


def channel(y: Column) -> Column:
    return F.when(y < 80 / 3, "left").when(y < 160 / 3, "centre").when(y.isNotNull(), "right")


def in_box(x: Column, y: Column) -> Column:
    return (x >= 102) & y.between(18, 62)


def shot_distance(x: Column, y: Column) -> Column:
    return F.hypot(120 - x, y - 40)


def shot_angle(x: Column, y: Column) -> Column:
    """The angle under which the goal (36 to 44) is seen."""
    return F.abs(F.atan2(44 - y, 120 - x) - F.atan2(36 - y, 120 - x))


ACCENTS = ("áàâäãåéèêëíìîïóòôöõúùûüçñýÁÀÂÄÉÈÊËÍÓÔÖÚÜÇÑ", "aaaaaaeeeeiiiiooooouuuucnyAAAAEEEEIOOOUUCN")


def strip_accents(text: Column) -> Column:
    return F.translate(text, *ACCENTS)


def normal_name(text: Column) -> Column:
    return F.trim(F.regexp_replace(F.lower(strip_accents(text)), "[^a-z0-9]+", " "))


def short_id(*parts: Column, n: int = 16) -> Column:
    return F.substring(F.sha2(F.concat_ws("|", *parts), 256), 1, n)


def z_of(confidence: float) -> float:
    """The normal quantile of a two-sided confidence, by bisection."""
    low, high = 0.0, 10.0
    for _ in range(80):
        mid = (low + high) / 2
        low, high = (mid, high) if math.erf(mid / math.sqrt(2)) < confidence else (low, mid)
    return low


def _log_beta(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    gamma = np.vectorize(math.lgamma, otypes=[float])
    return gamma(a) + gamma(b) - gamma(a + b)


def _beta_cdf(x: np.ndarray, a: np.ndarray, b: np.ndarray, terms: int = 200) -> np.ndarray:
    """The regularised incomplete beta function, by its continued fraction from the side where that is fast."""
    turn = x > (a + 1) / (a + b + 2)
    x, a, b = np.where(turn, 1 - x, x), np.where(turn, b, a), np.where(turn, a, b)
    tiny = 1e-300
    c, d = np.ones_like(x), 1 - (a + b) * x / (a + 1)
    d = 1 / np.where(np.abs(d) < tiny, tiny, d)
    value = d.copy()
    for m in range(1, terms):
        for top in (m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)), -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))):
            d, c = 1 + top * d, 1 + top / c
            d, c = 1 / np.where(np.abs(d) < tiny, tiny, d), np.where(np.abs(c) < tiny, tiny, c)
            step = d * c
            value = value * step
        if np.all(np.abs(step - 1) < 1e-13):
            break
    with np.errstate(divide="ignore"):
        out = np.exp(a * np.log(x) + b * np.log1p(-x) - _log_beta(a, b)) / a * value
    return np.where(turn, 1 - out, out)


def beta_interval(p: Column, n_eff: float = 150.0, alpha: float = 0.05) -> Column:
    """(low, high): the interval of Beta(1 + p n_eff, 1 + (1 - p) n_eff), by bisection of whole Arrow batches at once."""
    @pandas_udf("struct<low: double, high: double>")
    def interval(x: pd.Series) -> pd.DataFrame:
        value = x.to_numpy(float)
        q, to = np.unique(np.clip(value[~np.isnan(value)], 1e-9, 1 - 1e-9), return_inverse=True)
        a, b = 1 + q * max(n_eff, 1.0), 1 + (1 - q) * max(n_eff, 1.0)
        out = np.full((len(x), 2), np.nan)
        for side, level in enumerate((alpha / 2, 1 - alpha / 2)):
            low, high = np.zeros_like(q), np.ones_like(q)
            for _ in range(50):
                mid = (low + high) / 2
                under = _beta_cdf(mid, a, b) < level
                low, high = np.where(under, mid, low), np.where(under, high, mid)
            out[~np.isnan(value), side] = low[to]
        return pd.DataFrame(out, columns=["low", "high"])

    return interval(p)
