"""Rates, forecast scores, calibration, bootstrap, completeness and drift."""

from __future__ import annotations

import math
from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import probs as P
from .joins import written


def rate_by(df: DataFrame, keys: Sequence[str], event: Column) -> DataFrame:
    """n, hits and rate per key, and the key's share of all rows."""
    out = df.groupBy(*keys).agg(F.count("*").alias("n"), F.count_if(event).alias("hits"))
    return out.withColumns({"rate": F.col("hits") / F.col("n"), "share": F.col("n") / F.sum("n").over(Window.partitionBy(F.lit(1)))})


def binomial(spark, p: float, n: int) -> DataFrame:
    """(k, expected): the binomial distribution."""
    k = F.col("k")
    ways = F.factorial(F.lit(n)) / (F.factorial(k.cast("int")) * F.factorial((n - k).cast("int")))
    return spark.range(n + 1).withColumnRenamed("id", "k").withColumn("expected", ways * F.pow(F.lit(p), k) * F.pow(F.lit(1 - p), n - k))


def forecast_metrics(df: DataFrame, by: Sequence[str], p: Sequence[str] = ("pa", "pd", "pb"), outcome: str = "outcome") -> DataFrame:
    """Mean proper scores, sharpness and mean against observed draw rate per key, in one aggregate."""
    a, d, b = (F.col(c) for c in p)
    y = F.col(outcome)
    drawn = (y == "D").cast("double")
    return df.groupBy(*by).agg(
        F.count("*").alias("n"), F.avg(P.rps(a, d, b, y)).alias("rps"), F.avg(P.log_loss(a, d, b, y)).alias("log_loss"),
        F.avg(F.pow(d - drawn, 2)).alias("draw_brier"), F.avg(F.greatest(a, d, b)).alias("sharpness"), F.avg(d).alias("mean_draw"), F.avg(drawn).alias("draw_rate"),
    )


def bin_of(p: Column, bins: int, rule: str) -> Column:
    """The bin 0 .. bins - 1 of a probability; ``right``: (lo, hi], the lowest closed, ``left``: [lo, hi), the highest closed."""
    at = F.ceil(p * bins) - 1 if rule == "right" else F.floor(p * bins)
    return F.least(F.lit(bins - 1), F.greatest(F.lit(0), at)).cast("int")


def reliability(df: DataFrame, p: str, hit: Column, bins: int = 10, rule: str = "right", by: Sequence[str] = ()) -> DataFrame:
    binned = df.withColumns({"bin": bin_of(F.col(p), bins, rule), "_hit": hit.cast("double")})
    out = binned.groupBy(*by, "bin").agg(F.count("*").alias("n"), F.avg(p).alias("pred"), F.avg("_hit").alias("actual"))
    return out.withColumn("abs_error", F.abs(F.col("pred") - F.col("actual")))


def ece(table: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    return table.groupBy(*by).agg((F.sum(F.col("n") * F.col("abs_error")) / F.sum("n")).alias("ece"))


def interval_coverage(table: DataFrame, z: float = 1.645, least: int = 5) -> DataFrame:
    """Share of bins of at least ``least`` rows whose observed rate lies in the binomial band around the predicted one."""
    band = z * F.sqrt(F.greatest(F.col("pred") * (1 - F.col("pred")), F.lit(1e-9)) / F.col("n"))
    return table.where(F.col("n") >= least).agg(F.avg((F.abs(F.col("actual") - F.col("pred")) <= band).cast("double")).alias("coverage"), F.count("*").alias("bins"))


def slices(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Rows once for each slice column, as (slice, bucket)."""
    stacked = ", ".join(f"'{c}', cast(`{c}` as string)" for c in columns)
    return df.select("*", F.expr(f"stack({len(columns)}, {stacked}) as (slice, bucket)"))


def calibration_line(df: DataFrame, p: str, hit: Column, rounds: int = 12) -> tuple[float, float]:
    """Intercept and slope of the logistic regression of hits on logit(p), by Newton steps over aggregated sums."""
    q = P.clip(F.col(p), 1e-6, 1 - 1e-6)
    # rows of equal forecasts count as one, so that the steps run over far fewer
    rows = written(df.groupBy(F.log(q / (1 - q)).alias("x")).agg(F.sum(hit.cast("double")).alias("y"), F.count("*").alias("n")))
    a, b = 0.0, 1.0
    for _ in range(rounds):
        m = 1 / (1 + F.exp(-(a + b * F.col("x"))))
        w, r, x = F.col("n") * m * (1 - m), F.col("y") - F.col("n") * m, F.col("x")
        s = rows.agg(F.sum(r).alias("g0"), F.sum(r * x).alias("g1"), F.sum(w).alias("h00"), F.sum(w * x).alias("h01"), F.sum(w * x * x).alias("h11")).first()
        det = s.h00 * s.h11 - s.h01 * s.h01
        if not det:
            break
        da, db = (s.h11 * s.g0 - s.h01 * s.g1) / det, (s.h00 * s.g1 - s.h01 * s.g0) / det
        a, b = a + da, b + db
        if abs(da) + abs(db) < 1e-10:
            break
    return a, b


def cluster_bootstrap(df: DataFrame, cluster: str, value: str, resamples: int = 2000, seed: int = 0, low: float = 0.025, high: float = 0.975) -> DataFrame:
    """Mean and percentile interval of the clusters' means, clusters resampled with Poisson(1) weights.

    Rows become one mean a cluster first; the weight of a cluster in a resample comes from a hash of both, so it needs
    no order and repeats exactly. A task adds up the weights of its clusters in all resamples, and gives one row a resample.
    """
    means = df.groupBy(cluster).agg(F.avg(value).alias("m"))
    steps = np.cumsum([math.exp(-1) / math.factorial(k) for k in range(9)])

    def sums(batches):
        w, s = np.zeros(resamples), np.zeros(resamples)
        each = _spread(np.arange(resamples, dtype=np.uint64))
        for rows in batches:
            for at in range(0, len(rows), 256):
                part = rows.iloc[at : at + 256]
                u = (_spread(part["h"].to_numpy(np.int64).view(np.uint64)[:, None] ^ each) >> np.uint64(11)) / float(1 << 53)
                weight = np.searchsorted(steps, u, "right")
                w += weight.sum(0)
                s += part["m"].to_numpy(float) @ weight
        yield pd.DataFrame({"b": np.arange(resamples), "s": s, "w": w})

    drawn = means.where("m is not null").select(F.xxhash64(F.lit(seed), cluster).alias("h"), "m").mapInPandas(sums, "b long, s double, w double")
    drawn = drawn.groupBy("b").agg(F.sum("s").alias("s"), F.sum("w").alias("w")).where("w > 0")
    interval = drawn.agg(F.percentile(F.col("s") / F.col("w"), F.lit(low)).alias("low"), F.percentile(F.col("s") / F.col("w"), F.lit(high)).alias("high"))
    return means.agg(F.avg("m").alias("mean"), F.count("*").alias("clusters")).join(interval)


def _spread(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads them evenly."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def completeness(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """(column, present): the share of rows in which a column has a value, all from one pass."""
    row = df.agg(*(F.avg(F.col(c).isNotNull().cast("double")).alias(c) for c in columns))
    return row.select(F.expr(f"stack({len(columns)}, " + ", ".join(f"'{c}', `{c}`" for c in columns) + ") as (column, present)"))


def drift(df: DataFrame, features: Sequence[str], domain: str) -> DataFrame:
    """Per feature: share present, mean and deviation in each of two domains (false, true) and the standardised mean difference."""
    long = df.select(F.col(domain).alias("d"), F.expr(f"stack({len(features)}, " + ", ".join(f"'{c}', cast(`{c}` as double)" for c in features) + ") as (feature, v)"))

    def of(d: bool) -> list[Column]:
        v = F.when(F.col("d") == d, F.col("v"))
        s = "b" if d else "a"
        return [F.avg(v).alias(f"mean_{s}"), F.stddev_pop(v).alias(f"sd_{s}"), F.avg(F.when(F.col("d") == d, F.col("v").isNotNull().cast("double"))).alias(f"present_{s}")]

    out = long.groupBy("feature").agg(*of(False), *of(True))
    pooled = F.sqrt((F.col("sd_a") * F.col("sd_a") + F.col("sd_b") * F.col("sd_b")) / 2)
    return out.withColumn("smd", F.when(pooled > 0, F.abs(F.col("mean_a") - F.col("mean_b")) / pooled))


def stable_features(table: DataFrame, least_present: float = 0.5, most_smd: float = 1.0, excluded: Sequence[str] = ()) -> DataFrame:
    verdict = F.when(F.col("feature").isin(list(excluded)), "always_excluded").when(F.least("present_a", "present_b") < least_present, "insufficient_presence")
    return table.withColumn("verdict", verdict.when(F.col("smd") > most_smd, "domain_shifted").otherwise("keep"))


def release_scores(df: DataFrame, release: str, points: str) -> DataFrame:
    """z-score and rank percentile within a release; no spread gives null."""
    w = Window.partitionBy(release)
    rank = F.rank().over(w.orderBy(F.desc(points)))
    sd = F.stddev_samp(points).over(w)
    n = F.count("*").over(w)
    return df.withColumns({"z": F.when(sd > 0, (F.col(points) - F.avg(points).over(w)) / sd), "rank_pct": F.when(n > 1, 1 - (rank - 1) / (n - 1)).otherwise(1.0)})


def funnel(df: DataFrame, stages: Sequence[tuple[str, Column]]) -> DataFrame:
    """(stage, n): rows that pass every stage up to this one, from one pass."""
    passed, counts = F.lit(True), []
    for name, test in stages:
        passed = passed & F.coalesce(test, F.lit(False))
        counts.append(F.count_if(passed).alias(name))
    row = df.agg(F.count("*").alias("all"), *counts)
    names = ["all", *(n for n, _ in stages)]
    return row.select(F.expr(f"stack({len(names)}, " + ", ".join(f"'{n}', `{n}`" for n in names) + ") as (stage, n)"))
