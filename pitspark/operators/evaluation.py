"""Evaluation over folds: year folds with a composite score, nested selection, the walk-forward report and the callback over folds."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import probs as P
from . import aggregates as A
from .joins import band_pairs, written
from .players import FIRST, rating_change
from .selection import upsert

#: Fixed weights of the composite score; every part is better when lower.
WEIGHTS = {"rps": 0.40, "log_loss": 0.25, "draw_brier": 0.20, "draw_calibration_error": 0.15}


def year_folds(df: DataFrame, year: Column, test_years: DataFrame) -> DataFrame:
    """df once for each fold (test_year) and role: train before the year, test in it; other rows drop out.

    A fold's training rows are rows of df, so folds multiply rows: fit from sums by year where a model allows it.
    """
    rows = df.withColumn("_year", year)
    joined = rows.join(F.broadcast(test_years.select("test_year")), F.col("_year") <= F.col("test_year"))
    return joined.withColumn("role", F.when(F.col("_year") < F.col("test_year"), "train").otherwise("test")).drop("_year")


def prior_rates(df: DataFrame, year: Column, outcome: str, smooth: float = 1.0) -> DataFrame:
    """(test_year, pa, pd, pb, n_train): the outcome rates of all earlier years, from one count a year; years without earlier ones are left out."""
    w = Window.orderBy("test_year").rowsBetween(Window.unboundedPreceding, -1)  # one row a year
    n = df.groupBy(year.alias("test_year")).agg(F.count("*").alias("n"), *(F.count_if(F.col(outcome) == y).alias(y) for y in "ADB"))
    before = n.select("test_year", F.sum("n").over(w).alias("n_train"), *(F.sum(y).over(w).alias(y) for y in "ADB")).where("n_train > 0")
    return before.select("test_year", "n_train", *(((F.col(y) + smooth) / (F.col("n_train") + 3 * smooth)).alias(p) for y, p in zip("ADB", ("pa", "pd", "pb"))))


def fold_metrics(scored: DataFrame, by: Sequence[str], bins: int = 10) -> DataFrame:
    """Mean scores and the draw's calibration error for each key, of rows with pa, pd, pb and outcome."""
    means = A.forecast_metrics(scored, by)
    table = A.reliability(scored, "pd", F.col("outcome") == "D", bins, rule="left", by=by)
    return means.join(A.ece(table, by).withColumnRenamed("ece", "draw_calibration_error"), list(by))


def composite(metrics: DataFrame, weights: dict[str, float] = WEIGHTS) -> DataFrame:
    terms = [w * F.col(m) for m, w in weights.items()]
    return metrics.withColumn("composite", sum(terms[1:], terms[0]))


def nested_selection(fold_scores: DataFrame, held: str, model: str, total: str, n: str) -> DataFrame:
    """(held, model, inner, outer): for each held-out fold the model that is best on the others, and its score on the held one.

    fold_scores: (held, model, total, n), each model's summed loss on a fold by forecasts made without that fold. The
    inner score of a model is that of all other folds: all sums less the held one's. Ties go to the smaller name.
    """
    every = Window.partitionBy(model)
    inner = fold_scores.withColumn("inner", (F.sum(total).over(every) - F.col(total)) / (F.sum(n).over(every) - F.col(n)))
    best = inner.groupBy(held).agg(F.min(F.struct("inner", model, (F.col(total) / F.col(n)).alias("outer"))).alias("b"))
    return best.select(held, F.col(f"b.{model}").alias(model), "b.inner", "b.outer")


def over_folds(df: DataFrame, fold: str, factory: Callable[[DataFrame], dict[str, Callable[[DataFrame], DataFrame]]], folds: Sequence) -> DataFrame:
    """The rows of each fold once for each model of ``factory(rows of the earlier folds)``, with fold and model.

    ``factory`` gives, by name, functions of a DataFrame that add a prediction; folds come in their order, and the first
    has nothing to learn from, so it is left out. The number of folds is small: each is a plan of its own.
    """
    scored = None
    for i, held in enumerate(folds[1:], 1):
        models = factory(df.where(F.col(fold).isin(list(folds[:i]))))
        for name, predict in models.items():
            part = predict(df.where(F.col(fold) == held)).withColumn("model", F.lit(name))
            scored = part if scored is None else scored.unionByName(part)
    if scored is None:
        raise ValueError("two folds at least")
    return scored


def walk_forward(df: DataFrame, is_test: Column, factory: Callable[[DataFrame], dict[str, Callable[[DataFrame], DataFrame]]], edge: float = 0.03) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(metrics, predictions, edges) of all models fitted on the rows that are no test.

    Predictions: test rows once a model, with pa, pd, pb and model. Metrics: a row a model. Edges: predictions whose draw
    beats the market's (p_market) by ``edge`` at least; none where there is no market.
    """
    test = df.where(is_test)
    rows = None
    for name, predict in factory(df.where(~is_test)).items():
        part = predict(test).withColumn("model", F.lit(name))
        rows = part if rows is None else rows.unionByName(part)
    metrics = A.forecast_metrics(rows, ["model"])
    gap = F.col("pd") - F.col("p_market") if "p_market" in rows.columns else F.lit(None).cast("double")
    return metrics, rows, rows.withColumn("edge", gap).where(F.col("edge") >= edge)


def temporal_folds(main: DataFrame, aux: DataFrame, fold: str, date: str) -> DataFrame:
    """(held, cutoff, role, domain, and the rows' columns): for each fold of main, the rows of both domains strictly before its first date, and its own as test.

    A fold without earlier rows of main is left out. Folds are few: their table is broadcast.
    """
    first = main.groupBy(F.col(fold).alias("held")).agg(F.min(date).alias("cutoff"))
    start = main.agg(F.min(date).alias("_start"))
    first = first.join(F.broadcast(start)).where("_start < cutoff").drop("_start")
    train = [df.join(F.broadcast(first), F.col(date) < F.col("cutoff")).withColumns({"role": F.lit("train"), "domain": F.lit(d)}) for df, d in ((main, "main"), (aux, "aux"))]
    test = main.join(F.broadcast(first), F.col(fold) == F.col("held")).withColumns({"role": F.lit("test"), "domain": F.lit("main")})
    return train[0].unionByName(train[1], allowMissingColumns=True).unionByName(test, allowMissingColumns=True)


def coverage_recovery(truth: DataFrame, emitted: DataFrame, keys: Sequence[str], cls: str, t_true: str, t_emit: str, width: int) -> DataFrame:
    """A row for each class: true events, those that an emission of their class lies within ``width`` of, emissions and false ones, recall, burden, and the median and 90th percentile of the time between.

    An emission speaks for the nearest true event of its keys and class, ties to the earlier. ``true_events`` counts rows of truth, repeats included; recall and matching go by distinct times.
    """
    by = [*keys, cls]
    events, said = truth.select(*by, t_true).distinct(), emitted.select(*by, t_emit).withColumn("_id", F.monotonically_increasing_id())
    said = written(said)
    near = band_pairs(said, events, by, t_emit, t_true, width).groupBy("_id", *by, t_emit)
    near = near.agg(F.min(F.struct(F.abs(F.col(t_true) - F.col(t_emit)).alias("gap"), F.col(t_true).alias("at"))).alias("_n")).select(*by, "_n.gap", "_n.at")
    # distinct gaps, of which there are width + 1 at most, say where a share of the hits ends
    counted = near.groupBy(cls, "gap").agg(F.count("*").alias("_c"))
    total = counted.groupBy(cls).agg(F.sum("_c").alias("hits"))
    upto = counted.withColumn("_to", F.sum("_c").over(Window.partitionBy(cls).orderBy("gap"))).join(total, cls)
    at = lambda place: F.min(F.when(F.col("_to") >= place, F.col("gap")))
    hits = upto.groupBy(cls).agg(F.first("hits").alias("hits"), ((at(F.floor((F.col("hits") + 1) / 2)) + at(F.floor(F.col("hits") / 2) + 1)) / 2.0).alias("timing_median"), at(F.greatest(F.lit(1), F.floor(F.col("hits") * 0.9))).alias("timing_p90"))
    recovered = near.select(*by, "at").distinct().groupBy(cls).agg(F.count("*").alias("recovered"))
    out = truth.groupBy(cls).agg(F.count("*").alias("true_events")).join(said.groupBy(cls).agg(F.count("*").alias("emitted")), cls, "full_outer").join(hits, cls, "left").join(recovered, cls, "left")
    out = out.na.fill(0, ["true_events", "emitted", "hits", "recovered"]).withColumn("false_ones", F.col("emitted") - F.col("hits"))
    ratio = lambda a, b: F.when(F.col(b) > 0, F.col(a) / F.col(b))
    return out.drop("hits").withColumns({"recall": ratio("recovered", "true_events"), "burden": ratio("false_ones", "emitted")})


def refresh(matches: DataFrame, results: DataFrame, ratings: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(matches, ratings, predictions) after results (id, ga, gb) of matches (id, a, b, ga, gb) have come.

    Results replace what was there; teams' ratings (team, rating) move by all new results at once, from the ratings before
    them; matches that are still open are forecast from the new ratings. Teams without a rating start at the first one.
    """
    new = upsert(matches, matches.drop("ga", "gb").join(results, "id"), "id").select(*matches.columns)
    played = matches.drop("ga", "gb").join(results, "id")
    rating = lambda df, side: df.join(ratings.select(F.col("team").alias(side), F.col("rating").alias(f"r{side}")), side, "left").na.fill(FIRST, [f"r{side}"])
    d = rating(rating(played, "a"), "b").withColumn("d", rating_change(F.col("ra"), F.col("rb")))
    moved = d.select(F.col("a").alias("team"), "d").union(d.select("b", -F.col("d"))).groupBy("team").agg(F.sum("d").alias("d"))
    after = ratings.join(moved, "team", "full_outer").select("team", (F.coalesce("rating", F.lit(FIRST)) + F.coalesce("d", F.lit(0.0))).alias("rating"))
    side = lambda df, s: df.join(after.select(F.col("team").alias(s), F.col("rating").alias(f"r{s}")), s, "left").na.fill(FIRST, [f"r{s}"])
    ahead = side(side(new.where("ga is null or gb is null"), "a"), "b")
    p = P.ternary_probs(F.col("ra") - F.col("rb"))
    return new, after, ahead.select("id", "a", "b", *(x.alias(n) for x, n in zip(p, ("pa", "pd", "pb"))))


#: Fixed values of the promotion rules: matches, rows and folds below which nothing is said, folds and their share that must favour, and how much worse the draw's calibration may be.
LEAST_MATCHES, LEAST_ROWS, LEAST_FOLDS, FAVOURING, FAVOURING_SHARE, CALIBRATION = 30, 200, 2, 4, 0.75, 0.02


def promotion(scored: DataFrame, fold: str, match: str, candidate: str, reference: str, allowed: Column | None = None, resamples: int = 2000) -> DataFrame:
    """One row of evidence and a verdict on a candidate, from scored rows (fold, match, model, outcome, pa, pd, pb) of both models.

    Rules: ``improves``, the mean over folds of the ranked probability score is lower; ``steady``, so it is in four folds or three quarters;
    ``favours``, the interval of the matches' paired differences lies below 0; ``calibrated``, the draw's calibration error, averaged over folds, is not worse by more than
    ``CALIBRATION``; ``not_one_fold``, the mean difference stays below 0 without the fold that favours most (all sums less one); ``allowed``, no row that may not be judged;
    ``enough``, matches, rows and folds. data_insufficient without enough; rejected if calibration or ``allowed`` fails; promote if all hold; else keep_reference.
    """
    rows = scored.where(F.col("model").isin(candidate, reference)).withColumn("_s", P.rps(F.col("pa"), F.col("pd"), F.col("pb"), F.col("outcome")))
    rows = written(rows.withColumn("_ok", F.lit(True) if allowed is None else F.coalesce(allowed, F.lit(False))))
    mean = lambda model: F.avg(F.when(F.col("model") == model, F.col("_s")))
    tests = F.count_if(F.col("model") == candidate)
    by_fold = rows.groupBy(fold).agg(mean(candidate).alias("c"), mean(reference).alias("r"), tests.alias("n"), F.count_if(~F.col("_ok")).alias("bad"))
    errors = A.ece(A.reliability(rows, "pd", F.col("outcome") == "D", 10, rule="left", by=[fold, "model"]), [fold, "model"])
    errors = errors.groupBy(fold).agg(*(F.max(F.when(F.col("model") == m, F.col("ece"))).alias(n) for m, n in ((candidate, "ec"), (reference, "er"))))
    d = F.col("c") - F.col("r")
    sums = by_fold.join(errors, fold, "left").agg(
        F.count("*").alias("folds"), F.sum("n").alias("rows"), F.sum("bad").alias("bad"), F.avg("c").alias("candidate_rps"), F.avg("r").alias("reference_rps"), F.count_if(d < 0).alias("favouring"), F.count(d).alias("both"),
        F.sum(d).alias("_d"), F.min(d).alias("best_fold_difference"), F.avg("ec").alias("candidate_ece"), F.avg("er").alias("reference_ece"))
    each = rows.groupBy(match).agg((mean(candidate) - mean(reference)).alias("difference")).where("difference is not null")
    interval = A.cluster_bootstrap(each, match, "difference", resamples).select(F.col("low").alias("difference_low"), F.col("high").alias("difference_high"), F.col("clusters").alias("matches"))
    out = sums.join(interval)  # one row each
    out = out.withColumn("difference_without_best", F.try_divide(F.col("_d") - F.col("best_fold_difference"), F.col("both") - 1))
    yes = lambda c: F.coalesce(c, F.lit(False))
    rules = {
        "enough": yes((F.col("matches") >= LEAST_MATCHES) & (F.col("rows") >= LEAST_ROWS) & (F.col("folds") >= LEAST_FOLDS) & (F.col("both") > 0)),
        "improves": yes(F.col("candidate_rps") < F.col("reference_rps")), "steady": yes((F.col("favouring") >= FAVOURING) | (F.try_divide("favouring", "both") >= FAVOURING_SHARE)),
        "favours": yes(F.col("difference_high") < 0), "calibrated": F.coalesce(F.col("candidate_ece") <= F.col("reference_ece") + CALIBRATION, F.lit(True)),
        "not_one_fold": yes(F.col("difference_without_best") < 0), "allowed": F.col("bad") == 0,
    }
    out = out.withColumns(rules)
    strong = F.col("improves") & F.col("steady") & F.col("favours") & F.col("not_one_fold")
    verdict = F.when(~F.col("enough"), "data_insufficient").when(~F.col("calibrated") | ~F.col("allowed"), "rejected").when(strong, "promote").otherwise("keep_reference")
    return out.select(F.lit(candidate).alias("candidate"), F.lit(reference).alias("reference"), verdict.alias("verdict"), *rules, "matches", "rows", "folds", "favouring", "candidate_rps", "reference_rps", "difference_low", "difference_high", "difference_without_best", "candidate_ece", "reference_ece")


def chronological_split(df: DataFrame, date: str, start: Column) -> tuple[DataFrame, DataFrame]:
    """(train, test) before and from a date; an empty side is refused, rows without a date are in neither."""
    train, test = df.where(F.col(date) < start), df.where(F.col(date) >= start)
    for side, name in ((train, "training"), (test, "test")):
        if side.isEmpty():
            raise ValueError(f"no {name} rows")
    return train, test
