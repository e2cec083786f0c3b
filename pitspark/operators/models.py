"""Model heads on pyspark.ml behind one hook: fit(train) gives a function that adds a prediction column."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import IDF, CountVectorizer, Normalizer, StandardScaler, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.ml.regression import GBTRegressor, GeneralizedLinearRegression, IsotonicRegression, LinearRegression
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import probs as P
from . import aggregates as A
from .joins import written

Predictor = Callable[[DataFrame], DataFrame]


def check_there(df: DataFrame, columns: Sequence[str]) -> None:
    missing = set(columns) - set(df.columns)
    if missing:
        raise ValueError(f"columns not there: {sorted(missing)}")


def _assembled(df: DataFrame, columns: Sequence[str], out: str = "_x") -> DataFrame:
    check_there(df, columns)
    return VectorAssembler(inputCols=list(columns), outputCol=out).transform(df)


def logistic(train: DataFrame, columns: Sequence[str], label: str, penalty: float = 0.01, name: str = "p", weight: str | None = None) -> Predictor:
    """Standardised logistic regression, rows weighted by a column if one is named; the prediction is an array of class probabilities."""
    rows = _assembled(train, columns)
    scale = StandardScaler(inputCol="_x", outputCol="_s", withMean=True).fit(rows)
    head = LogisticRegression(featuresCol="_s", labelCol=label, regParam=penalty, probabilityCol="_p", rawPredictionCol="_r", predictionCol="_l")
    model = (head.setWeightCol(weight) if weight else head).fit(scale.transform(rows))
    return lambda df: model.transform(scale.transform(_assembled(df, columns))).withColumn(name, vector_to_array("_p")).drop("_x", "_s", "_p", "_r", "_l")


def poisson(train: DataFrame, columns: Sequence[str], label: str, penalty: float = 0.0, name: str = "rate") -> Predictor:
    """Poisson regression of goal rates."""
    model = GeneralizedLinearRegression(family="poisson", link="log", featuresCol="_x", labelCol=label, regParam=penalty, predictionCol=name).fit(_assembled(train, columns))
    return lambda df: model.transform(_assembled(df, columns)).drop("_x")


def boosted(train: DataFrame, columns: Sequence[str], label: str, rounds: int = 10, name: str = "rate") -> Predictor:
    model = GBTRegressor(featuresCol="_x", labelCol=label, maxIter=rounds, maxDepth=3, seed=0, predictionCol=name).fit(_assembled(train, columns))
    return lambda df: model.transform(_assembled(df, columns)).drop("_x")


def isotonic(train: DataFrame, p: str, hit: str, name: str = "calibrated") -> Predictor:
    """Monotone calibration of a probability."""
    model = IsotonicRegression(featuresCol=p, labelCol="_y", predictionCol=name).fit(train.withColumn("_y", F.col(hit).cast("double")))
    return model.transform


#: Families differ by columns and head; each entry is fitted on training rows only.
FAMILIES: dict[str, tuple[Callable[..., Predictor], tuple[str, ...]]] = {
    "base": (logistic, ("one",)),
    "time_score": (logistic, ("minute", "diff")),
    "chance": (logistic, ("minute", "diff", "xg")),
    "full": (logistic, ("minute", "diff", "xg", "tilt")),
}


def ladder(train: DataFrame, test: DataFrame, label: str, families: Sequence[str]) -> DataFrame:
    """(model, n, log_loss) on test rows of families fitted on train; families whose columns are missing fail."""
    scored = None
    for f in families:
        head, columns = FAMILIES[f]
        p = F.greatest(F.lit(1e-12), F.element_at("p", F.col(label).cast("int") + 1))
        part = head(train.withColumn("one", F.lit(1.0)), columns, label)(test.withColumn("one", F.lit(1.0))).select(F.lit(f).alias("model"), (-F.log(p)).alias("loss"))
        scored = part if scored is None else scored.unionByName(part)
    return scored.groupBy("model").agg(F.count("*").alias("n"), F.avg("loss").alias("log_loss"))


# ---------------------------------------------------------------- calibration and composed models


def ridge(train: DataFrame, columns: Sequence[str], label: str, penalty: float = 1.0, name: str = "value") -> Predictor:
    """Linear regression with standardised columns and a ridge penalty."""
    model = LinearRegression(featuresCol="_x", labelCol=label, regParam=penalty, elasticNetParam=0.0, predictionCol=name).fit(_assembled(train, columns))
    return lambda df: model.transform(_assembled(df, columns)).drop("_x")


def platt(train: DataFrame, p: str, hit: str, name: str = "calibrated") -> Predictor:
    """A logistic line over the log odds of a probability."""
    odds = lambda df: df.withColumn("_odds", F.log(P.clip(F.col(p), 1e-6, 1 - 1e-6) / (1 - P.clip(F.col(p), 1e-6, 1 - 1e-6))))
    fitted = logistic(odds(train).withColumn("_hit", F.col(hit).cast("double")), ["_odds"], "_hit", penalty=0.0, name="_p2")
    return lambda df: fitted(odds(df)).withColumn(name, F.col("_p2")[1]).drop("_p2", "_odds")


def calibrated_wdl(train: DataFrame, outcome: str, names: Sequence[str] = ("p_a", "p_draw", "p_b"), classes: Sequence[str] = "ADB", head: Callable[..., Predictor] = isotonic) -> Predictor:
    """Each class calibrated by itself on training rows, then normalised."""
    heads = [head(train.withColumn("_hit", F.col(outcome) == c), n, "_hit", name=f"_{n}") for n, c in zip(names, classes)]

    def predict(df: DataFrame) -> DataFrame:
        for h in heads:
            df = h(df)
        new = P.normalize(*(F.col(f"_{n}") for n in names))
        return df.withColumns(dict(zip(names, new))).drop(*(f"_{n}" for n in names))

    return predict


def draw_calibrated(train: DataFrame, outcome: str, head: Callable[..., Predictor] = platt, names: Sequence[str] = ("p_a", "p_draw", "p_b")) -> Predictor:
    """The draw calibrated, the other two keeping their proportion."""
    a, d, b = names
    fitted = head(train.withColumn("_hit", F.col(outcome) == "D"), d, "_hit", name="_draw")

    def predict(df: DataFrame) -> DataFrame:
        rest = (1 - F.col("_draw")) / (F.col(a) + F.col(b))
        return fitted(df).withColumns({a: F.col(a) * rest, b: F.col(b) * rest, d: F.col("_draw")}).drop("_draw")

    return predict


def _goals_to_wdl(df: DataFrame, rate_a: Column, rate_b: Column, diff: str) -> DataFrame:
    return P.with_wdl(df.withColumns({"rate_a": rate_a, "rate_b": rate_b}), F.col("rate_a"), F.col("rate_b"), F.col(diff), names=("p_a", "p_draw", "p_b"))


def intensity_wdl(train: DataFrame, columns: Sequence[str], left_a: str, left_b: str, diff: str, outcome: str) -> Predictor:
    """Remaining goals of each side by a ridge on log(1 + goals), then W/D/L, each class calibrated on training rows.

    A head fitted on another domain's rows and handed in as a column of ``columns`` is a frozen representation.
    """
    train = written(train)
    heads = [ridge(train.withColumn("_y", F.log1p(F.col(g).cast("double"))), columns, "_y", name=f"_log_{s}") for g, s in ((left_a, "a"), (left_b, "b"))]

    def raw(df: DataFrame) -> DataFrame:
        for h in heads:
            df = h(df)
        rates = [F.greatest(F.lit(0.0), F.expm1(f"_log_{s}")) for s in "ab"]
        return _goals_to_wdl(df, *rates, diff).drop("_log_a", "_log_b")

    calibrate = calibrated_wdl(written(raw(train)), outcome)
    return lambda df: calibrate(raw(df))


def competing_risk_wdl(train: DataFrame, columns: Sequence[str], next_a: str, next_b: str, left_minutes: str, diff: str, outcome: str, horizon: float = 10.0, base_rate: float = P.REFERENCE_RATE) -> Predictor:
    """Hazards of either side scoring within the horizon, as rates of the minutes that are left, then W/D/L, calibrated.

    A side whose label is one-sided in training falls back to the base rate for the rest of the match.
    """
    train = written(train)
    n = train.agg(*(F.count_distinct(F.col(c).cast("int")).alias(c) for c in (next_a, next_b))).first()
    heads = {s: logistic(train.where(F.col(c).isNotNull()).withColumn("_y", F.col(c).cast("double")), columns, "_y", name=f"_h_{s}") if n[c] > 1 else None for c, s in ((next_a, "a"), (next_b, "b"))}

    def raw(df: DataFrame) -> DataFrame:
        rates = {}
        left = F.greatest(F.lit(0.0), F.col(left_minutes))
        for s, h in heads.items():
            if h is not None:
                df = h(df)
                rates[s] = -F.log(1 - P.clip(F.col(f"_h_{s}")[1], 1e-6, 0.999)) / horizon * left
            else:
                rates[s] = P.remaining_rate(left, base_rate)
        return _goals_to_wdl(df, rates["a"], rates["b"], diff).drop("_h_a", "_h_b")

    calibrate = calibrated_wdl(written(raw(train)), outcome)
    return lambda df: calibrate(raw(df))


#: Weights of a correction that a gate may choose for partly and for fully known rows, and the thresholds between them.
LOW, FULL, THRESHOLDS = (0.0, 0.25, 0.5), (0.0, 0.5, 0.75, 1.0), ((0.40, 0.75), (0.50, 0.80), (0.60, 0.85))


def selective_gate(train: DataFrame, known: str, base: Sequence[str], corrected: Sequence[str], outcome: str, low: Sequence[float] = LOW, full: Sequence[float] = FULL, thresholds: Sequence[tuple[float, float]] = THRESHOLDS) -> DataFrame:
    """(t_low, t_full, alpha_low, alpha_full, loss, base_loss): the blend of two forecasts with the least training log loss.

    How much of a row is known decides its weight: alpha_full from t_full on, alpha_low from t_low on, else none; the
    full weight is never below the low one. No correction is chosen unless it helps. The losses of all settings come from
    one aggregate over the rows: a row's loss depends on its band and weight alone.
    """
    weights = sorted({*low, *full})
    losses = F.array(*(P.log_loss(*((1 - w) * F.col(b) + w * F.col(c) for b, c in zip(base, corrected)), F.col(outcome)) for w in weights))
    rows = train.select(F.col(known).alias("k"), losses.alias("l"))
    edges = sorted({t for pair in thresholds for t in pair})
    band = sum((F.when(F.col("k") >= t, 1).otherwise(0) for t in edges[1:]), F.when(F.col("k") >= edges[0], 1).otherwise(0))
    sums = {(b, i): s for b, i, s in ((r["band"], i, r[f"s{i}"]) for r in rows.groupBy(band.alias("band")).agg(*(F.sum(F.col("l")[i]).alias(f"s{i}") for i in range(len(weights)))).collect() for i in range(len(weights)))}
    n, zero = train.count(), weights.index(0.0)
    best = None
    for t_low, t_full in thresholds:
        for a_low in low:
            for a_full in full:
                if a_full >= a_low:
                    of = lambda b: weights.index(a_full if b > edges.index(t_full) else a_low if b > edges.index(t_low) else 0.0)  # noqa: B023, E731
                    loss = sum(s for (b, i), s in sums.items() if i == of(b)) / n
                    if best is None or loss < best[4] - 1e-12:
                        best = (t_low, t_full, a_low, a_full, loss)
    base_loss = sum(s for (_, i), s in sums.items() if i == zero) / n
    if best[4] >= base_loss - 1e-12:
        best = (*best[:2], 0.0, 0.0, base_loss)
    return train.sparkSession.createDataFrame([(*best, base_loss)], "t_low double, t_full double, alpha_low double, alpha_full double, loss double, base_loss double")


#: Fixed value: positive texts below which a class stays silent.
LEAST_POSITIVES = 10


def text_classifier(train: DataFrame, text: str, label: str, rule: Callable[[Column], Column], alpha: float = 0.5, least_texts: int = 5, words: int = 30_000, chars: int = 20_000, strength: float = 4.0, name: str = "confidence") -> Predictor:
    """Logistic regression on TF-IDF of words, word pairs and 3 to 5 letters within words, both classes weighing the same, blended with a rule's score (0 to 1) and silent where the rule is.

    Words and letters have a norm of one each, and the ridge penalty is 1 / (strength * texts). Terms count as often as they
    occur: a logarithm would make dense vectors of the sparse ones. All of a text counts; the vocabularies hold the most frequent terms of ``least_texts`` texts at least. With one class, or
    fewer than ``LEAST_POSITIVES`` texts of it, the model is silent: p is null and the confidence 0.
    """

    def terms(df: DataFrame) -> DataFrame:
        w = F.filter(F.split(F.lower(F.coalesce(F.col(text), F.lit(""))), r"[^\p{L}\p{N}_]+"), lambda x: x != "")
        df = df.withColumn("_w", w)
        pairs = F.transform(F.sequence(F.lit(1), F.greatest(F.size("_w") - 1, F.lit(1))), lambda i: F.concat_ws(" ", F.get("_w", i - 1), F.get("_w", i)))
        padded = F.transform("_w", lambda x: F.concat(F.lit(" "), x, F.lit(" ")))
        grams = [F.flatten(F.transform(padded, lambda x, k=k: F.transform(F.sequence(F.lit(1), F.greatest(F.length(x) - k + 1, F.lit(1))), lambda i: F.substring(x, i, k)))) for k in (3, 4, 5)]
        return df.withColumns({"_words": F.concat("_w", F.when(F.size("_w") > 1, pairs).otherwise(F.array().cast("array<string>"))), "_chars": F.concat(*grams)})

    y = F.col(label).cast("double")
    sizes = train.where(y.isNotNull()).agg(F.count_if(y == 1).alias("yes"), F.count("*").alias("n")).first()
    yes, n = sizes["yes"], sizes["n"]
    if yes < LEAST_POSITIVES or yes == n:
        # one class, or too few texts of it: there is nothing to tell apart, and the model says nothing
        return lambda df: df.withColumns({"p": F.lit(None).cast("double"), name: F.lit(0.0)})
    stages, counts, share = [], [], yes / n
    rows = terms(train).withColumns({"_y": y, "_weight": F.when(y == 1, 0.5 / share).otherwise(0.5 / (1 - share))}).where("_y is not null")
    for c, size in (("_words", words), ("_chars", chars)):
        count = CountVectorizer(inputCol=c, outputCol=f"{c}_n", minDF=least_texts, vocabSize=size)
        counts.append(count.fit(rows))
        stages += [IDF(inputCol=f"{c}_n", outputCol=f"{c}_v"), Normalizer(inputCol=f"{c}_v", outputCol=f"{c}_u")]
    stages += [VectorAssembler(inputCols=["_words_u", "_chars_u"], outputCol="_x")]
    stages += [LogisticRegression(featuresCol="_x", labelCol="_y", weightCol="_weight", regParam=1 / (strength * n), probabilityCol="_p", rawPredictionCol="_r", predictionCol="_l", standardization=False)]
    # what is counted is written: the terms themselves, many times a text, are made for the two vocabularies and once more
    counted = written(PipelineModel(counts).transform(rows).select("_words_n", "_chars_n", "_y", "_weight"))
    model = PipelineModel([*counts, *Pipeline(stages=stages).fit(counted).stages])

    def predict(df: DataFrame) -> DataFrame:
        out = model.transform(terms(df)).withColumn("_rule", rule(F.col(text)))
        p = vector_to_array("_p")[1]
        return out.select(*df.columns, p.alias("p"), F.when(F.col("_rule") > 0, alpha * p + (1 - alpha) * F.col("_rule")).otherwise(0.0).alias(name))

    return predict


def transfer_ladder(main: DataFrame, aux: DataFrame, columns: Sequence[str], label: str, most_smd: float = 0.5, share: float = 0.25) -> dict[str, Predictor]:
    """Ways to learn from another domain's rows, each a function that adds p (of label 1): on main rows only, all rows
    alike, all rows on columns that both domains have alike (standardised mean difference up to ``most_smd``), all rows with
    each domain's own deviations from a common line (partial pooling), the other domain's rows weighing ``share`` of the
    main ones together, and that with the weight that the main rows' loss chooses, none included (selective).
    """
    rows = main.withColumn("_d", F.lit(False)).unionByName(aux.withColumn("_d", F.lit(True)), allowMissingColumns=True).na.fill(0.0, list(columns))
    rows = written(rows.select(*columns, label, "_d"))
    table = A.stable_features(A.drift(rows, columns, "_d"), most_smd=most_smd)
    stable = [r["feature"] for r in table.where("verdict = 'keep'").select("feature").collect()] or list(columns)
    n = {r["_d"]: r["count"] for r in rows.groupBy("_d").count().collect()}
    pair = lambda df: df.withColumns({f"_own_{c}": F.when(F.col("_d"), 0.0).otherwise(F.col(c)) for c in columns} | {"_own": F.when(F.col("_d"), 0.0).otherwise(1.0)})

    def of(head: Predictor, change: Callable[[DataFrame], DataFrame] = lambda df: df, drop: Sequence[str] = ()) -> Predictor:
        return lambda df: head(change(df.withColumn("_d", F.lit(False)).na.fill(0.0, list(columns)))).withColumn("p", F.col("p")[1]).drop("_d", "_w", *drop)

    def weighted(part: float) -> Predictor:
        w = F.when(F.col("_d"), part * n[False] / max(n.get(True, 0), 1)).otherwise(1.0)
        return of(logistic(rows.withColumn("_w", w), columns, label, weight="_w"))

    own = [f"_own_{c}" for c in columns] + ["_own"]
    ladder = {
        "main_only": of(logistic(rows.where(~F.col("_d")), columns, label)), "naive_pool": of(logistic(rows, columns, label)), "shared_stable": of(logistic(rows, stable, label)),
        "partial_pooling": of(logistic(pair(rows), [*columns, *own], label, penalty=0.05), pair, own), "domain_weighted": weighted(share),
    }
    # the choice is made on a half of the main rows that the candidates are not fitted on
    half = F.pmod(F.xxhash64(*columns, label), F.lit(2)) == 0
    held, losses = main.where(half), {}
    for part in (0.0, share, 1.0):
        w = F.when(F.col("_d"), part * n[False] / max(n.get(True, 0), 1)).otherwise(1.0)
        kept = rows.where(F.col("_d") | ~half) if part else rows.where(~F.col("_d") & ~half)
        p = P.clip(F.col("p"), 1e-9, 1 - 1e-9)
        loss = -F.when(F.col(label) == 1, F.log(p)).otherwise(F.log(1 - p))
        losses[part] = of(logistic(kept.withColumn("_w", w), columns, label, weight="_w"))(held).agg(F.avg(loss)).first()[0]
    best = min(losses, key=lambda k: (losses[k], k))
    ladder["selective"] = ladder["main_only"] if not best else ladder["domain_weighted"] if best == share else weighted(best)
    return ladder
