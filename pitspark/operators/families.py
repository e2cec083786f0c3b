"""Named model families as estimators with params: fitted on a fold's training rows, saved, loaded and compared.

A rung is one model of a family: a head, its columns and its target. The first rung of a family is the training rows' base
rate; the others add columns. A rung whose target has too few positives in training is gated and falls back to the base rate.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark import keyword_only
from pyspark.ml import Estimator, Model, Pipeline, PipelineModel
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import Imputer, StandardScaler, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.ml.param import Param, Params, TypeConverters
from pyspark.ml.param.shared import HasLabelCol, HasPredictionCol
from pyspark.ml.util import DefaultParamsReadable, DefaultParamsReader, DefaultParamsWritable, DefaultParamsWriter, MLReadable, MLReader, MLWritable, MLWriter
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .fits import class_loss
from .joins import written


@dataclass(frozen=True)
class Rung:
    columns: tuple[str, ...]
    label: str
    classes: int = 2
    penalty: float = 0.01
    least_positives: int = 1


STATE, CHANCES, GROUND = ("minute", "diff"), ("xg", "xg_diff"), ("tilt", "box")
#: Fixed value: positives below which a hazard of send-offs is not fitted.
SENDOFF_GATE = 150
WDL, GOAL, SOON, RED = "wdl", "next_goal", "goal_soon", "sendoff_after"


def _rungs(letter: str, label: str, *columns: tuple[str, ...], classes: int = 2, least: int = 1) -> dict[str, Rung]:
    return {f"{letter}{i}": Rung(c, label, classes, least_positives=least) for i, c in enumerate(((), *columns))}


#: The families: event process (e), state (r), scoring soon (h), next goal (q), discipline (y), live price (p), next goal by dynamics (n), chances fused (c).
FAMILIES: dict[str, dict[str, Rung]] = {
    "e": _rungs("e", WDL, STATE, STATE + CHANCES, STATE + GROUND, STATE + CHANCES + GROUND + ("reds_diff",), classes=3),
    "r": _rungs("r", WDL, STATE, STATE + ("reds_diff",), classes=3),
    "h": _rungs("h", SOON, STATE + ("xg",), STATE + CHANCES, STATE + CHANCES + GROUND),
    "q": _rungs("q", GOAL, STATE, STATE + CHANCES, STATE + CHANCES + GROUND),
    "y": _rungs("y", RED, ("minute", "reds_diff"), ("minute", "reds_diff", "diff", "tilt"), least=SENDOFF_GATE),
    "p": _rungs("p", WDL, ("market_a", "market_b"), ("market_a", "market_b") + STATE, classes=3),
    "n": _rungs("n", GOAL, ("minute", "diff", "reds_diff"), ("minute", "diff", "reds_diff", "market_a")),
    "c": _rungs("c", WDL, CHANCES, STATE + CHANCES, ("market_a", "market_b") + STATE + CHANCES, classes=3),
}


def rung_of(name: str) -> Rung:
    found = FAMILIES.get(name[:1], {}).get(name)
    if found is None:
        raise ValueError(f"no model is called {name}; there are {sorted(n for f in FAMILIES.values() for n in f)}")
    return found


class _RungParams(HasLabelCol, HasPredictionCol):
    rung: Param = Param(Params._dummy(), "rung", "name in the registry", typeConverter=TypeConverters.toString)
    penalty: Param = Param(Params._dummy(), "penalty", "ridge penalty on standardised columns", typeConverter=TypeConverters.toFloat)

    def getRung(self) -> str:
        return self.getOrDefault(self.rung)


class FamilyModel(Model, _RungParams, MLReadable, MLWritable):
    """A fitted rung: adds an array of class probabilities."""

    base: Param = Param(Params._dummy(), "base", "class shares of the training rows", typeConverter=TypeConverters.toListFloat)
    gated: Param = Param(Params._dummy(), "gated", "whether the target had too few positives", typeConverter=TypeConverters.toBoolean)

    def __init__(self, inner: PipelineModel | None = None):
        super().__init__()
        self.inner = inner

    def _transform(self, df: DataFrame) -> DataFrame:
        name, base = self.getPredictionCol(), self.getOrDefault(self.base)
        if self.inner is None:
            return df.withColumn(name, F.array(*map(F.lit, base)))
        columns = rung_of(self.getRung()).columns
        missing = sorted(set(columns) - set(df.columns))
        if missing:
            raise ValueError(f"columns not there: {missing}")
        doubles = df.withColumns({f"_c_{c}": F.col(c).cast("double") for c in columns})
        out = self.inner.transform(doubles)
        return out.select(*df.columns, vector_to_array("_p").alias(name))

    def write(self) -> MLWriter:
        return _FamilyWriter(self)

    @classmethod
    def read(cls) -> MLReader:
        return _FamilyReader(cls)


class _FamilyWriter(MLWriter):
    def __init__(self, instance: FamilyModel):
        super().__init__()
        self.instance = instance

    def saveImpl(self, path: str) -> None:
        DefaultParamsWriter.saveMetadata(self.instance, path, self.sparkSession, extraMetadata={"fitted": self.instance.inner is not None})
        if self.instance.inner is not None:
            self.instance.inner.write().save(f"{path}/inner")


class _FamilyReader(MLReader):
    def __init__(self, cls: type):
        super().__init__()
        self.cls = cls

    def load(self, path: str) -> FamilyModel:
        metadata = DefaultParamsReader.loadMetadata(path, self.sparkSession)
        model = FamilyModel(PipelineModel.load(f"{path}/inner") if metadata["fitted"] else None)
        model._resetUid(metadata["uid"])
        DefaultParamsReader.getAndSetParams(model, metadata)
        return model


class FamilyEstimator(Estimator, _RungParams, DefaultParamsReadable, DefaultParamsWritable):
    """A rung to be fitted: gaps filled with training means, columns standardised, a logistic head with a ridge penalty."""

    @keyword_only
    def __init__(self, *, rung: str | None = None, labelCol: str | None = None, penalty: float | None = None, predictionCol: str = "p"):
        super().__init__()
        self._setDefault(predictionCol="p")
        given = {k: v for k, v in self._input_kwargs.items() if v is not None}
        if rung is not None:
            given.setdefault("labelCol", rung_of(rung).label)
            given.setdefault("penalty", rung_of(rung).penalty)
        self._set(**given)

    def _fit(self, df: DataFrame) -> FamilyModel:
        rung, label = rung_of(self.getRung()), F.col(self.getLabelCol()).cast("int")
        rows = df.where(label.isNotNull())
        counts = {r["y"]: r["n"] for r in rows.groupBy(label.alias("y")).agg(F.count("*").alias("n")).collect()}  # a row a class
        n = sum(counts.values())
        base = [counts.get(i, 0) / n if n else 1 / rung.classes for i in range(rung.classes)]
        gated = rung.classes == 2 and counts.get(1, 0) < rung.least_positives
        inner = None
        if rung.columns and not gated and len(counts) > 1:
            own = [f"_c_{c}" for c in rung.columns]
            filled = [f"{c}_f" for c in own]
            stages = [
                Imputer(inputCols=own, outputCols=filled), VectorAssembler(inputCols=filled, outputCol="_x"), StandardScaler(inputCol="_x", outputCol="_s", withMean=True),
                LogisticRegression(featuresCol="_s", labelCol="_y", regParam=self.getOrDefault(self.penalty), probabilityCol="_p", rawPredictionCol="_r", predictionCol="_l", family="binomial" if rung.classes == 2 else "multinomial"),
            ]
            known = rows.withColumns({f"_c_{c}": F.col(c).cast("double") for c in rung.columns} | {"_y": label.cast("double")})
            inner = Pipeline(stages=stages).fit(known)
        model = FamilyModel(inner)
        model._set(base=base, gated=gated)
        return self._copyValues(model)


def compared(train: DataFrame, test: DataFrame, families: Sequence[str] = tuple(FAMILIES)) -> DataFrame:
    """(family, model, label, n, log_loss, base_loss, gated) of every rung of the families, fitted on train, on test rows with a known target."""
    # written once: each rung reads its rows several times
    train, test = written(train), written(test)
    out = None
    for family in families:
        for name, rung in FAMILIES[family].items():
            model = FamilyEstimator(rung=name).fit(train)
            scored = model.transform(test.where(F.col(rung.label).isNotNull()))
            base = F.array(*map(F.lit, model.getOrDefault(model.base)))
            part = scored.agg(F.count("*").alias("n"), F.avg(class_loss(F.col("p"), F.col(rung.label))).alias("log_loss"), F.avg(class_loss(base, F.col(rung.label))).alias("base_loss"))
            part = part.select(F.lit(family).alias("family"), F.lit(name).alias("model"), F.lit(rung.label).alias("label"), "*", F.lit(model.getOrDefault(model.gated)).alias("gated"))
            out = part if out is None else out.unionByName(part)
    return out
