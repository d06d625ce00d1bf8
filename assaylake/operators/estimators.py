"""Heuristic classifiers as estimators of pyspark.ml, for use in its pipelines; all can be saved and loaded with them.

Scores are expressions in Spark's SQL, so that they are kept as text. A parameter that is not set stands for None.
"""

from __future__ import annotations

from pyspark.ml import Estimator, Model
from pyspark.ml.param import Param, Params, TypeConverters
from pyspark.ml.util import DefaultParamsReadable, DefaultParamsWritable
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from assaylake.operators import heuristics, quantiles


class _Settings(Params, DefaultParamsReadable, DefaultParamsWritable):
    """The parameters of all of them; each sets those that it has."""

    score = Param(Params._dummy(), "score", "expression of the score", TypeConverters.toString)
    label = Param(Params._dummy(), "label", "column of the classes 0 and 1", TypeConverters.toString)
    columns = Param(Params._dummy(), "columns", "feature columns", TypeConverters.toListString)
    limits = Param(Params._dummy(), "limits", "a limit for each feature column", TypeConverters.toListFloat)
    flag = Param(Params._dummy(), "flag", "boolean column that must be set", TypeConverters.toString)
    threshold = Param(Params._dummy(), "threshold", "score from which a row is of class 1", TypeConverters.toFloat)
    quantile = Param(Params._dummy(), "quantile", "share of class 0 below the threshold", TypeConverters.toFloat)
    z = Param(Params._dummy(), "z", "deviations below the mean", TypeConverters.toFloat)

    def __init__(self, **settings):
        super().__init__()
        self._set(**{k: v for k, v in settings.items() if v is not None})

    def value(self, param: Param):
        return self.getOrDefault(param) if self.isDefined(param) else None


class RiskModel(Model, _Settings):
    """Adds score, prediction (score at or over the threshold) and probability (its logistic)."""

    def _transform(self, dataset: DataFrame) -> DataFrame:
        scored = dataset.withColumn("score", F.round(F.expr(self.value(self.score)) + 1e-9, 6))
        limit = F.lit(self.value(self.threshold)).cast("double")
        return scored.withColumns({"prediction": (F.col("score") >= limit).cast("int"), "probability": F.round(1 / (1 + F.exp(-F.col("score"))), 6)})


class RiskEstimator(Estimator, _Settings):
    """A score given as an expression; the threshold is given, or an exact quantile of the scores of class 0 of the label column."""

    def __init__(self, score: str | None = None, label: str | None = "y", quantile: float | None = 0.99, threshold: float | None = None):
        super().__init__(score=score, label=label, quantile=quantile, threshold=threshold)

    def _fit(self, dataset: DataFrame) -> RiskModel:
        if (limit := self.value(self.threshold)) is None:
            clean = dataset.where(F.col(self.value(self.label)) == 0).select(F.round(F.expr(self.value(self.score)) + 1e-9, 6).alias("score"))
            limit = quantiles.exact(clean, ["score"], [self.value(self.quantile)])["score"][0]
        return RiskModel(score=self.value(self.score), threshold=limit)


class MarginModel(Model, _Settings):
    """Adds prediction: every column at or over its limit (a limit that is no number holds for none), and the flag set where there is one."""

    def _transform(self, dataset: DataFrame) -> DataFrame:
        flag = self.value(self.flag)
        holds = F.col(flag) if flag else F.lit(True)
        for c, limit in zip(self.value(self.columns), self.value(self.limits), strict=True):
            holds = holds & (F.col(c) >= F.lit(limit)) & ~F.isnan(F.lit(limit))
        return dataset.withColumn("prediction", F.coalesce(holds, F.lit(False)).cast("int"))


class MarginEstimator(Estimator, _Settings):
    """Limits of columns: the mean less z deviations of class 1 (of its flagged rows, where there is a flag); one aggregate."""

    def __init__(self, columns: list[str] | None = None, label: str | None = "y", z: float | None = 1.0, flag: str | None = None):
        super().__init__(columns=columns, label=label, z=z, flag=flag)

    def _fit(self, dataset: DataFrame) -> MarginModel:
        known = dataset.where(F.col(self.value(self.label)) == 1)
        known = known.where(F.col(self.value(self.flag))) if self.value(self.flag) else known
        row = known.agg(*(F.avg(c) - self.value(self.z) * F.stddev_pop(c) for c in self.value(self.columns))).first()
        return MarginModel(columns=self.value(self.columns), limits=[float("nan") if x is None else x for x in row], flag=self.value(self.flag))


class NormModel(Model, _Settings):
    """Adds norm and prediction: the norm at or over the threshold."""

    def _transform(self, dataset: DataFrame) -> DataFrame:
        normed = dataset.withColumn("norm", heuristics.norm(self.value(self.columns)))
        return normed.withColumn("prediction", F.coalesce(F.col("norm") >= F.lit(self.value(self.threshold)).cast("double"), F.lit(False)).cast("int"))


class NormEstimator(Estimator, _Settings):
    """The norm of the columns from which a row is of class 1: that at place floor(quantile * n) among the n rows of class 1, or the given threshold."""

    def __init__(self, columns: list[str] | None = None, label: str | None = "y", quantile: float | None = 1.0, threshold: float | None = None):
        super().__init__(columns=columns, label=label, quantile=quantile, threshold=threshold)

    def _fit(self, dataset: DataFrame) -> NormModel:
        limit = self.value(self.threshold)
        limit = heuristics.norm_limit(dataset, self.value(self.columns), self.value(self.label), self.value(self.quantile)) if limit is None else limit
        return NormModel(columns=self.value(self.columns), threshold=limit)


class StumpModel(Model, _Settings):
    """Adds prediction: the class that most rows of the training had on a row's side of the split (limits: split, class up to it, class over it)."""

    def _transform(self, dataset: DataFrame) -> DataFrame:
        split, low, high = self.value(self.limits)
        return dataset.withColumn("prediction", F.when(F.col(self.value(self.columns)[0]) <= split, F.lit(int(low))).otherwise(F.lit(int(high))))


class StumpEstimator(Estimator, _Settings):
    """The one split of one column of the greatest Gini gain (see heuristics.stump()); ties go to the smaller name."""

    def __init__(self, columns: list[str] | None = None, label: str | None = "y"):
        super().__init__(columns=columns, label=label)

    def _fit(self, dataset: DataFrame) -> StumpModel:
        label = self.value(self.label)
        best = heuristics.stump(dataset, self.value(self.columns), label).orderBy(F.col("gain").desc(), "feature").first()
        if best is None:
            raise ValueError("no column has two values to split")
        low = F.col(best["feature"]) <= best["threshold"]
        share = dataset.agg(F.avg(F.when(low, F.col(label))).alias("low"), F.avg(F.when(~low, F.col(label))).alias("high")).first()
        return StumpModel(columns=[best["feature"]], limits=[float(best["threshold"]), float(share["low"] >= 0.5), float(share["high"] >= 0.5)])
