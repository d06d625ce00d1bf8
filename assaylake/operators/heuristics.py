"""Classifiers whose fit is an aggregate and whose prediction is an expression."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from assaylake.functions.content import topk_part_entropy
from assaylake.operators import quantiles


def _sum(columns: list[Column]) -> Column:
    return reduce(lambda a, b: a + b, columns)


def _term(name: str) -> str:
    return f"CAST(`{name.replace('`', '``')}` AS DOUBLE)"


def power_risk(weights: dict[str, tuple[float, float]]) -> str:
    """sqrt of the sum of (x * w) ^ c, as an expression."""
    if not weights:
        raise ValueError("a power risk needs a feature")
    return "sqrt(" + " + ".join(f"power({_term(c)} * {float(w)!r}D, {float(p)!r}D)" for c, (w, p) in weights.items()) + ")"


def linear_risk(weights: dict[str, tuple[float, float]]) -> str:
    """The sum of x * w * c over the sum of w, as an expression."""
    if not weights:
        raise ValueError("a linear risk needs a feature")
    return "(" + " + ".join(f"{_term(f)} * {float(w)!r}D * {float(c)!r}D" for f, (w, c) in weights.items()) + f") / {float(sum(w for w, _ in weights.values()))!r}D"


def norm(columns: list[str]) -> Column:
    """The Euclidean norm of the columns, to six places."""
    return F.round(F.sqrt(_sum([F.col(c).cast("double") * F.col(c) for c in columns])), 6)


def norm_limit(df: DataFrame, columns: list[str], target: str, confidence: float) -> float | None:
    """The norm at place floor(confidence * n), the first at least, among the n rows of class 1; None without any."""
    known = df.where(F.col(target) == 1).select(norm(columns).alias("norm"))
    count = known.count()
    share = (max(1, int(confidence * count)) - 0.5) / max(1, count - 1)  # half way to the next place
    return quantiles.exact(known, ["norm"], [min(1.0, share)], interpolate=False)["norm"][0]


def norm_distance(df: DataFrame, columns: list[str], target: str, confidence: float = 0.05) -> DataFrame:
    """One row (threshold, below): the norm at place floor(confidence * n) among class 1's, and class 0's share below it."""
    normed = df.withColumn("norm", norm(columns))
    limit = F.lit(norm_limit(df, columns, target, confidence)).cast("double")
    return normed.where(F.col(target) == 0).agg(F.first(limit).alias("threshold"), F.round(F.avg((F.col("norm") < limit).cast("int")), 6).alias("below"))


def stump(df: DataFrame, columns: list[str], target: str) -> DataFrame:
    """(feature, threshold, gain): the best split x <= t of each column by Gini gain, from counts by value."""
    long = df.select(F.col(target).alias("y"), F.explode(F.array(*(F.struct(F.lit(c).alias("feature"), F.col(c).cast("double").alias("x")) for c in columns))).alias("p")).select("y", "p.*")
    counts = long.groupBy("feature", "x").agg(F.count("*").alias("n"), F.sum("y").alias("k"))
    whole = counts.groupBy("feature").agg(F.sum("n").alias("an"), F.sum("k").alias("ak"))
    cum = quantiles.running(counts, ["feature"], "x", {"ln": "n", "lk": "k"}).join(F.broadcast(whole), "feature").where("ln < an")  # a row for each feature
    gini = lambda k, n: 2 * (k / n) * (1 - k / n)
    rn, rk = F.col("an") - F.col("ln"), F.col("ak") - F.col("lk")
    gain = gini(F.col("ak"), F.col("an")) - F.col("ln") / F.col("an") * gini(F.col("lk"), F.col("ln")) - rn / F.col("an") * gini(rk, rn)
    best = cum.withColumn("gain", F.round(gain, 6)).groupBy("feature").agg(F.max(F.struct("gain", (-F.col("x")).alias("x"))).alias("b"))
    return best.select("feature", (-F.col("b.x")).alias("threshold"), F.col("b.gain").alias("gain"))


def topk_feature(blobs: DataFrame, size: int = 512, k: int = 16, key: str = "doc_id") -> DataFrame:
    return topk_part_entropy(blobs, size, k, key)
