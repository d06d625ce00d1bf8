"""Preprocessing of feature tables: scaling, encoding, imputing, splitting. Fitted values are aggregates joined back as one row."""

from __future__ import annotations

import math
from functools import reduce

from pyspark.ml.feature import PCA, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from assaylake.operators import quantiles
from assaylake.sources.scratch import written


def _fitted(df: DataFrame, **aggregates: Column) -> DataFrame:
    """df with one-row aggregates beside it."""
    return df.join(F.broadcast(df.agg(*(a.alias(n) for n, a in aggregates.items()))))  # one row


def rounded(x: Column) -> Column:
    """round(x, 6) of a double, to the same bit, without the decimal number that takes most of its time.

    Below 1e5 the product is off by less than 1e-4, so that away from the middle between two steps its nearest integer is certain, and an exact integer by an exact power
    of ten is the double nearest to their quotient. What is near the middle, larger, not finite or null is rounded by Spark.
    """
    steps = x * 1e6
    certain = (F.abs(x) < 1e5) & (F.abs(steps - F.floor(steps) - 0.5) > 1e-3)
    return F.when(certain, F.rint(steps) / 1e6 + 0.0).otherwise(F.round(x, 6))


def _scaled(df: DataFrame, columns: str | list[str], aggregates, value) -> DataFrame:
    """Each column replaced by value(column, its aggregates); all aggregates are one pass and one row beside df."""
    names = [columns] if isinstance(columns, str) else columns
    fitted = _fitted(df, **{f"__{n}_{c}": a for c in names for n, a in aggregates(c).items()})
    near = {c: rounded if kind == "double" else lambda x: F.round(x, 6) for c, kind in df.dtypes}
    return fitted.withColumns({c: near[c](value(F.col(c), {n: F.col(f"__{n}_{c}") for n in aggregates(c)})) for c in names}).select(*df.columns)


def maxabs_scale(df: DataFrame, c: str | list[str]) -> DataFrame:
    return _scaled(df, c, lambda x: {"m": F.max(F.abs(x))}, lambda x, a: F.try_divide(x, a["m"]))


def minmax_scale(df: DataFrame, c: str | list[str]) -> DataFrame:
    """(x - min) / (max - min); a constant column is 0."""
    return _scaled(df, c, lambda x: {"a": F.min(x), "b": F.max(x)}, lambda x, a: F.coalesce(F.try_divide(x - a["a"], a["b"] - a["a"]), F.lit(0.0)))


def standard_scale(df: DataFrame, c: str | list[str]) -> DataFrame:
    return _scaled(df, c, lambda x: {"m": F.avg(x), "s": F.stddev_pop(x)}, lambda x, a: F.try_divide(x - a["m"], a["s"]))


def robust_scale(df: DataFrame, c: str | list[str]) -> DataFrame:
    """(x - median) / (third quartile - first); null where the quartiles are equal."""
    names = [c] if isinstance(c, str) else c
    found = quantiles.exact(df, names, [0.25, 0.5, 0.75])
    return df.withColumns({n: F.round(F.try_divide(F.col(n) - F.lit(q[1]), F.lit(q[2]) - F.lit(q[0])), 6) for n, q in found.items()}).select(*df.columns)


def normalize_rows(df: DataFrame, columns: list[str]) -> DataFrame:
    norm = F.sqrt(sum(F.col(c) * F.col(c) for c in columns))
    return df.withColumn("__n", norm).withColumns({c: F.round(F.coalesce(F.try_divide(F.col(c), F.col("__n")), F.lit(0.0)), 6) for c in columns}).drop("__n")


def categories(df: DataFrame, c: str) -> DataFrame:
    """(value, code): values in sorted order from 0; one row for each category."""
    return df.select(F.col(c).alias("value")).where("value is not null").distinct().withColumn("code", F.row_number().over(Window.orderBy("value")) - 1)


def ordinal(df: DataFrame, c: str) -> DataFrame:
    return df.join(categories(df, c), df[c] == F.col("value"), "left").drop("value")


def onehot(df: DataFrame, c: str, values: list[str]) -> DataFrame:
    """0/1 columns for the values; of two the first is dropped; unknown ones are all 0."""
    used = values[1:] if len(values) == 2 else values
    return df.withColumns({f"{c}_{v}": F.coalesce((F.col(c) == v).cast("int"), F.lit(0)) for v in used})


def power_loglik(x: Column, lam: float, kind: str) -> tuple[Column, Column]:
    """(transformed value, log of its slope) of a power transform."""
    if kind == "boxcox":
        return (F.log(x) if abs(lam) < 1e-9 else (F.pow(x, F.lit(lam)) - 1) / lam), (lam - 1) * F.log(x)
    pos = F.log1p(x) if abs(lam) < 1e-9 else (F.pow(x + 1, F.lit(lam)) - 1) / lam
    neg = -F.log1p(-x) if abs(lam - 2) < 1e-9 else -(F.pow(1 - x, F.lit(2 - lam)) - 1) / (2 - lam)
    return F.when(x >= 0, pos).otherwise(neg), (lam - 1) * F.signum(x) * F.log1p(F.abs(x))


def power_transform(df: DataFrame, c: str, kind: str = "yeojohnson") -> DataFrame:
    """c transformed with the likeliest lambda of [-2, 2] in steps of 0.1, then standardised: all steps are one pass of aggregates."""
    grid = [round(-2 + 0.1 * i, 1) for i in range(41)]
    sums = []
    for i, lam in enumerate(grid):
        y, slope = power_loglik(F.col(c), lam, kind)
        sums.append((-F.count(y) / 2 * F.log(F.greatest(F.var_pop(y), F.lit(1e-300))) + F.sum(slope)).alias(f"l{i}"))
    row = df.agg(*sums).first()
    best = max(range(len(grid)), key=lambda i: -math.inf if row[i] is None else row[i])
    return standard_scale(df.withColumn(c, power_loglik(F.col(c), grid[best], kind)[0]), c)


def quantile_uniform(df: DataFrame, c: str, knots: int = 100) -> DataFrame:
    """c as its quantile rank in [0, 1]: exact quantiles at `knots` steps and linear interpolation between them."""
    q = quantiles.exact(df, [c], [i / knots for i in range(knots + 1)])[c]
    cuts = sorted({x for x in q if x is not None})
    # For each distinct knot the last place that it has, and the knot after it.
    last = [max(i for i, x in enumerate(q) if x == v) for v in cuts]
    told = F.array(*(F.struct(F.lit(float(v)).alias("low"), F.lit(float(q[min(knots, i + 1)])).alias("high"), F.lit(i).alias("at")) for v, i in zip(cuts, last, strict=True)))
    both = quantiles.placed(df, c, cuts, "__n").withColumn("__k", F.when(F.col("__n") > 0, F.try_element_at(told, F.col("__n"))))
    inside = F.coalesce(F.try_divide(F.col(c) - F.col("__k.low"), F.col("__k.high") - F.col("__k.low")), F.lit(0.0))
    rank = F.when(F.col("__n") == 0, 0.0).otherwise(F.least(F.lit(1.0), (F.col("__k.at") + inside) / knots))
    return both.withColumn(c, F.round(rank, 6)).drop("__n", "__k")


#: A rational approximation of the inverse normal distribution (relative error below 1.2e-9), for the middle and the tails.
MIDDLE = (-3.969683028665376e01, 2.209460984245205e02, -2.759285104469687e02, 1.383577518672690e02, -3.066479806614716e01, 2.506628277459239e00)
MIDDLE_BELOW = (-5.447609879822406e01, 1.615858368580409e02, -1.556989798598866e02, 6.680131188771972e01, -1.328068155288572e01, 1.0)
TAIL = (-7.784894002430293e-03, -3.223964580411365e-01, -2.400758277161838e00, -2.549732539343734e00, 4.374664141464968e00, 2.938163982698783e00)
TAIL_BELOW = (7.784695709041462e-03, 3.224671290700398e-01, 2.445134137142996e00, 3.754408661907416e00, 1.0)


def normal_quantile(p: Column) -> Column:
    """Inverse of the normal distribution, p held within 1e-7 and 1 - 1e-7."""
    poly = lambda parts, x: reduce(lambda a, b: a * x + b, parts[1:], F.lit(parts[0]))
    p = F.greatest(F.lit(1e-7), F.least(p, F.lit(1 - 1e-7)))
    tail = lambda q: poly(TAIL, t := F.sqrt(-2 * F.log(q))) / poly(TAIL_BELOW, t)
    q = p - 0.5
    return F.when(p < 0.02425, tail(p)).when(p > 1 - 0.02425, -tail(1 - p)).otherwise(q * poly(MIDDLE, q * q) / poly(MIDDLE_BELOW, q * q))


def impute(df: DataFrame, c: str | list[str], strategy: str = "mean", constant: float = 0.0) -> DataFrame:
    if strategy == "constant":
        return df.fillna(constant, [c] if isinstance(c, str) else c)
    return _scaled(df, c, lambda x: {"v": F.avg(x) if strategy == "mean" else F.mode(x)}, lambda x, a: F.coalesce(x, a["v"]))


def pca(df: DataFrame, columns: list[str], k: int = 2) -> DataFrame:
    """df with pc1..pck of the standardised columns; signs follow the largest loading. The standardised table is written once, as the fit goes through it several times."""
    scaled = written(standard_scale(df.withColumns({f"__{c}": F.col(c) for c in columns}), [f"__{c}" for c in columns]), "standardised")
    vec = VectorAssembler(inputCols=[f"__{c}" for c in columns], outputCol="__v", handleInvalid="skip").transform(scaled)
    model = PCA(k=k, inputCol="__v", outputCol="__p").fit(vec)
    signs = [1.0 if max(col, key=abs) >= 0 else -1.0 for col in model.pc.toArray().T.tolist()]
    out = model.transform(vec).withColumn("__a", vector_to_array("__p"))
    return out.select(*df.columns, *(rounded(F.col("__a")[i] * signs[i]).alias(f"pc{i + 1}") for i in range(k)))


def stratified_split(df: DataFrame, label: str = "label", share: float = 0.8, seed: int = 42) -> DataFrame:
    """df with train: the first `share` of each label's rows by md5(hash, seed).

    The place within a label is a running count over 256 ranges of the digest, so that a frequent label is no single task.
    """
    keyed = df.withColumn("__k", F.md5(F.concat(F.col("hash").cast("string"), F.lit(str(seed))))).withColumn("__b", F.substring("__k", 1, 2))
    sizes = keyed.groupBy(label, "__b").agg(F.count("*").alias("__n"))
    w = Window.partitionBy(label)
    before = sizes.select(label, "__b", (F.sum("__n").over(w.orderBy("__b")) - F.col("__n")).alias("__before"), F.sum("__n").over(w).alias("__all"))
    inside = F.row_number().over(Window.partitionBy(label, "__b").orderBy("__k", "hash"))
    return keyed.withColumn("__i", inside).join(F.broadcast(before), [label, "__b"]).withColumn("train", F.col("__before") + F.col("__i") <= F.round(share * F.col("__all"))).drop("__k", "__b", "__before", "__all", "__i")
