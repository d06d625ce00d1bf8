"""Explanation and sensitivity of models given as expressions of the columns."""

from __future__ import annotations

import random
from collections.abc import Callable
from itertools import combinations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: A model: a column of probabilities from a column for each feature.
Model = Callable[[dict[str, Column]], Column]


def perturbed(value: Column, delta: float, up: bool, kind: str = "double", name: str = "", sigma: Column | None = None) -> Column:
    """value moved by delta of itself (integers by 1 at least, zero by delta), or by delta times sigma where that is given; booleans flip; shares stay in
    [0, 1] and sizes at 0 or more."""
    if kind == "boolean":
        return F.lit(1) - value.cast("int")
    step = F.abs(value) * delta if sigma is None else sigma * delta
    if sigma is None:
        step = F.greatest(F.lit(1.0), step) if kind in ("int", "bigint") else step
        step = F.when(value == 0, F.lit(delta)).otherwise(step)
    moved = value + step if up else value - step
    if name.endswith(("ratio", "share", "discount", "tax")):
        moved = F.greatest(F.lit(0.0), F.least(F.lit(1.0), moved))
    elif name.startswith(("n_", "size", "quantity", "price")):
        moved = F.greatest(F.lit(0.0), moved)
    return F.round(moved) if kind in ("int", "bigint") else moved


def _impacts(df: DataFrame, model: Model, columns: list[str], delta: float) -> DataFrame:
    """(class, feature, sign, impact) for each row, feature and sign: one pass, no join."""
    own = {c: F.col(c) for c in columns}
    base = model(own)
    cells = [F.struct(F.lit(c).alias("feature"), F.lit(s).alias("sign"), (model(own | {c: perturbed(F.col(c), delta, s > 0, "double", c)}) - base).alias("impact")) for c in columns for s in (-1, 1)]
    return df.select("*", (base >= 0.5).cast("int").alias("class"), F.explode(F.array(*cells)).alias("i")).select(*df.columns, "class", "i.*")


def fuzz(df: DataFrame, model: Model, columns: list[str], delta: float = 0.1) -> DataFrame:
    """(feature, class, down, up): mean change of the probability when a feature is moved down and up, by predicted class."""
    return _impacts(df, model, columns, delta).groupBy("feature", "class").agg(F.round(F.avg(F.when(F.col("sign") < 0, F.col("impact"))), 6).alias("down"), F.round(F.avg(F.when(F.col("sign") > 0, F.col("impact"))), 6).alias("up"))


def stability(df: DataFrame, model: Model, columns: list[str], deltas: tuple[float, ...] = (0.1, 0.25, 0.5, 1.0)) -> DataFrame:
    """(feature, delta, impact, rank): the largest mean change by delta, ranked."""
    out = None
    for delta in deltas:
        one = _impacts(df, model, columns, delta).groupBy("feature", "sign").agg(F.avg("impact").alias("i")).groupBy("feature").agg(F.round(F.max(F.abs("i")), 6).alias("impact")).withColumn("delta", F.lit(delta))
        out = one if out is None else out.unionByName(one)
    return out.withColumn("rank", F.row_number().over(Window.partitionBy("delta").orderBy(F.col("impact").desc(), "feature"))).select("feature", "delta", "impact", "rank")


def bootstrap(df: DataFrame, model: Model, columns: list[str], runs: int = 20, delta: float = 0.1, level: float = 0.95, key: str = "hash") -> DataFrame:
    """(feature, mean, low, high): mean change and its percentile interval over resamples; a row's weight in a run is Poisson(1), drawn by hash.

    The impacts are computed once for each row, and a row's run meets the sums of all features at once.
    """
    own = {c: F.col(c) for c in columns}
    base = model(own)
    names = [f"__i{n}" for n in range(len(columns))]
    rows = df.select(key, *((model(own | {c: perturbed(F.col(c), delta, True, "double", c)}) - base).alias(n) for n, c in zip(names, columns, strict=True)))
    steps = [0.367879, 0.735759, 0.919699, 0.981012, 0.99634]
    spread = rows.select("*", F.explode(F.sequence(F.lit(1), F.lit(runs))).alias("run"))
    spread = spread.withColumn("u", (F.pmod(F.xxhash64(key, "run"), F.lit(1_000_003)) + 0.5) / 1_000_003)
    spread = spread.withColumn("w", sum((F.col("u") > s).cast("int") for s in steps))
    means = spread.groupBy("run").agg(F.sum("w").alias("w"), *(F.sum(F.col("w") * F.col(n)).alias(n) for n in names))
    cells = F.array(*(F.struct(F.lit(c).alias("feature"), (F.col(n) / F.col("w")).alias("m")) for n, c in zip(names, columns, strict=True)))
    means = means.select(F.explode(cells).alias("c")).select("c.*")
    side = (1 - level) / 2
    return means.groupBy("feature").agg(F.round(F.avg("m"), 6).alias("mean"), F.round(F.percentile("m", side), 6).alias("low"), F.round(F.percentile("m", 1 - side), 6).alias("high"))


def interactions(df: DataFrame, model: Model, columns: list[str], delta: float = 0.1) -> DataFrame:
    """(a, b, interaction): the largest mean, over signs, of |joint change - the two single changes|."""
    own = {c: F.col(c) for c in columns}
    base = model(own)
    cells = []
    for a, b in combinations(sorted(columns), 2):
        for sa in (-1, 1):
            for sb in (-1, 1):
                pa, pb = perturbed(F.col(a), delta, sa > 0, "double", a), perturbed(F.col(b), delta, sb > 0, "double", b)
                value = F.abs((model(own | {a: pa, b: pb}) - base) - (model(own | {a: pa}) - base) - (model(own | {b: pb}) - base))
                cells.append(F.struct(F.lit(a).alias("a"), F.lit(b).alias("b"), F.lit(sa * 10 + sb).alias("s"), value.alias("v")))
    return df.select(F.explode(F.array(*cells)).alias("c")).select("c.*").groupBy("a", "b", "s").agg(F.avg("v").alias("v")).groupBy("a", "b").agg(F.round(F.max("v"), 6).alias("interaction"))


def no_impact_share(impacts: DataFrame, least: float = 0.01) -> DataFrame:
    top = impacts.groupBy("feature").agg(F.max(F.greatest(F.abs("down"), F.abs("up"))).alias("m"))
    return top.agg(F.round(F.avg((F.col("m") < least).cast("int")), 6).alias("no_impact"))


def importance_threshold(values: DataFrame) -> DataFrame:
    """(feature, importance, significant): mean absolute value by feature; significant at or over the mean plus deviation of all features."""
    mean = values.groupBy("feature").agg(F.avg(F.abs("value")).alias("importance"))
    w = Window.partitionBy()
    return mean.select("feature", F.round("importance", 6).alias("importance"), (F.col("importance") >= F.avg("importance").over(w) + F.stddev_pop("importance").over(w)).alias("significant"))


def category_profile(importance: DataFrame, categories: DataFrame, least: float = 0.02) -> DataFrame:
    """(category, share): importance by category, normalised; categories below least are 'Other'."""
    joined = importance.join(F.broadcast(categories), "feature", "left").groupBy(F.coalesce("category", F.lit("Other")).alias("category")).agg(F.sum("importance").alias("s"))
    share = joined.withColumn("share", F.col("s") / F.sum("s").over(Window.partitionBy()))
    return share.groupBy(F.when(F.col("share") < least, "Other").otherwise(F.col("category")).alias("category")).agg(F.round(F.sum("share"), 6).alias("share"))


def shapley(df: DataFrame, model: Model, columns: list[str], background: dict[str, float], permutations: int = 8, seed: int = 42, key: str = "hash") -> DataFrame:
    """(key, feature, value): sampled-permutation Shapley values against a background row; for each row they sum to its change from it."""
    rng = random.Random(seed)
    terms: dict[str, list[Column]] = {c: [] for c in columns}
    sets: dict[frozenset, Column] = {}  # what the model says of each set of known features that is met, once for a row

    def value(known: frozenset) -> Column:
        if known not in sets:
            sets[known] = model({c: F.col(c) if c in known else F.lit(background[c]) for c in columns}).alias(f"__m{len(sets)}")
        return F.col(f"__m{list(sets).index(known)}")

    for _ in range(permutations):
        known = frozenset()
        for c in rng.sample(columns, len(columns)):
            terms[c].append(value(known | {c}) - value(known))
            known |= {c}
    said = df.select(key, *sets.values()).select(key, *(F.round(sum(t) / permutations, 6).alias(c) for c, t in terms.items()))
    cells = [F.struct(F.lit(c).alias("feature"), F.col(c).alias("value")) for c in columns]
    return said.select(key, F.explode(F.array(*cells)).alias("s")).select(key, "s.*")
