"""Exact quantiles and running sums of columns of any size: no task sees more than a bounded part of the values."""

from __future__ import annotations

import math
from functools import reduce

import numpy as np
from pyspark.ml.feature import Bucketizer
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Accuracy of the sketches, and values of a segment that are counted one by one.
ACCURACY, FEW = 10_000, 20_000


def placed(df: DataFrame, column: str, cuts: list[float], name: str) -> DataFrame:
    """df with how many of the cuts, distinct and ascending, are at or below column (null for null)."""
    if not cuts:
        return df.withColumn(name, F.when(F.col(column).isNotNull(), 0))
    out = Bucketizer(splits=[-math.inf, *cuts, math.inf], inputCol=f"__{name}", outputCol=name, handleInvalid="keep").transform(df.withColumn(f"__{name}", F.col(column).cast("double")))
    return out.withColumn(name, F.when(F.col(column).isNotNull(), F.col(name).cast("int"))).drop(f"__{name}")


def exact(df: DataFrame, columns: list[str], shares: list[float], interpolate: bool = True) -> dict[str, list[float | None]]:
    """For each column its quantiles at the shares, by linear interpolation between neighbours (or the lower neighbour); None for a column without values.

    Three passes for all columns together: sketches give cuts about the values at the ranks wanted; counts by segment between the cuts say which segments hold the ranks; those
    few are counted value by value. Segments that hold many values are cut again, which takes two passes more.
    """
    step = 1 / ACCURACY
    points = sorted({min(1.0, max(0.0, p + k * step)) for p in shares for k in (-1.5, 1.5)})
    base = df.select(*(F.col(c).cast("double").alias(f"x{i}") for i, c in enumerate(columns)))
    first = base.agg(*(f for i in range(len(columns)) for f in (F.count(f"x{i}").alias(f"n{i}"), F.percentile_approx(f"x{i}", points, ACCURACY).alias(f"q{i}")))).first()
    count = [first[f"n{i}"] for i in range(len(columns))]
    live = [i for i, n in enumerate(count) if n]
    if not live:
        return {c: [None] * len(shares) for c in columns}
    ranks = {i: sorted({r for p in shares for r in (math.floor(p * (count[i] - 1)), math.ceil(p * (count[i] - 1)))}) for i in live}
    cuts = {i: _cut_at(first[f"q{i}"]) for i in live}
    while True:
        marked = base
        for i in live:
            marked = placed(marked, f"x{i}", cuts[i], f"s{i}")
        cells = F.array(*(F.struct(F.lit(i).alias("c"), F.col(f"s{i}").alias("segment"), F.col(f"x{i}").alias("x")) for i in live))
        long = marked.select(F.explode(cells).alias("r")).select("r.*").where("x is not null")
        told: dict[int, list] = {i: [] for i in live}
        for r in sorted(long.groupBy("c", "segment").agg(F.count("*").alias("n"), F.min("x").alias("low"), F.max("x").alias("high")).collect()):
            told[r["c"]].append(r)
        ends = {i: np.cumsum([r["n"] for r in told[i]]) for i in live}
        held = {i: {int(np.searchsorted(ends[i], r, "right")) for r in ranks[i]} for i in live}
        wide = [(i, told[i][k]) for i in live for k in sorted(held[i]) if told[i][k]["n"] > FEW and told[i][k]["low"] < told[i][k]["high"]]
        if not wide:
            break
        sketches = [F.percentile_approx(F.when(F.col(f"s{i}") == r["segment"], F.col(f"x{i}")), [k / 256 for k in range(1, 256)], ACCURACY) for i, r in wide]
        for (i, _), found in zip(wide, marked.agg(*sketches).first(), strict=True):
            cuts[i] = sorted({*cuts[i], *_cut_at(found)})
    wanted = {i: [told[i][k]["segment"] for k in held[i] if told[i][k]["low"] < told[i][k]["high"]] for i in live}
    some = [(F.col("c") == i) & F.col("segment").isin(segments) for i, segments in wanted.items() if segments]
    counts: dict[tuple[int, int], list] = {}
    if some:
        for r in sorted(long.where(reduce(lambda a, b: a | b, some)).groupBy("c", "segment", "x").count().collect()):  # FEW values of each segment at most
            counts.setdefault((r["c"], r["segment"]), []).append((r["x"], r["count"]))

    def value(i: int, rank: int) -> float:
        k = int(np.searchsorted(ends[i], rank, "right"))
        one = told[i][k]
        if one["low"] == one["high"]:
            return one["low"]
        listed = counts[i, one["segment"]]
        return listed[int(np.searchsorted(ends[i][k] - one["n"] + np.cumsum([m for _, m in listed]), rank, "right"))][0]

    out: dict[str, list[float | None]] = {}
    for i, c in enumerate(columns):
        out[c] = []
        for p in shares:
            if not count[i]:
                out[c].append(None)
                continue
            at = p * (count[i] - 1)
            low, high = value(i, math.floor(at)), value(i, math.ceil(at))
            out[c].append(low if low == high or not interpolate else (math.ceil(at) - at) * low + (at - math.floor(at)) * high)
    return out


def _cut_at(values: list[float]) -> list[float]:
    """Cuts before and after each value, so that a frequent value is a segment by itself."""
    return sorted({float(c) for v in values for c in (v, np.nextafter(v, math.inf))})


def ranges(df: DataFrame, value: str, by: list[str], parts: int = 256) -> DataFrame:
    """df with __range: the number of the range of about equal numbers of rows that value falls in, for each value of by."""
    cuts = df.groupBy(*by).agg(F.percentile_approx(value, [i / parts for i in range(1, parts)], ACCURACY).alias("__cuts"))
    cuts = cuts.select(*(F.col(c).alias(f"__{c}") for c in by), F.array_distinct("__cuts").alias("__cuts"))
    met = df.join(F.broadcast(cuts), [F.col(c).eqNullSafe(F.col(f"__{c}")) for c in by]) if by else df.join(F.broadcast(cuts))  # a row for each group, of 255 numbers at most
    return met.withColumn("__range", F.size(F.filter("__cuts", lambda b: b <= F.col(value)))).drop("__cuts", *(f"__{c}" for c in by))


def running(df: DataFrame, by: list[str], order: str, sums: dict[str, str]) -> DataFrame:
    """df, one row for each (by, order), with a running sum for each name: column of sums, the row's own included. Sums run within ranges of order, and then over the ranges."""
    parts = ranges(df, order, by)
    totals = parts.groupBy(*by, "__range").agg(*(F.sum(c).alias(f"__t_{n}") for n, c in sums.items()))
    over = Window.partitionBy(*by).orderBy("__range").rowsBetween(Window.unboundedPreceding, -1)
    totals = totals.select(*(F.col(c).alias(f"__g_{c}") for c in by), F.col("__range").alias("__r"), *(F.coalesce(F.sum(f"__t_{n}").over(over), F.lit(0)).alias(f"__b_{n}") for n in sums))
    inside = Window.partitionBy(*by, "__range").orderBy(order)
    same = [F.col("__range") == F.col("__r"), *(F.col(c).eqNullSafe(F.col(f"__g_{c}")) for c in by)]
    joined = parts.withColumns({n: F.sum(c).over(inside) for n, c in sums.items()}).join(totals, same)
    return joined.withColumns({n: F.col(n) + F.col(f"__b_{n}") for n in sums}).drop("__range", "__r", *(f"__g_{c}" for c in by), *(f"__b_{n}" for n in sums))
