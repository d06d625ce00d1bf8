"""Evaluation of classifiers, clusterings and regressions from tables of counts."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from assaylake.operators import quantiles
from assaylake.sources.scratch import cut


def confusion_table(df: DataFrame, truth: str, predicted: str) -> DataFrame:
    return df.where(F.col(truth).isNotNull() & F.col(predicted).isNotNull()).groupBy(F.col(truth).cast("string").alias("t"), F.col(predicted).cast("string").alias("p")).agg(F.count("*").alias("n"))


def per_label(df: DataFrame, truth: str, predicted: str) -> DataFrame:
    """(label, tn, fp, fn, tp) of each label against the rest, from the table of counts."""
    c = confusion_table(df, truth, predicted)
    t, p = c.groupBy(F.col("t").alias("label")).agg(F.sum("n").alias("nt")), c.groupBy(F.col("p").alias("label")).agg(F.sum("n").alias("np"))
    hit = c.where("t = p").select(F.col("t").alias("label"), F.col("n").alias("tp"))
    both = t.join(p, "label", "full_outer").join(hit, "label", "left").fillna(0, ["nt", "np", "tp"]).withColumn("all", F.sum("nt").over(Window.partitionBy()))
    return both.select("label", (F.col("all") - F.col("nt") - F.col("np") + F.col("tp")).alias("tn"), (F.col("np") - F.col("tp")).alias("fp"), (F.col("nt") - F.col("tp")).alias("fn"), "tp")


def _ratio(a: Column, b: Column) -> Column:
    return F.coalesce(F.try_divide(a.cast("double"), b.cast("double")), F.lit(0.0))


def binary_metrics(df: DataFrame, truth: str, predicted: str, score: str | None = None, flip: bool = False, weight: str | None = None) -> DataFrame:
    """One row: accuracy, precision, recall, f, mcc of class 1; auc of the score, by ranks of its distinct values. weight: how many rows a row stands for (not for auc).

    flip: where the predictions go against the truth (mcc below 0), the truth's classes change places before all but the sign of the
    mcc is told, as for a clustering whose classes have no names.
    """
    t, p = F.col(truth), F.col(predicted)
    counted = F.count_if if weight is None else lambda met: F.coalesce(F.sum(F.when(met, F.col(weight))), F.lit(0))
    c = df.agg(counted((t == 1) & (p == 1)).alias("tp"), counted((t == 0) & (p == 0)).alias("tn"), counted((t == 0) & (p == 1)).alias("fp"), counted((t == 1) & (p == 0)).alias("fn"))
    against = F.lit(False)
    if flip:
        against = F.col("tp") * F.col("tn") < F.col("fp") * F.col("fn")
        turned = {"tp": "fp", "fp": "tp", "tn": "fn", "fn": "tn"}
        c = c.select(against.alias("__against"), *(F.when(against, F.col(o)).otherwise(F.col(n)).alias(n) for n, o in turned.items()))
        against = F.col("__against")
    tp, tn, fp, fn = (F.col(x).cast("double") for x in ("tp", "tn", "fp", "fn"))
    out = c.select(against.alias("__against"), F.round(_ratio(tp + tn, tp + tn + fp + fn), 6).alias("accuracy"), F.round(_ratio(tp, tp + fp), 6).alias("precision"), F.round(_ratio(tp, tp + fn), 6).alias("recall"), F.round(_ratio(2 * tp, 2 * tp + fp + fn), 6).alias("f"), F.round(_ratio(tp * tn - fp * fn, F.sqrt((tp + fp) * (tp + fn) * (tn + fp) * (tn + fn))), 6).alias("mcc"))
    if score is not None:
        out = out.join(auc(df, truth, score))  # one row each
        out = out.withColumn("auc", F.when(F.col("__against"), F.round(1 - F.col("auc"), 6)).otherwise(F.col("auc")))
    return out.drop("__against")


def auc(df: DataFrame, truth: str, score: str) -> DataFrame:
    """Area under the ROC curve: rank sum with half ranks for ties, over the table of distinct scores."""
    counts = df.groupBy(F.col(score).alias("s")).agg(F.sum(F.col(truth).cast("long")).alias("pos"), F.sum(1 - F.col(truth).cast("long")).alias("neg"))
    run = quantiles.running(counts, [], "s", {"upto": "neg"}).withColumn("below", F.col("upto") - F.col("neg"))
    return run.agg(F.round(_ratio(F.sum(F.col("pos") * (F.col("below") + F.col("neg") / 2)), F.sum("pos") * F.sum("neg")), 6).alias("auc"))


def weighted_metrics(df: DataFrame, truth: str, predicted: str) -> DataFrame:
    """One row: accuracy and the means of precision, recall and f over labels, weighted by their rows."""
    each = per_label(df, truth, predicted).withColumn("w", F.col("tp") + F.col("fn"))
    tp, fp, fn, w = (F.col(c) for c in ("tp", "fp", "fn", "w"))
    mean = lambda x, n: F.round(F.sum(x * w) / F.sum(w), 6).alias(n)
    return each.agg(F.round(F.sum(tp) / F.sum(w), 6).alias("accuracy"), mean(_ratio(tp, tp + fp), "precision"), mean(_ratio(tp, tp + fn), "recall"), mean(_ratio(2 * tp, 2 * tp + fp + fn), "f"))


def encode_labels(df: DataFrame, label: str = "label") -> DataFrame:
    """df with code: '?' -1, '-' 0, the families 1..k by name."""
    codes = df.select(F.col(label).alias("__l")).where(~F.col("__l").isin("?", "-")).distinct().withColumn("__c", F.row_number().over(Window.orderBy("__l")))
    return df.join(codes, F.col(label) == F.col("__l"), "left").withColumn("code", F.when(F.col(label) == "?", -1).when(F.col(label) == "-", 0).otherwise(F.col("__c"))).drop("__l", "__c")


def clustering_label_metrics(df: DataFrame, truth: str, cluster: str) -> DataFrame:
    """One row: Rand index, homogeneity, completeness, V measure, from the contingency table."""
    c = confusion_table(df, truth, cluster)
    w = c.withColumns({"a": F.sum("n").over(Window.partitionBy("t")), "b": F.sum("n").over(Window.partitionBy("p")), "all": F.sum("n").over(Window.partitionBy())})
    cell = w.agg(F.max("all").alias("n"), F.sum(F.col("n") * (F.col("n") - 1) / 2).alias("same"), F.sum(-F.col("n") / F.col("all") * F.log(F.col("n") / F.col("b"))).alias("h_tc"), F.sum(-F.col("n") / F.col("all") * F.log(F.col("n") / F.col("a"))).alias("h_ct"))
    side = lambda key, name: c.groupBy(key).agg(F.sum("n").alias("m")).withColumn("all", F.sum("m").over(Window.partitionBy())).agg(F.sum(F.col("m") * (F.col("m") - 1) / 2).alias(f"p_{name}"), F.sum(-F.col("m") / F.col("all") * F.log(F.col("m") / F.col("all"))).alias(f"h_{name}"))
    row = cell.join(side("t", "t")).join(side("p", "p"))  # one row each
    pairs = F.col("n") * (F.col("n") - 1) / 2
    hom, com = F.when(F.col("h_t") == 0, 1.0).otherwise(1 - F.col("h_tc") / F.col("h_t")), F.when(F.col("h_p") == 0, 1.0).otherwise(1 - F.col("h_ct") / F.col("h_p"))
    row = row.select(((pairs + 2 * F.col("same") - F.col("p_t") - F.col("p_p")) / pairs).alias("rand"), hom.alias("homogeneity"), com.alias("completeness"))
    return row.withColumn("v", _ratio(2 * F.col("homogeneity") * F.col("completeness"), F.col("homogeneity") + F.col("completeness"))).select(*(F.round(x, 6).alias(x) for x in ("rand", "homogeneity", "completeness", "v")))


def overlap_information(a: int, b: int, n: int) -> float:
    """What two classes of a and b of n members, dealt out by chance, add to the expected mutual information in nats.

    The sum goes over the possible overlaps, by their hypergeometric chances; overlaps of more than 12 deviations
    from the mean add nothing that a double holds, so a pair costs no more than some deviations of its overlap.
    """
    log_factorial = lambda x: np.array([math.lgamma(v + 1) for v in x])
    mean = a * b / n
    wide = 12 * math.sqrt(mean * (1 - a / n) * (1 - b / n) * n / max(1, n - 1)) + 20
    k = np.arange(max(1, a + b - n, int(mean - wide)), min(a, b, int(mean + wide) + 1) + 1, dtype=float)
    if not len(k):
        return 0.0
    chance = math.lgamma(a + 1) + math.lgamma(b + 1) + math.lgamma(n - a + 1) + math.lgamma(n - b + 1) - math.lgamma(n + 1) - log_factorial(k) - log_factorial(a - k) - log_factorial(b - k) - log_factorial(n - a - b + k)
    return float(np.sum(k / n * np.log(n * k / (a * b)) * np.exp(chance)))


def expected_information(rows: list[int], columns: list[int]) -> float:
    """Expected mutual information, in nats, of two partitions with these class sizes."""
    return sum(overlap_information(a, b, sum(rows)) for a in rows for b in columns)


def expected_by_chance(cells: DataFrame, n: int) -> float:
    """Expected mutual information, in nats, of two partitions of n members (cells: t, p, n) when members are dealt out by chance.

    Pairs of classes of equal sizes add the same, so pairs of sizes are summed, each counted as often as it comes: a partition has less than sqrt(2 n) different sizes.
    """

    def sizes(side: str, name: str) -> DataFrame:
        return cells.groupBy(side).agg(F.sum("n").alias(name)).groupBy(name).agg(F.count("*").alias(f"k{name}"))

    def terms(batches):
        for batch in batches:
            yield pd.DataFrame({"x": [times * overlap_information(a, b, n) for a, b, times in zip(batch["a"].tolist(), batch["b"].tolist(), batch["times"].tolist(), strict=True)]}, dtype=float)

    met = sizes("t", "a").join(sizes("p", "b"), F.lit(True)).select("a", "b", (F.col("ka") * F.col("kb")).alias("times"))
    return met.repartition("a", "b").mapInPandas(terms, "x double").agg(F.sum("x")).first()[0] or 0.0


def adjusted_information(df: DataFrame, truth: str, cluster: str) -> DataFrame:
    """One row: mutual information in nats, what chance would give, and the information adjusted for it (1: equal partitions, about 0: chance).

    Sizes and overlaps are summed by Spark; the driver sees a few sums.
    """
    cells = cut(confusion_table(df, truth, cluster))
    n = cells.agg(F.sum("n")).first()[0]
    if not n:
        return df.sparkSession.createDataFrame([(0.0, 0.0, 1.0)], "information double, expected double, adjusted double")
    sides = {side: cells.groupBy(side).agg(F.sum("n").alias(f"n_{side}")) for side in ("t", "p")}
    spread = lambda side: sides[side].agg(F.sum(-F.col(f"n_{side}") / n * F.log(F.col(f"n_{side}") / n)).alias("h"), F.count("*").alias("k")).first()
    (h_t, k_t), (h_p, k_p) = spread("t"), spread("p")
    met = cells.join(sides["t"], cells["t"].eqNullSafe(sides["t"]["t"])).join(sides["p"], cells["p"].eqNullSafe(sides["p"]["p"]))
    information = met.agg(F.sum(F.col("n") / n * F.log(F.lit(float(n)) * F.col("n") / (F.col("n_t") * F.col("n_p"))))).first()[0]
    expected = expected_by_chance(cells, n)
    room = (h_t + h_p) / 2 - expected
    adjusted = 1.0 if k_t == k_p <= 1 or k_t == k_p == n else (information - expected) / (room if abs(room) > 1e-15 else math.copysign(1e-15, room))
    return df.sparkSession.createDataFrame([(round(information, 6), round(expected, 6), round(adjusted, 6))], "information double, expected double, adjusted double")


def silhouette(df: DataFrame, columns: list[str], cluster: str) -> DataFrame:
    """One row: the mean silhouette by squared Euclidean distance.

    The mean squared distance of a row to a cluster follows from the cluster's size, mean and mean square, so rows meet a few numbers for each cluster and
    no other rows. A row alone in its cluster counts 0.
    """
    square = sum(F.col(x).cast("double") ** 2 for x in columns)
    stats = df.groupBy(F.col(cluster).alias("c")).agg(F.count("*").alias("n"), F.avg(square).alias("s"), F.array(*(F.avg(F.col(x).cast("double")) for x in columns)).alias("m"))
    listed = F.broadcast(stats.agg(F.collect_list(F.struct("c", "n", "s", "m")).alias("__all")))  # a row of some numbers for each cluster
    own, point = F.col(cluster), F.array(*(F.col(x).cast("double") for x in columns))
    away = lambda k: F.greatest(F.lit(0.0), square + k["s"] - 2 * F.aggregate(F.zip_with(point, k["m"], lambda a, b: a * b), F.lit(0.0), lambda a, b: a + b))
    met = df.join(listed).select(F.transform("__all", lambda k: F.struct((k["c"] == own).alias("own"), k["n"].alias("n"), away(k).alias("d"))).alias("k"))
    mine = F.filter("k", lambda k: k["own"])[0]
    other = F.array_min(F.transform(F.filter("k", lambda k: ~k["own"]), lambda k: k["d"]))
    placed = met.select(mine["n"].alias("n"), (mine["d"] * mine["n"] / F.greatest(mine["n"] - 1, F.lit(1))).alias("a"), other.alias("b"))
    return placed.agg(F.round(F.avg(F.when(F.col("n") == 1, 0.0).otherwise(F.coalesce(F.try_divide(F.col("b") - F.col("a"), F.greatest("a", "b")), F.lit(0.0)))), 6).alias("silhouette"))


def clustering_internal_metrics(df: DataFrame, columns: list[str], cluster: str) -> DataFrame:
    """One row: Calinski-Harabasz and Davies-Bouldin indices from the clusters' centroids, and the silhouette."""
    means = df.groupBy(F.col(cluster).alias("c")).agg(F.count("*").alias("n"), *(F.avg(x).alias(f"m_{x}") for x in columns))
    whole = df.agg(*(F.avg(x).alias(f"g_{x}") for x in columns))
    square = lambda a, b: sum((F.col(f"{a}_{x}" if a else x) - F.col(f"{b}_{x}")) ** 2 for x in columns)
    inside = df.join(F.broadcast(means), F.col(cluster) == F.col("c")).withColumn("d2", square("", "m")).groupBy("c").agg(F.sum("d2").alias("w"), F.avg(F.sqrt("d2")).alias("s"))
    table = means.join(inside, "c").join(F.broadcast(whole)).withColumn("b", F.col("n") * square("m", "g"))
    ch = table.agg(F.count("*").alias("k"), F.sum("n").alias("n"), F.sum("w").alias("w"), F.sum("b").alias("b")).select(F.round((F.col("b") / (F.col("k") - 1)) / (F.col("w") / (F.col("n") - F.col("k"))), 4).alias("calinski_harabasz"))
    other = table.select(F.col("c").alias("oc"), F.col("s").alias("os"), *(F.col(f"m_{x}").alias(f"o_{x}") for x in columns))
    worst = table.join(other, F.col("c") != F.col("oc")).withColumn("r", (F.col("s") + F.col("os")) / F.sqrt(square("m", "o"))).groupBy("c").agg(F.max("r").alias("r"))  # k * k rows
    return ch.join(worst.agg(F.round(F.avg("r"), 6).alias("davies_bouldin"))).join(silhouette(df, columns, cluster))


def regression_metrics(df: DataFrame, truth: str, predicted: str) -> DataFrame:
    e = F.col(truth) - F.col(predicted)
    return df.agg(F.round(F.avg(e * e), 6).alias("mse"), F.round(F.avg(F.abs(e)), 6).alias("mae"))


def shown(value: Column, kind: str = "percent") -> Column:
    """A metric as text: percent, milliseconds or number; -1 as '-'."""
    text = {"percent": F.format_string("%.2f%%", value * 100), "ms": F.format_string("%.3fms", value * 1000), "number": F.format_string("%.3f", value)}[kind]
    return F.when(value == -1, "-").otherwise(text)
