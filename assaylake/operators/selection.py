"""Relevance and selection of features."""

from __future__ import annotations

from multiprocessing.pool import ThreadPool

import numpy as np
import pandas as pd
from pyspark import TaskContext, inheritable_thread_target
from pyspark.ml.classification import RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from assaylake.operators import quantiles
from assaylake.operators.metrics import binary_metrics
from assaylake.sources.scratch import cut, written


def variances(df: DataFrame, columns: list[str]) -> DataFrame:
    """(feature, variance): population variances, in one pass."""
    row = df.agg(*(F.round(F.var_pop(c), 6).alias(c) for c in columns))
    return row.select(F.explode(F.array(*(F.struct(F.lit(c).alias("feature"), F.col(c).alias("variance")) for c in columns))).alias("p")).select("p.*")


def variance_filter(df: DataFrame, columns: list[str], threshold: float) -> DataFrame:
    return variances(df, columns).withColumn("kept", F.col("variance") > threshold)


def _bins(df: DataFrame, columns: list[str], bins: int) -> DataFrame:
    """df with __bin_c for each column c: its bin among `bins` of about equal numbers of rows, cut at exact quantiles."""
    cuts = quantiles.exact(df, columns, [i / bins for i in range(1, bins)])
    for c in columns:
        df = quantiles.placed(df, c, sorted({x for x in cuts[c] if x is not None}), f"__bin_{c}")
    return df


def binned(df: DataFrame, columns: list[str], label: str, bins: int = 10, extra: list[str] | None = None) -> DataFrame:
    """(feature, bin, label, extra...): quantile bins of each column, one row for each feature and row."""
    cells = F.array(*(F.struct(F.lit(c).alias("feature"), F.col(f"__bin_{c}").alias("bin")) for c in columns))
    return _bins(df, columns, bins).select(F.col(label).alias("label"), *(extra or []), F.explode(cells).alias("p")).select("label", *(extra or []), "p.*")


def mutual_information(df: DataFrame, columns: list[str], label: str, bins: int = 10, by: str | None = None) -> DataFrame:
    """(by, feature, mi): binned mutual information in nats of each feature and the label."""
    keys = ([by] if by else []) + ["feature"]
    joint = binned(df, columns, label, bins, [by] if by else None).groupBy(*keys, "bin", "label").agg(F.count("*").alias("n"))
    sums = joint.withColumns({"all": F.sum("n").over(Window.partitionBy(*keys)), "x": F.sum("n").over(Window.partitionBy(*keys, "bin")), "y": F.sum("n").over(Window.partitionBy(*keys, "label"))})
    return sums.groupBy(*keys).agg(F.round(F.sum(F.col("n") / F.col("all") * F.log(F.col("n") * F.col("all") / (F.col("x") * F.col("y")))), 6).alias("mi"))


def best(mi: DataFrame, k: float) -> DataFrame:
    """The k features (or the share k < 1 of them) of the highest mutual information, ranked."""
    ranked = mi.withColumns({"rank": F.row_number().over(Window.orderBy(F.col("mi").desc(), "feature")), "__n": F.count("*").over(Window.partitionBy())})
    most = F.lit(k) if k >= 1 else F.ceil(F.col("__n") * k)
    return ranked.where(F.col("rank") <= most).drop("__n")


def pairwise_mi(df: DataFrame, columns: list[str], bins: int = 10) -> dict[tuple[str, str], float]:
    """Binned mutual information of each pair of columns: k * k numbers, all counted in one job."""
    pairs = [(a, b) for i, a in enumerate(columns) for b in columns[i + 1 :]]
    long = _bins(df, columns, bins).select(F.explode(F.array(*(F.struct(F.lit(a).alias("a"), F.lit(b).alias("b"), F.col(f"__bin_{a}").alias("x"), F.col(f"__bin_{b}").alias("y")) for a, b in pairs))).alias("p")).select("p.*")
    joint = long.groupBy("a", "b", "x", "y").agg(F.count("*").alias("n"))
    w = Window.partitionBy("a", "b")
    sums = joint.withColumns({"all": F.sum("n").over(w), "nx": F.sum("n").over(Window.partitionBy("a", "b", "x")), "ny": F.sum("n").over(Window.partitionBy("a", "b", "y"))})
    rows = sums.groupBy("a", "b").agg(F.sum(F.col("n") / F.col("all") * F.log(F.col("n") * F.col("all") / (F.col("nx") * F.col("ny")))).alias("mi")).collect()
    return {k: r["mi"] for r in rows for k in ((r["a"], r["b"]), (r["b"], r["a"]))}


def by_chance(n: int, bins: int = 10) -> float:
    """More than the mutual information of two independent columns in n rows: 2 n times it is distributed as chi squared; three deviations over its mean."""
    free = (bins - 1) ** 2
    return (free + 3 * (2 * free) ** 0.5) / (2 * max(1, n))


def mrmr(df: DataFrame, columns: list[str], label: str, k: int, bins: int = 10, over: float | None = None) -> DataFrame:
    """(feature, rank, score): greedy choice of the highest relevance less mean redundancy; the greedy part sees k * k numbers.

    over: after the first one, only features of a greater score are chosen.
    """
    relevance = {r["feature"]: r["mi"] for r in mutual_information(df, columns, label, bins).collect()}
    shared = pairwise_mi(df, columns, bins)
    chosen: list[tuple[str, int, float]] = []
    rest = sorted(columns)
    while rest and len(chosen) < k:
        value = {c: relevance[c] - (sum(shared[c, o] for o, *_ in chosen) / len(chosen) if chosen else 0.0) for c in rest}
        top = max(rest, key=lambda c: (value[c], c))
        if over is not None and chosen and value[top] <= over:
            break
        chosen.append((top, len(chosen) + 1, round(float(value[top]), 6)))
        rest.remove(top)
    return df.sparkSession.createDataFrame(chosen, "feature string, rank int, score double")


def forest_importances(df: DataFrame, columns: list[str], label: str, trees: int = 20, seed: int = 42) -> dict[str, float]:
    vec = VectorAssembler(inputCols=columns, outputCol="features", handleInvalid="skip").transform(df)
    model = RandomForestClassifier(labelCol=label, numTrees=trees, maxDepth=5, seed=seed).fit(vec)
    return dict(zip(columns, model.featureImportances.toArray().tolist(), strict=True))


def folded(df: DataFrame, folds: int, seed: int = 42, key: str = "hash") -> DataFrame:
    """df with __fold, drawn by a hash of the key."""
    return df.withColumn("__fold", F.pmod(F.xxhash64(key, F.lit(seed)), F.lit(folds)))


def cross_validated(df: DataFrame, columns: list[str], label: str, folds: int, trees: int = 10) -> float:
    """Mean Matthews correlation of a forest over the folds, each predicted by a forest that was fitted on the others."""
    scores = []
    vec = VectorAssembler(inputCols=columns, outputCol="features", handleInvalid="skip").transform(df).select("features", F.col(label).cast("int").alias("y"), "__fold")
    for fold in range(folds):
        model = RandomForestClassifier(labelCol="y", numTrees=trees, maxDepth=5, seed=42).fit(vec.where(F.col("__fold") != fold))
        found = model.transform(vec.where(F.col("__fold") == fold))
        scores.append(binary_metrics(found.withColumn("p", F.col("prediction").cast("int")), "y", "p").first()["mcc"])
    return sum(scores) / len(scores)


#: Bins of a feature in cells; rows of a mean cell from which forests are grown on cells; trees that are grown at a time; parts of a table of cells.
BINS, DENSE, AT_ONCE, PARTS = 32, 8, 8, 2


def cells(df: DataFrame, columns: list[str], label: str) -> DataFrame:
    """(the columns, label, __fold, n): rows by their bins among BINS of each column, cut at exact quantiles; a column holds the number of its bin. Rows with nulls are left out, as forests skip them.

    Sorted, so that what is drawn for them is the same in each run.
    """
    binned_ = _bins(df.dropna(subset=[*columns, label]), columns, BINS).select(*(F.col(f"__bin_{c}").cast("double").alias(c) for c in columns), label, "__fold")
    keys = [*columns, label, "__fold"]
    return binned_.groupBy(*keys).agg(F.count("*").alias("n")).repartition(PARTS, *keys).sortWithinPartitions(*keys)


class CellForest:
    """A random forest on cells, as RandomForestClassifier grows one on their rows: a tree's bootstrap draws each row of a cell Poisson(1) times, so the cell's n rows Poisson(n) times in all.

    So a fit costs what the cells cost, whatever their rows. Trees are grown with RandomForestClassifier, one at a time, on the weights drawn for them.
    """

    def __init__(self, rows: DataFrame, columns: list[str], label: str, trees: int, seed: int = 42):
        names = [f"__w{t}" for t in range(trees)]
        kept = [f.name for f in rows.schema.fields]

        def draw(batches):
            rng = np.random.default_rng([seed, TaskContext.get().partitionId()])
            for batch in batches:
                drawn = rng.poisson(batch["n"].to_numpy()[:, None], (len(batch), trees)).astype(float)
                yield pd.concat([batch, pd.DataFrame(drawn, columns=names, index=batch.index)], axis=1)

        kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields)
        drawn = written(rows.mapInPandas(draw, f"{kinds}, " + ", ".join(f"{n} double" for n in names)), "drawn")
        self.vec = VectorAssembler(inputCols=columns, outputCol="features")
        drawn = self.vec.transform(drawn.select(*kept, *names))

        def grow(t: int):
            one = RandomForestClassifier(labelCol=label, numTrees=1, maxDepth=5, seed=seed + t, bootstrap=False, featureSubsetStrategy="sqrt", weightCol=names[t])
            return one.fit(drawn.where(F.col(names[t]) > 0).select("features", label, names[t]))

        with ThreadPool(AT_ONCE) as pool:
            self.models = pool.map(inheritable_thread_target(rows.sparkSession)(grow), range(trees))

    def importances(self) -> list[float]:
        told = np.sum([m.featureImportances.toArray() for m in self.models], axis=0)
        return (told / (told.sum() or 1.0)).tolist()

    def predict(self, rows: DataFrame) -> DataFrame:
        """rows with p, the class of the greater mean probability of the trees."""
        out, kept = self.vec.transform(rows), rows.columns
        votes = []
        for t, m in enumerate(self.models):
            out = m.transform(out).withColumn(f"__p{t}", vector_to_array("probability")).select(*kept, "features", *votes, f"__p{t}")
            votes.append(f"__p{t}")
        against, in_favour = (sum(F.get(F.col(v), k) for v in votes) for k in (F.lit(0), F.lit(1)))
        return out.select(*kept, F.when(F.coalesce(in_favour, F.lit(0.0)) > against, 1).otherwise(0).alias("p"))


def _dense(df: DataFrame, columns: list[str], label: str) -> DataFrame | None:
    """The written cells of df, which has __fold, where they hold DENSE rows or more in the mean; else None."""
    found = written(cells(df, columns, label), "cells")
    told = found.agg(F.count("*").alias("cells"), F.sum("n").alias("rows")).first()
    return found if told["cells"] and told["rows"] >= DENSE * told["cells"] else None


def _merged(rows: DataFrame, columns: list[str], label: str, *more: str) -> DataFrame:
    keys = [*columns, label, *more]
    return written(rows.groupBy(*keys).agg(F.sum("n").alias("n")).repartition(PARTS, *keys).sortWithinPartitions(*keys), "merged-cells")


def _cell_importances(dense: DataFrame, columns: list[str], label: str, trees: int = 20) -> dict[str, float]:
    """As forest_importances(), on cells."""
    return dict(zip(columns, CellForest(_merged(dense, columns, label), columns, label, trees).importances(), strict=True))


def _validated(dense: DataFrame, columns: list[str], label: str, folds: int, trees: int = 10) -> float:
    """As cross_validated(), on cells."""
    scores = []
    dense = _merged(dense, columns, label, "__fold")
    for fold in range(folds):
        forest = CellForest(_merged(dense.where(F.col("__fold") != fold), columns, label), columns, label, trees)
        found = forest.predict(dense.where(F.col("__fold") == fold))
        scores.append(binary_metrics(found, label, "p", weight="n").first()["mcc"])
    return sum(scores) / len(scores)


def rfecv(df: DataFrame, columns: list[str], label: str, least: int = 1, folds: int = 3, key: str = "hash") -> DataFrame:
    """(feature, rank, score): recursive elimination with cross-validation for a 0/1 label.

    The least important feature of a forest goes at each step, down to `least`; the set of the best mean score over the folds wins, the
    smaller one of equals. Its features have rank 1, those eliminated later than others the lower ranks; score is the mean score of the
    set that a feature was last in. Where many rows share the cells of the features' bins, forests are grown on the cells: see CellForest.
    """
    df = cut(folded(df.select(key, *columns, label), folds, key=key))
    return _eliminated(df, _dense(df, columns, label), columns, label, least, folds)


def _eliminated(df: DataFrame, dense: DataFrame | None, columns: list[str], label: str, least: int = 1, folds: int = 3) -> DataFrame:
    """As rfecv(), of computed rows with __fold, and their cells if those are dense."""
    left, gone, scores = list(columns), [], {}
    while True:
        scores[len(left)] = round(cross_validated(df, left, label, folds) if dense is None else _validated(dense, left, label, folds), 6)
        if len(left) <= max(1, least):
            break
        weights = forest_importances(df, left, label) if dense is None else _cell_importances(dense, left, label)
        worst = min(left, key=lambda c: (weights[c], c))
        gone.append(worst)
        left.remove(worst)
    size = max(scores, key=lambda k: (scores[k], -k))
    inside = {c: len(columns) - i for i, c in enumerate(gone)} | dict.fromkeys(left, len(left))  # the size of the last set that holds the feature
    rows = [(c, max(1, k - size + 1), scores[k]) for c, k in inside.items()]
    rows = [(c, 1, scores[size]) if k <= size else (c, r, s) for (c, r, s), k in zip(rows, inside.values(), strict=True)]
    return df.sparkSession.createDataFrame(rows, "feature string, rank int, score double")


def filter_pipeline(df: DataFrame, columns: list[str], label: str, threshold: float, k: int, chosen: int | None = None) -> DataFrame:
    """(feature, mi, importance, rank): variance filter, the k best by mutual information, the `chosen` best of those by relevance less redundancy (without a number:
    all but those that share more with the ones chosen before than with the label, beyond chance), the set that elimination with cross-validation keeps, ranked by forest importance."""
    kept = [r["feature"] for r in variance_filter(df, columns, threshold).where("kept").collect()]
    ranked = written(best(mutual_information(df, kept, label), k), "ranked")
    names = [r["feature"] for r in ranked.orderBy("rank").collect()]
    names = [r["feature"] for r in mrmr(df, names, label, chosen or len(names), over=None if chosen else -by_chance(df.count())).orderBy("rank").collect()]
    rows = cut(folded(df.select("hash", *names, label), 3))
    dense = _dense(rows, names, label)
    names = [r["feature"] for r in _eliminated(rows, dense, names, label).where("rank = 1").orderBy("feature").collect()]
    weights = forest_importances(df, names, label) if dense is None else _cell_importances(dense, names, label)
    table = df.sparkSession.createDataFrame([(n, round(float(w), 6)) for n, w in weights.items()], "feature string, importance double")
    return ranked.select("feature", "mi").join(table, "feature").withColumn("rank", F.row_number().over(Window.orderBy(F.col("importance").desc(), "feature")))


def compared(df: DataFrame, columns: list[str], label: str, dataset: str, reference: str, groups: dict[str, str]) -> DataFrame:
    """(dataset, grp, mi, diff): mutual information by dataset, features grouped by the first regex that fits, and its distance from the reference dataset."""
    mi = mutual_information(df, columns, label, by=dataset)
    named = F.coalesce(*(F.when(F.col("feature").rlike(p), g) for p, g in groups.items()), F.col("feature"))
    grouped = mi.groupBy(F.col(dataset).alias("dataset"), named.alias("grp")).agg(F.avg("mi").alias("mi"))
    ref = grouped.where(F.col("dataset") == reference).select("grp", F.col("mi").alias("ref"))
    return grouped.join(ref, "grp").select("dataset", "grp", F.round(F.col("mi") + 1e-9, 6).alias("mi"), F.round(F.abs(F.col("mi") - F.col("ref")) + 1e-9, 6).alias("diff"))


def mean_differences(a: DataFrame, reference: DataFrame, key: str, columns: list[str], groups: dict[str, str] | None = None, top: int | None = None) -> DataFrame:
    """(feature, diff, standardised): mean difference of each column from the reference's, raw and over the reference's spread.

    groups: columns that a regex fits are one feature, with the means of their numbers; the first regex that fits counts. top: only the features of
    the largest differences, standardised ones first.
    """
    ref = reference.select(key, *(F.col(c).alias(f"r_{c}") for c in columns))
    spread = reference.agg(*(F.stddev_pop(c).alias(f"s_{c}") for c in columns))
    row = a.join(ref, key).agg(*(F.avg(F.col(c) - F.col(f"r_{c}")).alias(c) for c in columns)).join(spread)  # one row each
    cells = row.select(F.explode(F.array(*(F.struct(F.lit(c).alias("feature"), F.col(c).alias("diff"), F.try_divide(F.col(c), F.col(f"s_{c}")).alias("standardised")) for c in columns))).alias("p")).select("p.*")
    if groups:
        named = F.coalesce(*(F.when(F.col("feature").rlike(p), g) for p, g in groups.items()), F.col("feature"))
        cells = cells.groupBy(named.alias("feature")).agg(F.avg("diff").alias("diff"), F.avg("standardised").alias("standardised"))
    if top is not None:
        cells = cells.orderBy(F.abs("standardised").desc_nulls_last(), F.abs("diff").desc(), "feature").limit(top)
    return cells.select("feature", F.round("diff", 6).alias("diff"), F.round("standardised", 6).alias("standardised"))
