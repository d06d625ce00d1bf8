"""Searches of the settings of decision trees and random forests, and fits of trees on cells.

A tree of depth 12 holds those of lesser depth: each is what is left of it above that depth, as splits are chosen from the root down and a node keeps the counts of its classes; leaves side by
side that tell the same class are then made one, as Spark makes them. So does a forest hold those of fewer trees. (A split draws its features by chance in a forest, so that there the smaller one is one of the same distribution.) So for each fold one model of the greatest
depth and number of trees tells the accuracy of all smaller ones.

Where many rows share the cells of the features' bins, as trees bin them, fits go through the cells, weighted by their rows, so that they cost what the cells cost whatever the table.
"""

from __future__ import annotations

import math
import uuid
from collections.abc import Iterator
from itertools import product
from multiprocessing.pool import ThreadPool

import numpy as np
import pandas as pd
from pyspark import SparkContext, TaskContext, inheritable_thread_target
from pyspark.ml import Estimator, Model, Pipeline, PipelineModel
from pyspark.ml.classification import RandomForestClassificationModel, RandomForestClassifier
from pyspark.ml.feature import Bucketizer, MinMaxScaler, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from assaylake.operators import quantiles
from assaylake.operators.selection import AT_ONCE, DENSE, PARTS
from assaylake.sources.scratch import new_folder, written

#: Rows from which cells are tried, bins of a feature, models of folds that are fitted at a time.
MANY, BINS, SIDE = 200_000, 32, 4


def _scaled(columns: list[str]) -> list:
    return [VectorAssembler(inputCols=columns, outputCol="__raw", handleInvalid="skip"), MinMaxScaler(inputCol="__raw", outputCol="features")]


class Rows:
    """A table to be fitted row by row: features and label, and its fold."""

    def __init__(self, df: DataFrame, columns: list[str], label: str, folds: int):
        self.label, self.stages = label, Pipeline(stages=_scaled(columns)).fit(df).stages
        told = PipelineModel(self.stages).transform(df).select("features", label, F.floor(F.rand(42) * folds).cast("int").alias("__fold"))
        self.table = written(told, "folded")  # the folds are drawn once

    def fits(self, estimators: list[Estimator], fold: int | None) -> list[Model]:
        """The estimators fitted on all rows but those of the fold."""
        part = self.table if fold is None else self.table.where(F.col("__fold") != fold)
        return [e.fit(part) for e in estimators]

    def held(self, fold: int) -> DataFrame:
        """(features, label, weight) of the fold."""
        return self.table.where(F.col("__fold") == fold).select("features", self.label, F.lit(1.0).alias("weight"))


class Cells:
    """A table as its cells: a column's bins are its values where they are BINS at most, else cut at exact quantiles. A cell's rows are dealt to the folds by chance, each row to one."""

    def __init__(self, cells: DataFrame, bucketizer: Bucketizer, label: str, folds: int):
        self.label, names = label, bucketizer.getOutputCols()
        kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in cells.schema.fields)

        def deal(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            rng = np.random.default_rng([42, TaskContext.get().partitionId()])
            for batch in batches:
                dealt = rng.multinomial(batch["n"].to_numpy(), np.full(folds, 1 / folds)).astype(float)
                yield pd.concat([batch, pd.DataFrame(dealt, columns=[f"__f{i}" for i in range(folds)], index=batch.index)], axis=1)

        self.table = written(cells.mapInPandas(deal, ", ".join([kinds, *(f"__f{i} double" for i in range(folds))])), "dealt-cells") if folds else cells
        self.scaler = PipelineModel(Pipeline(stages=_scaled(names)).fit(cells).stages)
        self.stages = [bucketizer, *self.scaler.stages]
        self.classes = int(cells.agg(F.max(label)).first()[0]) + 1

    def _named(self) -> Column:
        """The label with its number of classes, which a draw may not show."""
        return F.col(self.label).cast("double").alias(self.label, metadata={"ml_attr": {"type": "nominal", "vals": [str(c) for c in range(self.classes)]}})

    def fits(self, estimators: list[Estimator], fold: int | None) -> list[Model]:
        """The estimators fitted on all rows but those of the fold. A tree of a forest is grown on its own bootstrap of the rows: Poisson(1) times each row, so Poisson(n) times a cell of n."""
        weight = F.col("n").cast("double") if fold is None else F.col("n") - F.col(f"__f{fold}")
        weighted = self.table.withColumn("__w", weight).where("__w > 0")
        trees = max((e.getNumTrees() for e in estimators if isinstance(e, RandomForestClassifier)), default=0)
        drawn = self._drawn(weighted, trees) if trees else None

        def grow(one: tuple[Estimator, DataFrame, str]) -> Model:
            return one[0].fit(self.scaler.transform(one[1].where(F.col(one[2]) > 0)).select("features", self._named(), one[2]))

        out = []
        for e in estimators:
            if isinstance(e, RandomForestClassifier):
                plans = [(e.copy({e.numTrees: 1, e.bootstrap: False, e.featureSubsetStrategy: "sqrt", e.seed: e.getSeed() + t, e.weightCol: f"__w{t}"}), drawn, f"__w{t}") for t in range(e.getNumTrees())]
                with ThreadPool(AT_ONCE) as pool:
                    out.append(_forest(pool.map(inheritable_thread_target(weighted.sparkSession)(grow), plans)))
            else:
                out.append(grow((e.copy({e.weightCol: "__w"}), weighted, "__w")))
        return out

    def _drawn(self, weighted: DataFrame, trees: int) -> DataFrame:
        names = [f"__w{t}" for t in range(trees)]
        kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in weighted.schema.fields)

        def draw(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            rng = np.random.default_rng([7, TaskContext.get().partitionId()])
            for batch in batches:
                drawn = rng.poisson(batch["__w"].to_numpy()[:, None], (len(batch), trees)).astype(float)
                yield pd.concat([batch, pd.DataFrame(drawn, columns=names, index=batch.index)], axis=1)

        return written(weighted.mapInPandas(draw, ", ".join([kinds, *(f"{n} double" for n in names)])), "drawn")

    def held(self, fold: int) -> DataFrame:
        """(features, label, weight) of the fold."""
        part = self.scaler.transform(self.table.where(F.col(f"__f{fold}") > 0))
        return part.select("features", self.label, F.col(f"__f{fold}").alias("weight"))


def _forest(models: list[RandomForestClassificationModel]) -> RandomForestClassificationModel:
    """Forests of one tree each as one forest."""
    first, context = models[0]._java_obj, SparkContext._active_spark_context
    classification = context._jvm.org.apache.spark.ml.classification
    trees = context._gateway.new_array(classification.DecisionTreeClassificationModel, len(models))
    for i, m in enumerate(models):
        trees[i] = m._java_obj.trees()[0]
    made = RandomForestClassificationModel(classification.RandomForestClassificationModel(f"forest_{uuid.uuid4().hex[:12]}", trees, first.numFeatures(), first.numClasses()))
    made = made._set(featuresCol=models[0].getFeaturesCol(), numTrees=len(models))
    made._transfer_params_to_java()
    return made


def dense(df: DataFrame, columns: list[str], label: str, folds: int = 0) -> Cells | None:
    """The cells of df where it has MANY rows or more and they hold DENSE of them or more in the mean; else None. Rows with a null or no number are left out, as fits skip them."""
    rows = df.select(*(F.col(c).cast("double").alias(c) for c in columns), label).dropna()
    first = rows.agg(F.count("*").alias("n"), *(F.approx_count_distinct(c).alias(f"d{i}") for i, c in enumerate(columns))).first()
    if first["n"] < MANY:
        return None
    few = [c for i, c in enumerate(columns) if first[f"d{i}"] <= 2 * BINS]
    values: dict[str, list[float]] = {c: [] for c in few}
    if few:
        pairs = rows.select(F.explode(F.array(*(F.struct(F.lit(c).alias("c"), F.col(c).alias("x")) for c in few))).alias("p")).select("p.*")
        for r in pairs.distinct().orderBy("c", "x").collect():  # about 2 * BINS of each
            values[r["c"]].append(r["x"])
    cuts = {c: [(a + b) / 2 for a, b in zip(v, v[1:], strict=False)] or v for c, v in values.items() if len(v) <= BINS}
    wide = [c for c in columns if c not in cuts]
    cuts |= {c: sorted(set(q)) for c, q in quantiles.exact(rows, wide, [i / BINS for i in range(1, BINS)]).items()} if wide else {}
    names = [f"__bin_{c}" for c in columns]
    bucketizer = Bucketizer(splitsArray=[[-math.inf, *cuts[c], math.inf] for c in columns], inputCols=columns, outputCols=names, handleInvalid="skip")
    keys = [*names, label]
    found = bucketizer.transform(rows).groupBy(*keys).agg(F.count("*").alias("n"))
    cells = written(found.repartition(PARTS, *keys).sortWithinPartitions(*keys), "cells")  # sorted, so that what is drawn for them is the same in each run
    return Cells(cells, bucketizer, label, folds) if first["n"] >= DENSE * cells.count() else None


class Grown:
    """The nodes of a model's trees as arrays: feature (-1 at a leaf), threshold, children, depth, shares of the classes; and the trees' first nodes."""

    def __init__(self, model: Model, spark):
        path = new_folder(spark, "trees")
        model.write().save(path)
        data = spark.read.parquet(f"{path}/data")
        if "treeID" not in data.columns:
            data = data.select(F.lit(0).alias("treeID"), F.struct(*data.columns).alias("nodeData"))
        told = data.select("treeID", "nodeData.id", "nodeData.impurityStats", "nodeData.leftChild", "nodeData.rightChild", "nodeData.split.featureIndex", F.get("nodeData.split.leftCategoriesOrThreshold", F.lit(0)).alias("threshold"))
        told = told.toPandas().sort_values(["treeID", "id"], ignore_index=True)  # a row for each node
        sizes = told.groupby("treeID").size().to_numpy()
        self.roots = np.cumsum(sizes) - sizes
        first = np.repeat(self.roots, sizes)
        self.feature = np.where(told["leftChild"] < 0, -1, told["featureIndex"])
        self.threshold = told["threshold"].fillna(0.0).to_numpy(float)
        self.left, self.right = (told[c].to_numpy(int) + first for c in ("leftChild", "rightChild"))
        self.depth, at = np.zeros(len(told), int), self.roots
        while len(at := at[self.feature[at] >= 0]):
            below = np.concatenate([self.left[at], self.right[at]])
            self.depth[below] = np.tile(self.depth[at] + 1, 2)
            at = below
        stats = np.stack(told["impurityStats"])
        self.shares = stats / np.maximum(stats.sum(1, keepdims=True), 1e-300)

    def _ends(self, depth: int) -> np.ndarray:
        """Where a row that is at a node would be in the trees of that depth: at the node, or at the one above it that is a leaf there."""
        inner, told = self.feature >= 0, np.argmax(self.shares, axis=1)
        inner &= self.depth < depth
        for level in range(depth - 1, -1, -1):  # leaves of one class are made one, from below
            at = np.flatnonzero(inner & (self.depth == level))
            left, right = self.left[at], self.right[at]
            same = ~inner[left] & ~inner[right] & (told[left] == told[right])
            inner[at[same]], told[at[same]] = False, told[left[same]]
        ends = np.arange(len(inner))
        for level in range(int(self.depth.max(initial=0))):
            at = np.flatnonzero((self.feature >= 0) & (self.depth == level))
            for children in (self.left[at], self.right[at]):
                ends[children] = np.where(inner[ends[at]], children, ends[at])
        return ends

    def correct(self, x: np.ndarray, y: np.ndarray, weight: np.ndarray, depths: list[int], trees: list[int]) -> np.ndarray:
        """(depths, trees): the weight of the rows that the model of that depth and number of trees tells right."""
        out, every = np.zeros((len(depths), len(trees))), np.arange(len(x))
        sums, ends = np.zeros((len(depths), len(x), self.shares.shape[1])), [self._ends(d) for d in depths]
        for t, root in enumerate(self.roots, 1):
            node = np.full(len(x), root)
            for _ in range(int(self.depth.max(initial=0))):
                f = self.feature[node]
                node = np.where(f < 0, node, np.where(x[every, f] <= self.threshold[node], self.left[node], self.right[node]))
            for i, end in enumerate(ends):
                sums[i] += self.shares[end[node]]
            if t in trees:
                out[:, trees.index(t)] = ((sums.argmax(2) == y) * weight).sum(1)
        return out


def accuracies(data: Rows | Cells, estimator: Estimator, grid: dict[str, list], folds: int) -> list[tuple[dict, float]]:
    """(setting, mean accuracy over the folds) of each setting of the grid, in its order."""
    spark = data.table.sparkSession
    nested = {"maxDepth": grid.get("maxDepth", [estimator.getMaxDepth()]), "numTrees": grid.get("numTrees", [estimator.getNumTrees()] if estimator.hasParam("numTrees") else [1])}
    others = {k: v for k, v in grid.items() if k not in nested}
    ways = [dict(zip(others, v, strict=True)) for v in product(*others.values())]
    depths, trees = sorted(nested["maxDepth"]), sorted(nested["numTrees"])
    most = {"maxDepth": depths[-1]} | ({"numTrees": trees[-1]} if estimator.hasParam("numTrees") else {})
    asked = [estimator.copy({estimator.getParam(k): v for k, v in (way | most).items()}) for way in ways]

    def tell(fold: int) -> np.ndarray:
        grown = [Grown(m, spark) for m in data.fits(asked, fold)]

        def score(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for batch in batches:
                if len(batch):
                    x, y, weight = np.stack(batch["x"]), batch["y"].to_numpy(), batch["weight"].to_numpy()
                    right = np.stack([g.correct(x, y, weight, depths, trees) for g in grown]).ravel()
                    yield pd.DataFrame({"place": np.arange(len(right) + 1), "n": [*right, weight.sum()]})

        held = data.held(fold).select(vector_to_array("features").alias("x"), F.col(data.label).cast("int").alias("y"), "weight")
        sums = np.zeros(len(ways) * len(depths) * len(trees) + 1)
        for r in held.mapInPandas(score, "place int, n double").groupBy("place").agg(F.sum("n").alias("n")).collect():
            sums[r["place"]] = r["n"]
        return sums[:-1].reshape(len(ways), len(depths), len(trees)) / max(sums[-1], 1e-300)

    if isinstance(data, Rows):
        with ThreadPool(SIDE) as pool:
            told = pool.map(inheritable_thread_target(spark)(tell), range(folds))
    else:
        told = [tell(i) for i in range(folds)]  # the trees of each are grown side by side
    mean = np.mean(told, axis=0)
    settings = [dict(zip(grid, v, strict=True)) for v in product(*grid.values())]
    where = lambda s, k, own: own.index(s[k]) if k in s else 0
    return [(s, float(mean[ways.index({k: s[k] for k in others}), where(s, "maxDepth", depths), where(s, "numTrees", trees)])) for s in settings]


def fitted(data: Rows | Cells, estimator: Estimator) -> PipelineModel:
    """The pipeline of what stands before it and the estimator fitted on all rows."""
    return PipelineModel([*data.stages, *data.fits([estimator], None)])


def searched(data: Rows | Cells, estimator: Estimator, grid: dict[str, list], folds: int) -> tuple[list[tuple[dict, float]], PipelineModel]:
    """(accuracies, the pipeline of the first setting of the best one fitted on all rows)."""
    told = accuracies(data, estimator, grid, folds)
    best = max(told, key=lambda x: x[1])[0]
    return told, fitted(data, estimator.copy({estimator.getParam(k): v for k, v in best.items()}))
