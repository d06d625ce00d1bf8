"""Exact Shapley values of trained tree ensembles and linear models.

A tree's value for a set of known features follows the known ones and takes the mean of both branches, weighted by the training rows that they hold, at the others. It is a sum over leaves
of products, one factor for each feature on the way: 1 or 0 where it is known (the row goes that way or not), else the share z of rows that do. So a leaf of value
v and d features adds v (o - z) sum_k k! (d - k - 1)! / d! e_k to a feature's Shapley value, with e_k the coefficients of the product of (z + o t) over the others. That is exact, and takes d^2
steps for a leaf where the sum over all subsets takes 2^d.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.ml import PipelineModel
from pyspark.ml.functions import vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


@dataclass
class Leaf:
    """A leaf's value (by the ensemble's weight), and for each feature on the way the share of rows that its splits let through and what it asks of a value."""

    value: float
    features: list[int]
    shares: list[float]
    low: list[float]  # the value is over it
    high: list[float]  # the value is at most it
    allowed: list[set | None]  # for categories: those that are let through


def _value(node, kind: int | None) -> float:
    if kind is None:
        return float(node.prediction())
    stats = list(node.impurityStats().stats())
    return stats[kind] / sum(stats)


def _leaves(root, kind: int | None, weight: float) -> Iterator[Leaf]:
    """kind: the class whose share is a leaf's value, None for its prediction."""
    open_ = [(root, {})]
    while open_:
        node, path = open_.pop()
        if node.subtreeDepth() == 0:
            names = sorted(path)
            yield Leaf(weight * _value(node, kind), names, *([path[f][n] for f in names] for n in range(4)))
            continue
        split, cover = node.split(), node.impurityStats().count()
        f = split.featureIndex()
        share, low, high, allowed = path.get(f, (1.0, -math.inf, math.inf, None))
        for child, left in ((node.leftChild(), True), (node.rightChild(), False)):
            part = share * child.impurityStats().count() / cover
            if split.getClass().getSimpleName() == "ContinuousSplit":
                t = split.threshold()
                told = (part, low, min(high, t), allowed) if left else (part, max(low, t), high, allowed)
            else:
                some = set(split.leftCategories() if left else split.rightCategories())
                told = (part, low, high, some if allowed is None else allowed & some)
            open_.append((child, {**path, f: told}))


def tree_leaves(model, kind: int = 1) -> list[Leaf]:
    """The leaves of a decision tree, a random forest (shares of class `kind`) or boosted trees (their weighted sum, which the sign decides on)."""
    java = model._java_obj
    if hasattr(model, "trees"):
        trees, weights = list(java.trees()), list(model.treeWeights)
        boosted = type(model).__name__.startswith("GBT") or "Regress" in type(model).__name__
        total = 1.0 if type(model).__name__.startswith("GBT") else sum(weights)
        return [leaf for tree, w in zip(trees, weights, strict=True) for leaf in _leaves(tree.rootNode(), None if boosted else kind, w / total)]
    return list(_leaves(java.rootNode(), None if "Regress" in type(model).__name__ else kind, 1.0))


def _added(leaf: Leaf, known: np.ndarray) -> np.ndarray:
    """(features of the leaf, rows): what the leaf adds to its features' Shapley values, known telling for each of them whether a row goes that way."""
    d = len(leaf.features)
    weights = np.array([math.factorial(k) * math.factorial(d - k - 1) / math.factorial(d) for k in range(d)])
    out = np.empty(known.shape)
    for n in range(d):
        product = np.zeros(known.shape)
        product[0] = 1
        for m in range(d):
            if m != n:
                product[1:] = product[1:] * leaf.shares[m] + product[:-1] * known[m]
                product[0] *= leaf.shares[m]
        out[n] = leaf.value * (known[n] - leaf.shares[n]) * (weights @ product)
    return out


def values(leaves: list[Leaf], rows: np.ndarray) -> tuple[float, np.ndarray]:
    """(the value without any known feature, (rows, features) Shapley values)."""
    out, base = np.zeros(rows.shape), 0.0
    for leaf in leaves:
        d = len(leaf.features)
        base += leaf.value * math.prod(leaf.shares)
        if not d or leaf.value == 0:
            continue
        known = np.empty((d, len(rows)), bool)
        for n, f in enumerate(leaf.features):
            inside = (rows[:, f] > leaf.low[n]) & (rows[:, f] <= leaf.high[n])
            known[n] = inside if leaf.allowed[n] is None else inside & np.isin(rows[:, f], list(leaf.allowed[n]))
        if 1 << d < len(rows):  # rows that go the same ways share what is added
            ways = np.arange(1 << d)
            told = _added(leaf, (ways[None, :] >> np.arange(d)[:, None] & 1).astype(float))
            out[:, leaf.features] += told.T[(known * (1 << np.arange(d))[:, None]).sum(0)]
        else:
            out[:, leaf.features] += _added(leaf, known.astype(float)).T
    return base, out


class Explained:
    """Shapley values of rows, each cell of the leaves' bounds computed once as long as the cells met are few: rows of one cell go the same ways at all splits."""

    def __init__(self, leaves: list[Leaf], features: int, most: int = 1 << 18):
        self.leaves, self.most, self.width = leaves, most, features
        self.cuts = [np.array(sorted({x for leaf in leaves for n, f in enumerate(leaf.features) if f == k for x in (leaf.low[n], leaf.high[n]) if math.isfinite(x)})) for k in range(features)]
        plain = all(allowed is None for leaf in leaves for allowed in leaf.allowed)
        self.numbered = plain and math.prod(len(c) + 1 for c in self.cuts) < 1 << 62
        self.cells, self.found, self.base = np.empty(0, np.int64), np.empty((0, features)), sum(leaf.value * math.prod(leaf.shares) for leaf in leaves)

    def __call__(self, rows: np.ndarray) -> np.ndarray:
        if not self.numbered or np.isnan(rows).any():
            return values(self.leaves, rows)[1]
        number = np.zeros(len(rows), np.int64)
        for k, cuts in enumerate(self.cuts):  # a value at a bound is below it, as it is for the leaves
            number = number * (len(cuts) + 1) + np.searchsorted(cuts, rows[:, k], "left")
        cells, first, of = np.unique(number, return_index=True, return_inverse=True)
        new = ~np.isin(cells, self.cells, assume_unique=True)
        if len(self.cells) + new.sum() > self.most:
            self.cells, self.found, new = self.cells[:0], self.found[:0], np.ones(len(cells), bool)
        if new.any():
            every = np.concatenate([self.cells, cells[new]])
            order = np.argsort(every)
            self.cells, self.found = every[order], np.concatenate([self.found, values(self.leaves, rows[first[new]])[1]])[order]
        return self.found[np.searchsorted(self.cells, cells)][of]


def tree_values(model: PipelineModel, df: DataFrame, columns: list[str], key: str = "hash", kind: int = 1) -> DataFrame:
    """(key, feature, value, base): what each feature adds, beside the base, to what the pipeline's trees say of a row; values and base sum up to that.

    For boosted trees that is the sum whose sign decides, else the share of class `kind`. The leaves are sent to every task (their number is the model's, whatever the table); no shuffle. Rows that the pipeline skips have none.
    """
    leaves = df.sparkSession.sparkContext.broadcast(tree_leaves(model.stages[-1], kind))
    rows = model.transform(df).select(F.col(key).alias("key"), vector_to_array("features").alias("v"))

    def explain(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        told = Explained(leaves.value, len(columns))
        for batch in batches:
            if len(batch):
                found = told(np.stack(batch["v"]))  # a column for each feature: an array for each row would be built one by one
                yield pd.DataFrame({"key": batch["key"], **{f"v{n}": found[:, n] for n in range(len(columns))}, "base": told.base})

    kind_of = rows.schema["key"].dataType.simpleString()
    parts = [f"v{n}" for n in range(len(columns))]
    found = rows.mapInPandas(explain, ", ".join([f"key {kind_of}", *(f"{p} double" for p in parts), "base double"]))
    return _listed(found.select("key", F.array(*parts).alias("values"), "base"), columns, key)


def linear_values(model: PipelineModel, df: DataFrame, columns: list[str], background: DataFrame | None = None, key: str = "hash") -> DataFrame:
    """As tree_values, of the margin of a binary linear model: its weight times the distance of the scaled feature from its mean over background (the rows themselves without one)."""
    last = model.stages[-1]
    weights, intercept = [float(w) for w in last.coefficients], float(last.intercept)
    mean = model.transform(df if background is None else background).select(Summarizer.mean(F.col("features")).alias("m")).first()["m"]
    centre = [float(m) for m in mean] if mean is not None else [0.0] * len(weights)
    v = vector_to_array("features")
    parts = F.array(*((v[n] - F.lit(c)) * F.lit(w) for n, (w, c) in enumerate(zip(weights, centre, strict=True))))
    base = intercept + sum(w * c for w, c in zip(weights, centre, strict=True))
    return _listed(model.transform(df).select(F.col(key).alias("key"), parts.alias("values"), F.lit(base).alias("base")), columns, key)


def _listed(found: DataFrame, columns: list[str], key: str) -> DataFrame:
    cells = F.array(*(F.struct(F.lit(c).alias("feature"), F.col("values")[n].alias("value")) for n, c in enumerate(columns)))
    return found.select(F.col("key").alias(key), F.explode(cells).alias("c"), "base").select(key, "c.feature", "c.value", "base")
