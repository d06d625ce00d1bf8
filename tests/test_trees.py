"""Searches of trees' settings against a fit for each setting, and fits on cells against fits on rows."""

import numpy as np
import pandas as pd
import pytest
from pyspark.ml.classification import DecisionTreeClassifier, RandomForestClassifier
from pyspark.sql import functions as F

from assaylake.operators import models, trees

NAMES = ["f0", "f1"]


@pytest.fixture(scope="module")
def table(spark):
    rng = np.random.default_rng(3)
    x = rng.integers(0, 12, (3000, 2)).astype(float)
    y = ((x[:, 0] // 2 + x[:, 1] // 2) % 2).astype(int) ^ (rng.random(3000) < 0.05)  # a board that takes many splits
    return spark.createDataFrame(pd.DataFrame(x, columns=NAMES).assign(hash=np.arange(3000), y=y.astype(int))).repartition(3).cache()


@pytest.fixture
def few(monkeypatch):
    monkeypatch.setattr(trees, "MANY", 100)


@pytest.mark.parametrize("kind", ["tree", "forest"])
def test_one_model_tells_the_accuracy_of_all_smaller_ones(spark, table, kind):
    data = trees.Rows(table, NAMES, "y", 3)
    one = DecisionTreeClassifier(impurity="entropy", labelCol="y", seed=5) if kind == "tree" else RandomForestClassifier(labelCol="y", seed=5, featureSubsetStrategy="all")
    grid = {"maxDepth": [2, 4, 7]} if kind == "tree" else {"impurity": ["entropy", "gini"], "maxDepth": [3, 8], "numTrees": [2, 5]}
    told = trees.accuracies(data, one, grid, 3)
    assert len(told) == (3 if kind == "tree" else 8) and list(told[0][0]) == list(grid)
    for setting, found in told:
        if setting.get("numTrees", 5) == 5:  # a forest of fewer trees draws others
            right = []
            for fold in range(3):
                model = one.copy({one.getParam(k): v for k, v in setting.items()}).fit(data.table.where(F.col("__fold") != fold))
                right.append(model.transform(data.held(fold)).agg(F.avg((F.col("prediction") == F.col("y")).cast("int"))).first()[0])
            assert abs(found - np.mean(right)) < 1e-9


def test_training_searches_its_settings(spark, table):
    model = models.train(table, "dt", NAMES, "y")
    assert model.stages[-1].getMaxDepth() > 5 and models.train(table, "dt", NAMES, "y", search=False).stages[-1].getMaxDepth() == 5
    right = lambda m: models.predict(m, table).agg(F.avg((F.col("prediction") == F.col("y")).cast("int"))).first()[0]
    assert right(model) > 0.93
    forest = models.train(table, "rf", NAMES, "y")
    assert forest.stages[-1].getNumTrees in (10, 20, 30, 40) and right(forest) > 0.9


def test_trees_on_cells_are_trees_on_rows(spark, table, few):
    told = trees.dense(table, NAMES, "y", 4)
    rows = told.table.toPandas()
    assert len(rows) <= 288 and rows.n.sum() == 3000 and (rows[[f"__f{i}" for i in range(4)]].sum(axis=1) == rows.n).all() and (rows[[f"__f{i}" for i in range(4)]].sum() > 600).all()
    for algorithm in ("dt", "gb"):
        got = models.predict(models.train(table, algorithm, NAMES, "y", search=False), table).select("hash", "prediction").toPandas().set_index("hash")
        trees.MANY = 1 << 40
        want = models.predict(models.train(table, algorithm, NAMES, "y", search=False), table).select("hash", "prediction").toPandas().set_index("hash")
        trees.MANY = 100
        assert (got.prediction == want.prediction.reindex(got.index)).mean() > 0.999


def test_searches_on_cells(spark, table, few, monkeypatch):
    monkeypatch.setitem(models.ALGORITHMS, "rf", lambda d, c: models.Searched(RandomForestClassifier(seed=42), {"impurity": ["entropy", "gini"], "maxDepth": [4, 9], "numTrees": [3, 6]}))
    monkeypatch.setattr(models, "FOLDS", 2)
    found, model = models.grid_search(table.select(*NAMES, "y"), NAMES, "y")
    assert type(model.stages[0]).__name__ == "Bucketizer" and model.stages[-1].getMaxDepth() > 5
    got = {r["parameters"]: r["accuracy"] for r in found.collect()}
    trees.MANY = 1 << 40
    want = {r["parameters"]: r["accuracy"] for r in models.grid_search(table.select(*NAMES, "y"), NAMES, "y")[0].collect()}
    assert list(got) == list(want) and all(abs(got[k] - want[k]) < 0.05 for k in got)
    trees.MANY = 100
    forest = models.train(table, "rf", NAMES, "y")
    assert type(forest.stages[0]).__name__ == "Bucketizer" and forest.stages[-1].getNumTrees in (3, 6)
    assert models.predict(forest, table).agg(F.avg((F.col("prediction") == F.col("y")).cast("int"))).first()[0] > 0.9
    assert abs(sum(forest.stages[-1].featureImportances.toArray()) - 1) < 1e-9


def test_bins_of_odd_columns(spark, few):
    df = spark.range(2000).select(F.lit(1.0).alias("same"), (F.col("id") % 1000).cast("double").alias("many"), F.when(F.col("id") % 400 == 0, None).otherwise(F.col("id") % 3).cast("double").alias("f"), (F.col("id") % 2).cast("int").alias("y"))
    told = trees.dense(df, ["same", "many", "f"], "y")
    assert told is not None and told.table.agg(F.sum("n")).first()[0] == 1995 and told.table.select("__bin_many").distinct().count() == trees.BINS
    assert models.predict(trees.fitted(told, DecisionTreeClassifier(labelCol="y")), df).count() == 1995
