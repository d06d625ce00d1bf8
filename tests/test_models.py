"""Trained models: explanations against all subsets, several classes, binary features."""

import math
from itertools import combinations

import numpy as np
import pandas as pd
import pytest
from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import LinearSVC
from pyspark.ml.functions import vector_to_array
from pyspark.sql import functions as F

from assaylake.operators import estimators, explain, heuristics, margins, models, shapley
from assaylake.plans import learning

NAMES = [f"f{i}" for i in range(6)]


@pytest.fixture(scope="module")
def table(spark):
    rng = np.random.default_rng(31)
    x = rng.standard_normal((400, 6))
    y = ((x[:, 0] > 0) ^ (x[:, 1] * x[:, 2] > 0.1) | (x[:, 3] > 1.2)).astype(int)
    third = np.stack([x[:, 0], 0.9 * x[:, 4] - 0.5 * x[:, 0], -0.9 * x[:, 4] - 0.5 * x[:, 0]]).argmax(0)
    return spark.createDataFrame(pd.DataFrame(x, columns=NAMES).assign(hash=np.arange(400), y=y, cls=third)).repartition(3).cache()


def follow(node, row, known, kind):
    if node.subtreeDepth() == 0:
        return shapley._value(node, kind)
    split = node.split()
    sides = [node.leftChild(), node.rightChild()]
    if split.featureIndex() in known:
        return follow(sides[row[split.featureIndex()] > split.threshold()], row, known, kind)
    return sum(follow(s, row, known, kind) * s.impurityStats().count() for s in sides) / node.impurityStats().count()


def brute(roots, row, kind):
    """Shapley values from all subsets of the features."""
    value = {some: sum(w * follow(r, row, set(some), kind) for r, w in roots) for n in range(7) for some in combinations(range(6), n)}
    out = []
    for f in range(6):
        total = 0.0
        for some in value:
            if f not in some:
                total += math.factorial(len(some)) * math.factorial(5 - len(some)) / 720 * (value[tuple(sorted((*some, f)))] - value[some])
        out.append(total)
    return out, value[()]


@pytest.mark.parametrize("algorithm", ["dt", "rf", "gb"])
def test_tree_values_equal_all_subsets(spark, table, monkeypatch, algorithm):
    small = {"rf": lambda d, c: models.RandomForestClassifier(numTrees=4, maxDepth=4, seed=1), "gb": lambda d, c: models.GBTClassifier(maxIter=3, maxDepth=3, seed=1)}
    if algorithm in small:
        monkeypatch.setitem(models.ALGORITHMS, algorithm, small[algorithm])
    model = models.train(table, algorithm, NAMES, "y")
    last = model.stages[-1]
    java = last._java_obj
    roots = [(java.rootNode(), 1.0)] if algorithm == "dt" else [(t.rootNode(), w / (1 if algorithm == "gb" else 4)) for t, w in zip(java.trees(), last.treeWeights, strict=True)]
    got = {}
    for r in shapley.tree_values(model, table, NAMES).collect():
        got.setdefault(r["hash"], {"base": r["base"]})[r["feature"]] = r["value"]
    assert len(got) == 400
    rows = {r["hash"]: r for r in model.transform(table).select("hash", vector_to_array("features").alias("v"), vector_to_array("rawPrediction").alias("raw"), vector_to_array("probability").alias("p")).collect()}
    for k in range(0, 400, 80):
        want, base = brute(roots, rows[k]["v"], None if algorithm == "gb" else 1)
        assert np.allclose([got[k][c] for c in NAMES], want, atol=1e-9) and abs(got[k]["base"] - base) < 1e-9
    for k, r in rows.items():  # they sum up to what the model says
        said = r["raw"][1] if algorithm == "gb" else r["p"][1]
        assert abs(sum(got[k].values()) - said) < 1e-6


def test_rows_of_one_cell_are_explained_once(monkeypatch):
    rng = np.random.default_rng(21)
    leaves = []
    for _ in range(30):
        used = sorted(rng.choice(4, rng.integers(1, 5), replace=False).tolist())
        low = rng.integers(0, 5, len(used)) / 2.0
        leaves.append(shapley.Leaf(float(rng.normal()), used, rng.random(len(used)).tolist(), low.tolist(), (low + 1).tolist(), [None] * len(used)))
    rows = rng.integers(0, 9, (500, 4)) / 2.0  # on the bounds, and between them
    base, one_by_one = 0.0, []
    for row in rows:  # a row alone takes no table of ways
        base, found = shapley.values(leaves, row[None, :])
        one_by_one.append(found[0])
    assert np.allclose(shapley.values(leaves, rows)[1], one_by_one, atol=1e-12)
    asked = []
    one = shapley.values
    monkeypatch.setattr(shapley, "values", lambda some, x: asked.append(len(x)) or one(some, x))
    told = shapley.Explained(leaves, 4)
    assert np.allclose(told(rows[:300]), one_by_one[:300], atol=1e-12) and np.allclose(told(rows[100:]), one_by_one[100:], atol=1e-12)
    assert np.allclose(told(rows), one_by_one, atol=1e-12) and abs(told.base - base) < 1e-12 and len(asked) == 2 and sum(asked) <= 500
    few = shapley.Explained(leaves, 4, most=10)
    assert np.allclose(np.concatenate([few(rows[k : k + 8]) for k in range(0, 500, 8)]), one_by_one, atol=1e-12) and len(few.cells) <= 10
    odd = np.array([[np.nan, 1.0, 0.5, 2.0], [np.inf, -np.inf, 1.0, 1.0]])
    assert np.allclose(shapley.Explained(leaves, 4)(odd), one(leaves, odd)[1], atol=1e-12)
    leaves[0].allowed[0] = {0.5, 1.0}
    assert not shapley.Explained(leaves, 4).numbered


def test_linear_values(spark, table):
    model = models.train(table, "lr", NAMES, "y")
    got = {}
    for r in shapley.linear_values(model, table, NAMES).collect():
        got.setdefault(r["hash"], {"base": r["base"]})[r["feature"]] = r["value"]
    rows = model.transform(table).select("hash", vector_to_array("features").alias("v"), vector_to_array("rawPrediction").alias("raw")).collect()
    mean = np.mean([r["v"] for r in rows], 0)
    weights = model.stages[-1].coefficients.toArray()
    for r in rows:
        assert np.allclose([got[r["hash"]][c] for c in NAMES], weights * (np.array(r["v"]) - mean)) and abs(sum(got[r["hash"]].values()) - r["raw"][1]) < 1e-9


def test_margins_of_three_classes(spark, table):
    model = models.train(table, "lsvc", NAMES, "cls", 3)
    found = models.predict(model, table)
    assert found.columns == [*table.columns, "prediction"]
    assert {r["prediction"] for r in found.select("prediction").distinct().collect()} == {0, 1, 2}
    assert found.agg(F.avg((F.col("prediction") == F.col("cls")).cast("int"))).first()[0] > 0.85


@pytest.mark.parametrize("algorithm", ["bnb", "mnb"])
def test_naive_bayes_of_counts_and_flags(spark, table, algorithm):
    rows = table.withColumns({c: F.when(F.col(c) > 0, F.lit(3.0)).otherwise(0.0) for c in NAMES})
    model = models.train(rows, algorithm, NAMES, "y")
    wild = rows.withColumn("f0", F.lit(-50.0)).withColumn("f1", F.lit(1e6))  # beyond what it was trained on
    assert models.predict(model, wild).count() == 400 and models.predict(model, wild.limit(0)).count() == 0
    assert models.predict(model, rows).agg(F.avg((F.col("prediction") == F.col("y")).cast("int"))).first()[0] > 0.5


def test_estimators_are_saved_and_loaded(spark, tmp_path):
    rng = np.random.default_rng(7)
    df = spark.createDataFrame(pd.DataFrame({"hash": np.arange(200), "a": rng.exponential(size=200), "b": rng.integers(0, 5, 200).astype(float), "y": rng.integers(0, 2, 200)})).withColumn("flag", F.col("b") > 1)
    score = heuristics.power_risk({"a": (0.5, 2.0), "b": (20.0, 1.0)})
    made = {
        "risk": estimators.RiskEstimator(score, "y"),
        "given": estimators.RiskEstimator(heuristics.linear_risk({"a": (2.0, 0.5), "b": (1.0, 10.0)}), threshold=3.0),
        "margin": estimators.MarginEstimator(["a", "b"], "y", 0.5),
        "flagged": estimators.MarginEstimator(["a"], "y", 1.0, "flag"),
        "norm": estimators.NormEstimator(["a", "b"], "y", 0.05),
        "stump": estimators.StumpEstimator(["a", "b"], "y"),
    }
    for name, estimator in made.items():
        kept = "prediction"
        want = Pipeline(stages=[estimator]).fit(df)
        rows = sorted(tuple(r) for r in want.transform(df).select("hash", kept).collect())
        want.write().overwrite().save(f"{tmp_path}/{name}-model")
        Pipeline(stages=[estimator]).write().overwrite().save(f"{tmp_path}/{name}")
        again = PipelineModel.load(f"{tmp_path}/{name}-model")
        fitted = Pipeline.load(f"{tmp_path}/{name}").fit(df)
        for model in (again, fitted):
            assert sorted(tuple(r) for r in model.transform(df).select("hash", kept).collect()) == rows
        assert {p for _, p in rows} == {0, 1}, name
    with pytest.raises(ValueError, match="power"):
        heuristics.power_risk({})


def test_fits_read_a_split_that_is_written(spark, sf, monkeypatch):
    """A fit goes through its rows many times; the shuffle and sort of the split are not among what it repeats."""
    seen = []
    plan = lambda df: seen.append(df._jdf.queryExecution().optimizedPlan().toString())
    real = models.train
    monkeypatch.setattr(models, "train", lambda df, *more: plan(df) or real(df, *more))
    monkeypatch.setattr(models, "grid_search", lambda df, *more: plan(df) or (df, None))
    for query in (learning.train_dt, learning.performance_log, learning.grid_search, learning.grid_search_forest):
        query(spark, sf)
    assert len(seen) == 5 and not any("Window" in p for p in seen)


def test_folds_hold_the_columns_of_a_search_alone(spark, table, monkeypatch):
    seen = []
    monkeypatch.setattr(models.CrossValidator, "fit", lambda self, df: seen.append(df.columns) or 1 / 0)
    with pytest.raises(ZeroDivisionError):
        models.grid_search(table, NAMES[:2], "y")
    assert seen == [["f0", "f1", "y"]]


def test_resamples_repeat_a_row_once_for_each_run(spark, table):
    got = explain.bootstrap(table, lambda x: x["f0"] * x["f1"], ["f0", "f1"], runs=7)
    made = got._jdf.queryExecution().analyzed().toString()
    assert made.count("Generate explode(sequence(1, 7") == 1 and "Generate explode(array(struct(feature, f0, sign" not in made
    x = table.select("hash", "f0", "f1").toPandas()
    weights = table.crossJoin(spark.range(1, 8).select(F.col("id").cast("int").alias("run"))).select("hash", "run", ((F.pmod(F.xxhash64("hash", "run"), F.lit(1_000_003)) + 0.5) / 1_000_003).alias("u")).toPandas()
    weights["w"] = sum((weights.u > s).astype(int) for s in (0.367879, 0.735759, 0.919699, 0.981012, 0.99634))
    rows = weights.merge(x, on="hash")
    for name, other in (("f0", "f1"), ("f1", "f0")):
        rows["i"] = (rows[name].abs() * 0.1) * rows[other]
        means = rows.groupby("run").apply(lambda r: (r.w * r.i).sum() / r.w.sum(), include_groups=False)
        found = got.where(F.col("feature") == name).first()
        assert abs(found["mean"] - means.mean()) < 2e-6 and abs(found["low"] - means.quantile(0.025)) < 2e-6 and abs(found["high"] - means.quantile(0.975)) < 2e-6


def test_machines_of_all_classes_share_few_passes(spark, table, tmp_path, monkeypatch):
    """The losses are no greater than those of LinearSVC for each class, and passes do not grow with the classes or with a line search."""
    passes, real = [], margins._losses
    monkeypatch.setattr(margins, "_losses", lambda *a: passes.append(1) or real(*a))
    model = models.train(table, "lsvc", NAMES, "cls", 3)
    assert len(passes) <= 52
    rows = model.transform(table).select("hash", "cls", vector_to_array("features").alias("v"), F.col("features").alias("f"), "prediction").collect()
    x, cls = np.array([r["v"] for r in rows]), np.array([r["cls"] for r in rows])
    spread = x.std(0, ddof=1)
    fitted = spark.createDataFrame([(r["f"], int(r["cls"])) for r in rows], ["features", "cls"]).cache()
    for c, plane in enumerate(model.stages[-1].planes()):
        sign = np.where(cls == c, 1, -1)
        loss = lambda w, b: np.maximum(0, 1 - sign * (x @ w + b)).mean() + 0.05 * ((w * spread) ** 2).sum()
        theirs = LinearSVC(maxIter=50, regParam=0.1).fit(fitted.select("features", (F.col("cls") == c).cast("int").alias("label")))
        assert loss(plane[:-1], plane[-1]) <= loss(theirs.coefficients.toArray(), theirs.intercept) + 2e-6
    assert [r["prediction"] for r in rows] == (x @ model.stages[-1].planes()[:, :-1].T + model.stages[-1].planes()[:, -1]).argmax(1).tolist()
    model.write().save(f"{tmp_path}/machines")
    again = PipelineModel.load(f"{tmp_path}/machines")
    assert again.transform(table).select("hash", "prediction").collect() == model.transform(table).select("hash", "prediction").collect()


def test_sampled_values_ask_the_model_once_for_each_set(spark, table):
    asked = []
    model = lambda x: asked.append(1) or x["f0"] * x["f1"] + x["f2"]
    rows = explain.shapley(table, model, ["f0", "f1", "f2"], {"f0": 0.5, "f1": -1.0, "f2": 2.0})
    assert len(asked) <= 8  # sets of three features
    got = {}
    for r in rows.collect():
        got[r["hash"]] = got.get(r["hash"], 0.0) + r["value"]
    for r in table.collect():
        assert abs(got[r["hash"]] - (r["f0"] * r["f1"] + r["f2"] - 1.5)) < 3e-6
