"""Training and applying models on feature tables, by pyspark.ml and by joins."""

from __future__ import annotations

from typing import NamedTuple

import numpy as np
import pandas as pd
from pyspark import keyword_only
from pyspark.ml import Estimator, Pipeline, PipelineModel, Transformer
from pyspark.ml.classification import DecisionTreeClassifier, GBTClassifier, LinearSVC, LogisticRegression, MultilayerPerceptronClassifier, NaiveBayes, RandomForestClassifier
from pyspark.ml.clustering import BisectingKMeans, KMeans
from pyspark.ml.evaluation import MulticlassClassificationEvaluator
from pyspark.ml.feature import Binarizer, MinMaxScaler, VectorAssembler
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.param.shared import HasInputCol, HasOutputCol
from pyspark.ml.tuning import CrossValidator, ParamGridBuilder
from pyspark.ml.util import DefaultParamsReadable, DefaultParamsWritable
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from assaylake.operators import metric, trees
from assaylake.operators.margins import MarginsEstimator
from assaylake.sources.scratch import cut, written

class UnitRange(Transformer, HasInputCol, HasOutputCol, DefaultParamsReadable, DefaultParamsWritable):
    """A vector with its components brought into 0 to 1: values beyond those of the training go to the nearer end."""

    @keyword_only
    def __init__(self, inputCol: str | None = None, outputCol: str | None = None):
        super().__init__()
        self._set(**self._input_kwargs)

    def _transform(self, dataset: DataFrame) -> DataFrame:
        held = F.transform(vector_to_array(self.getInputCol()), lambda x: F.greatest(F.lit(0.0), F.least(F.lit(1.0), x)))
        return dataset.withColumn(self.getOutputCol(), array_to_vector(held))


class Searched(NamedTuple):
    """An estimator whose settings are those of the grid that do best in cross-validation on what it is trained on."""

    estimator: Estimator
    grid: dict[str, list]


#: Named algorithms: an estimator for a number of features and classes.
ALGORITHMS = {
    "dt": lambda d, c: Searched(DecisionTreeClassifier(impurity="entropy", maxDepth=5, seed=42), {"maxDepth": [2, 4, 6, 8, 10, 12]}),
    "rf": lambda d, c: Searched(RandomForestClassifier(numTrees=20, maxDepth=5, seed=42), {"impurity": ["entropy", "gini"], "maxDepth": [4, 5, 6, 7, 8, 9, 10], "numTrees": [10, 20, 30, 40]}),
    "gb": lambda d, c: GBTClassifier(maxIter=30, maxDepth=3, seed=42),
    "nb": lambda d, c: NaiveBayes(modelType="gaussian"),
    "bnb": lambda d, c: NaiveBayes(modelType="bernoulli"),
    "mnb": lambda d, c: NaiveBayes(modelType="multinomial"),
    "lr": lambda d, c: LogisticRegression(maxIter=50),
    "lsvc": lambda d, c: LinearSVC(maxIter=50, regParam=0.1) if c < 3 else MarginsEstimator(classes=c, maxIter=50, regParam=0.1),
    "mlp": lambda d, c: MultilayerPerceptronClassifier(layers=[d, 10, 2, c], seed=42, maxIter=50),
    "j48": lambda d, c: DecisionTreeClassifier(impurity="entropy", minInstancesPerNode=2, seed=42),
}
#: What stands between scaling and an algorithm: flags of what is over the least value, and values that stay in range.
BETWEEN = {
    "bnb": lambda: Binarizer(threshold=0.0, inputCol="__scaled", outputCol="features"),
    "mnb": lambda: UnitRange(inputCol="__scaled", outputCol="features"),
}


#: Algorithms that are fitted on cells where those are few, see trees; folds of the search of an algorithm's settings.
ON_CELLS, FOLDS = ("dt", "rf", "gb"), 5


def _estimator(algorithm: str, columns: list[str], label: str, classes: int) -> tuple[Estimator, dict[str, list] | None]:
    """The named estimator, and the grid that its settings are searched in."""
    made = ALGORITHMS[algorithm](len(columns), classes)
    estimator, grid = made if isinstance(made, Searched) else (made, None)
    return estimator.setFeaturesCol("features").setLabelCol(label), grid


def train(df: DataFrame, algorithm: str, columns: list[str], label: str, classes: int = 2, search: bool = True) -> PipelineModel:
    """A pipeline of assembling, min-max scaling and the named algorithm, fitted on df, its settings searched on df alone where it has a grid (without search: those of ALGORITHMS).

    More than two classes of a linear SVC are one machine for each class against the rest, see margins. Trees are fitted on cells where many rows share one, see trees.
    """
    estimator, grid = _estimator(algorithm, columns, label, classes)
    grid = grid if search else None
    cells = trees.dense(df, columns, label, FOLDS if grid else 0) if algorithm in ON_CELLS else None
    if grid:
        return trees.searched(cells or trees.Rows(df, columns, label, FOLDS), estimator, grid, FOLDS)[1]
    if cells:
        return trees.fitted(cells, estimator)
    between = [BETWEEN[algorithm]()] if algorithm in BETWEEN else []
    scaled = "__scaled" if between else "features"
    return Pipeline(stages=[VectorAssembler(inputCols=columns, outputCol="__raw", handleInvalid="skip"), MinMaxScaler(inputCol="__raw", outputCol=scaled), *between, estimator]).fit(df)


def predict(model: PipelineModel, df: DataFrame) -> DataFrame:
    """df with prediction (and probability of class 1 where the model has one)."""
    out = model.transform(df)
    extra = [F.round(vector_to_array("probability")[1], 6).alias("probability")] if "probability" in out.columns else []
    return out.select(*df.columns, F.col("prediction").cast("int").alias("prediction"), *extra)


#: What a grid search tries for each algorithm: parameters of its estimator and their values.
GRIDS = {
    "dt": {"maxDepth": [2, 4, 6, 8, 10, 12]},
    "rf": {"maxDepth": [3, 5], "numTrees": [10, 20]},
    "gb": {"maxDepth": [3, 5, 7]},
    "lr": {"regParam": [0.0, 0.01, 0.1]},
    "lsvc": {"regParam": [0.01, 0.1, 1.0]},
}


def grid_search(df: DataFrame, columns: list[str], label: str, algorithm: str = "dt", grid: dict[str, list] | None = None, folds: int = 3, classes: int = 2) -> tuple[DataFrame, PipelineModel]:
    """((parameters, accuracy) of each setting, the pipeline of the best one fitted on df) by cross-validation on df alone."""
    estimator, _ = _estimator(algorithm, columns, label, classes)
    grid = grid or GRIDS[algorithm]
    if algorithm in ("dt", "rf") and (cells := trees.dense(df, columns, label, folds)):
        told, best = trees.searched(cells, estimator, grid, folds)
        return _told(df.sparkSession, told), best
    builder = ParamGridBuilder()
    for name, values in grid.items():
        builder = builder.addGrid(estimator.getParam(name), values)
    tried = builder.build()
    stages = Pipeline(stages=[VectorAssembler(inputCols=columns, outputCol="__raw", handleInvalid="skip"), MinMaxScaler(inputCol="__raw", outputCol="features"), estimator])
    cv = CrossValidator(estimator=stages, estimatorParamMaps=tried, evaluator=MulticlassClassificationEvaluator(labelCol=label, metricName="accuracy"), numFolds=folds, seed=42, parallelism=4)
    model = cv.fit(df.select(*columns, label))  # each fold is kept in memory for the time of its fits
    return _told(df.sparkSession, [({p.name: v for p, v in s.items()}, a) for s, a in zip(tried, model.avgMetrics, strict=True)]), model.bestModel


def _told(spark, tried: list[tuple[dict, float]]) -> DataFrame:
    rows = [(", ".join(f"{k}={v}" for k, v in sorted(s.items())), round(float(a), 6)) for s, a in tried]
    return spark.createDataFrame(rows, "parameters string, accuracy double")


def importances(model: PipelineModel, columns: list[str], spark) -> DataFrame:
    """(feature, importance, rank) of the features that count."""
    weights = model.stages[-1].featureImportances.toArray().tolist()
    rows = sorted(((c, round(w, 6)) for c, w in zip(columns, weights, strict=True) if w > 0), key=lambda x: (-x[1], x[0]))
    return spark.createDataFrame([(c, w, i + 1) for i, (c, w) in enumerate(rows)], "feature string, importance double, rank int")


#: Rows, and queries, that meet in one task of knn.
BLOCK = 4096


def _blocks(df: DataFrame, key: str, columns: list[str], label: str | None, seed: int, name: str) -> tuple[DataFrame, int]:
    """(blocks of rows as (block, keys, labels, vectors), their number)."""
    n = max(1, -(-df.count() // BLOCK))
    vector = F.array(*(F.col(c).cast("double") for c in columns)) if len(columns) > 1 or dict(df.dtypes)[columns[0]].startswith(("double", "float", "int", "bigint")) else F.col(columns[0]).cast("array<double>")
    rows = df.select(F.pmod(F.xxhash64(key, F.lit(seed)), F.lit(n)).cast("int").alias("block"), F.col(key).alias("key"), (F.col(label) if label else F.lit(None)).cast("string").alias("label"), vector.alias("vector"))
    listed = rows.groupBy("block").agg(F.collect_list("key").alias("keys"), F.collect_list(F.coalesce("label", F.lit(""))).alias("labels"), F.collect_list("vector").alias("vectors"))
    return written(listed, name), n


def _nearest(k: int, p: int):
    """Of pairs of blocks: each query's k nearest rows in the block, ties to the smaller key."""

    def search(batches):
        for batch in batches:
            for row in batch.itertuples(index=False):
                vectors, asked = np.stack(row.vectors), np.stack(row.q_vectors)
                keys, labels = np.asarray(row.keys), np.asarray(row.labels, object)
                for q, vector in zip(row.q_keys, asked, strict=True):
                    away = np.round((np.abs(vectors - vector) ** p).sum(1), 9)
                    away[keys == q] = np.inf
                    some = np.flatnonzero(away <= np.partition(away, min(k, len(away)) - 1)[min(k, len(away)) - 1])
                    some = some[np.isfinite(away[some])]
                    best = some[np.lexsort((labels[some], keys[some], away[some]))][:k]
                    yield pd.DataFrame({"q": q, "key": keys[best], "label": labels[best], "d": away[best]})

    return search


def knn(train_rows: DataFrame, queries: DataFrame, columns: list[str], label: str, k: int = 5, p: int = 2, weights: str = "uniform") -> DataFrame:
    """(hash, prediction): each query's vote among its k nearest rows by Minkowski distance; ties to the smaller hash, then to the greater label.

    columns: numbers, or one array of them. A row with a query's own hash does not vote. weights: 'uniform', or 'distance' (votes count 1 / distance; a
    distance of 0 outweighs all others). Queries meet rows in blocks of bounded size, and k rows for each query and block go on: for a stated query
    set against all rows.
    """
    rows, _ = _blocks(train_rows, "hash", columns, label, 1, "knn-rows")
    asked, _ = _blocks(queries, "hash", columns, None, 2, "knn-queries")
    asked = asked.select(F.col("block").alias("q_block"), F.col("keys").alias("q_keys"), F.col("vectors").alias("q_vectors"))
    numbers = asked.select("q_block").join(rows.select("block"))  # a row for each pair of blocks
    pairs = numbers.join(rows.hint("merge"), "block").join(asked.hint("merge"), "q_block").select("keys", "labels", "vectors", "q_keys", "q_vectors", "block", "q_block")
    kind = dict(queries.dtypes)["hash"]
    near = pairs.groupBy("block", "q_block").applyInPandas(lambda part: pd.concat(list(_nearest(k, p)([part]))), f"q {kind}, key {kind}, label string, d double")
    top = near.withColumn("place", F.row_number().over(Window.partitionBy("q").orderBy("d", "key", "label"))).where(F.col("place") <= k)
    weight = F.lit(1.0) if weights == "uniform" else F.when(F.col("d") == 0, 1e300).otherwise(1 / F.pow("d", F.lit(1 / p)))
    votes = top.groupBy("q", "label").agg(F.sum(weight).alias("n"))
    value = F.col("label").cast(dict(train_rows.dtypes)[label])
    return votes.select("q", value.alias("v"), "n").groupBy("q").agg(F.max_by("v", F.struct("n", "v")).alias("prediction")).withColumnRenamed("q", "hash")


def cluster(df: DataFrame, columns: list[str], k: int, kind: str = "kmeans") -> DataFrame:
    """df with cluster, by k-means or its bisecting form on min-max scaled columns."""
    estimator = (KMeans if kind == "kmeans" else BisectingKMeans)(k=k, seed=42, featuresCol="features", predictionCol="cluster")
    stages = [VectorAssembler(inputCols=columns, outputCol="__raw", handleInvalid="skip"), MinMaxScaler(inputCol="__raw", outputCol="features"), estimator]
    return Pipeline(stages=stages).fit(df).transform(df).select(*df.columns, "cluster")


def _times(edges: DataFrame, state: DataFrame, names: list[str]) -> DataFrame:
    """The normalised affinities times the state's columns."""
    return edges.join(state.withColumnRenamed("id", "dst"), "dst").groupBy(F.col("src").alias("id")).agg(*(F.sum(F.col("weight") * F.col(c)).alias(c) for c in names))


def spectral_embedding(edges: DataFrame, k: int, rounds: int = 15, spare: int = 6, every: int = 3) -> DataFrame:
    """(id, features): the k leading eigenvectors of the normalised affinities (src, dst, weight, each pair once), rows at length one.

    k + spare random columns are multiplied by (affinities + 1) / 2, one join and one grouping a round; what they span then holds the leading eigenvectors up to the share of
    eigenvalue k + spare + 1 in eigenvalue k to the power of rounds, and a small eigenproblem on the driver (k + spare numbers a side) finds them in it.
    """
    names = [f"x{i}" for i in range(k + spare)]
    both = edges.unionByName(edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"), "weight"))
    degree = cut(both.groupBy("src").agg(F.sum("weight").alias("degree")))
    scaled = both.join(degree, "src").join(degree.withColumnsRenamed({"src": "dst", "degree": "other"}), "dst")
    scaled = written(scaled.select("src", "dst", (F.col("weight") / F.sqrt(F.col("degree") * F.col("other"))).alias("weight")), "affinities")
    state = degree.select(F.col("src").alias("id"), *(((F.xxhash64("src", F.lit(i)) / float(1 << 63))).alias(c) for i, c in enumerate(names)))
    for turn in range(rounds):
        more = _times(scaled, state, names).withColumnsRenamed({c: f"{c}_" for c in names})
        state = state.join(more, "id").select("id", *(((F.col(c) + F.col(f"{c}_")) / 2).alias(c) for c in names))
        if turn % every == every - 1:
            state = cut(state)
    state = cut(state)
    met = state.join(_times(scaled, state, names).withColumnsRenamed({c: f"{c}_" for c in names}), "id")
    sums = met.agg(*(F.sum(F.col(a) * F.col(b + tail)).alias(f"{a}{tail}{b}") for tail in ("", "_") for a in names for b in names)).first()
    if sums[0] is None:
        return state.select("id", array_to_vector(F.array(*(F.col(c) for c in names[:k]))).alias("features"))
    inner, image = (np.array([[sums[f"{a}{tail}{b}"] for b in names] for a in names]) for tail in ("", "_"))
    size, turned = np.linalg.eigh(inner)
    some = size > size[-1] * 1e-12
    basis = turned[:, some] / np.sqrt(size[some])
    image = basis.T @ image @ basis
    leading = basis @ np.linalg.eigh((image + image.T) / 2)[1][:, ::-1][:, :k]
    parts = [sum(F.col(c) * F.lit(float(x)) for c, x in zip(names, column, strict=True)) for column in leading.T]
    raw = state.select("id", F.array(*parts).alias("v"))
    length = F.sqrt(F.aggregate("v", F.lit(0.0), lambda s, x: s + x * x))
    return raw.withColumn("length", length).select("id", array_to_vector(F.transform("v", lambda x: F.when(F.col("length") > 0, x / F.col("length")).otherwise(0.0))).alias("features"))


def spectral(df: DataFrame, key: str, columns: list[str], k: int, neighbours: int = 10, rounds: int = 15) -> DataFrame:
    """(id, cluster): k-means of the spectral embedding of each row's nearest neighbours over all columns.

    Rows without neighbours (null or non-finite components, or a table of one row) are in no cluster. One vector, as power iteration clustering has it, does not tell
    rings apart before some hundred rounds; several do.
    """
    edges = written(metric.affinity(metric.knn_graph(df, key, columns, neighbours)), "affinity")
    embedded = written(spectral_embedding(edges, k, rounds), "spectral")
    if embedded.isEmpty():
        return embedded.select("id", F.lit(None).cast("int").alias("cluster"))
    return KMeans(k=k, seed=42, featuresCol="features", predictionCol="cluster").fit(embedded).transform(embedded).select("id", "cluster")


def auto_k(df: DataFrame, label: str) -> DataFrame:
    """One row k: the number of known labels, or 2 where there are fewer."""
    return df.agg(F.greatest(F.lit(2), F.count_distinct(F.when(F.col(label) != "?", F.col(label)))).alias("k"))


def label_requirement(df: DataFrame, label: str = "label") -> DataFrame:
    """One row: whether the labels do for supervised (all known) and semi-supervised (some known) training."""
    known = F.avg((F.col(label) != "?").cast("int"))
    return df.agg(F.coalesce(known == 1, F.lit(False)).alias("supervised"), F.coalesce(known > 0, F.lit(False)).alias("semi_supervised"))


def box(df: DataFrame, x: str, y: str, bounds: tuple[float, float, float, float]) -> DataFrame:
    return df.where(F.col(x).between(*bounds[:2]) & F.col(y).between(*bounds[2:]))
