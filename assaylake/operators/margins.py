"""Linear support vector machines of several classes, one against the rest, by cutting planes: all classes share each pass over the rows.

The objective is that of pyspark.ml's LinearSVC: the mean hinge loss, plus half the regularisation times the squared weights of the features over their deviations. A pass
gives for each class the loss and a subgradient where its machine stands, which bound the loss from below everywhere; the next place is the best one by all bounds so far. The hinge has
kinks where a line search takes dozens of passes for a step; the bounds need none.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.ml import Estimator, Model
from pyspark.ml.functions import vector_to_array
from pyspark.ml.param import Param, Params, TypeConverters
from pyspark.ml.param.shared import HasFeaturesCol, HasLabelCol, HasMaxIter, HasPredictionCol, HasRegParam, HasTol
from pyspark.ml.util import DefaultParamsReadable, DefaultParamsWritable
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from assaylake.sources.scratch import passing


class _Machines(HasFeaturesCol, HasLabelCol, HasPredictionCol, HasMaxIter, HasRegParam, HasTol, DefaultParamsReadable, DefaultParamsWritable):
    classes = Param(Params._dummy(), "classes", "number of classes", TypeConverters.toInt)
    weights = Param(Params._dummy(), "weights", "weights of the features and an intercept for each class, one after another", TypeConverters.toListFloat)

    def __init__(self, **settings):
        super().__init__()
        self._setDefault(maxIter=50, regParam=0.1, tol=1e-6)
        self._set(**settings)

    def setFeaturesCol(self, value: str):
        return self._set(featuresCol=value)

    def setLabelCol(self, value: str):
        return self._set(labelCol=value)


class MarginsModel(Model, _Machines):
    """Adds the class of the greatest margin, the first of equals."""

    def planes(self) -> np.ndarray:
        """(classes, features + 1): weights and intercept of each class."""
        return np.array(self.getOrDefault(self.weights)).reshape(self.getOrDefault(self.classes), -1)

    def _transform(self, dataset: DataFrame) -> DataFrame:
        v = vector_to_array(self.getFeaturesCol())
        sums = [F.aggregate(F.zip_with(v, F.array(*(F.lit(float(x)) for x in plane[:-1])), lambda a, b: a * b), F.lit(float(plane[-1])), lambda s, x: s + x) for plane in self.planes()]
        best = F.array_position(F.array(*sums), F.array_max(F.array(*sums)))
        return dataset.withColumn(self.getPredictionCol(), (best - 1).cast("double"))


class MarginsEstimator(Estimator, _Machines):
    """Fits one machine a class. maxIter bounds the passes beside the first three; tol is the relative gap to the least loss at which a class is done."""

    def _fit(self, dataset: DataFrame) -> MarginsModel:
        classes, regular, tol = self.getOrDefault(self.classes), self.getRegParam(), self.getTol()
        flat = dataset.select(F.col(self.getLabelCol()).cast("int").alias("y"), vector_to_array(self.getFeaturesCol()).alias("v"))
        with passing(flat, "margins") as rows:
            first = _sums(rows, lambda y, x: [len(x), *x.sum(0), *np.square(x).sum(0)])
            if first is None:
                raise ValueError("no rows to fit")
            n, (total, squares) = first[0], np.split(first[1:], 2)
            # Deviations as of the sample; squares are of values scaled to about 0 to 1.
            spread = np.sqrt(np.maximum(squares - total * total / n, 0) / max(n - 1, 1))
            scale = np.divide(1.0, spread, out=np.zeros_like(spread), where=spread > 0)
            size = len(scale) + 1
            cuts = [Cuts(size, regular) for _ in range(classes)]
            places = [np.eye(1, size, size - 1)[0] * s for s in (1.0, -1.0)]
            asked = [np.tile(p, (classes, 1)) for p in places]  # with these two cuts the intercepts are bounded
            for turn in range(self.getMaxIter() + 2):
                at = asked[turn] if turn < 2 else np.stack([c.next() for c in cuts])
                loss = _losses(rows, at, scale, classes) / n
                for cut, place, row in zip(cuts, at, loss, strict=True):
                    cut.add(place, row[0], row[1:])
                if turn > 1 and all(c.gap() <= tol * max(1.0, abs(c.least)) for c in cuts):
                    break
        found = np.stack([c.best for c in cuts]) * np.append(scale, 1.0)
        return MarginsModel(featuresCol=self.getFeaturesCol(), labelCol=self.getLabelCol(), predictionCol=self.getPredictionCol(), classes=classes, weights=[float(x) for x in found.ravel()])


def _sums(rows: DataFrame, of) -> np.ndarray | None:
    """The sum over all batches of of(labels, vectors): a row for each task comes to the driver."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for batch in batches:
            if batch.num_rows:
                y = batch.column(0).to_numpy(zero_copy_only=False)
                part = np.asarray(of(y, batch.column(1).flatten().to_numpy(zero_copy_only=False).reshape(len(y), -1)), float)
                total = part if total is None else total + part
        if total is not None:
            yield pa.RecordBatch.from_arrays([pa.array([total.tolist()], pa.list_(pa.float64()))], ["s"])

    found = [r["s"] for r in rows.select("y", "v").mapInArrow(run, "s array<double>").collect()]
    return np.sum(found, 0) if found else None


def _losses(rows: DataFrame, at: np.ndarray, scale: np.ndarray, classes: int) -> np.ndarray:
    """(classes, 1 + features + 1): sums of the hinge losses and of their subgradients at a place for each class."""

    def of(y, x):
        x = np.hstack([x * scale, np.ones((len(x), 1))])
        sign = np.where(y[:, None] == np.arange(classes), 1.0, -1.0)
        short = 1 - sign * (x @ at.T)
        on = np.where(short > 0, sign, 0.0)
        return np.hstack([np.maximum(short, 0).sum(0)[:, None], -(on.T @ x)]).ravel()

    return _sums(rows, of).reshape(classes, -1)


class Cuts:
    """Lower bounds of one class's mean loss, and the place that is best by them; the last component is the intercept, which is not regularised."""

    def __init__(self, size: int, regular: float):
        self.regular, self.slopes, self.shifts = regular, np.zeros((0, size)), np.zeros(0)
        self.best, self.least, self.bound = np.zeros(size), np.inf, -np.inf

    def add(self, place: np.ndarray, loss: float, slope: np.ndarray) -> None:
        self.slopes, self.shifts = np.vstack([self.slopes, slope]), np.append(self.shifts, loss - slope @ place)
        value = loss + self.regular / 2 * place[:-1] @ place[:-1]
        if value < self.least:
            self.least, self.best = value, place

    def gap(self) -> float:
        return self.least - self.bound

    def next(self) -> np.ndarray:
        """The least of the bounds' maximum plus regularisation: a small convex problem, by a primal-dual interior point method."""
        a, c, d = self.slopes, self.shifts, self.slopes.shape[1]
        k = len(c)
        # Minimise r/2 |w|^2 + t with t >= a v + c: unknowns v and t; multipliers are the cuts' shares.
        h = np.diag(np.r_[np.full(d - 1, self.regular), 1e-12, 0.0])
        g, lin = np.hstack([a, -np.ones((k, 1))]), np.r_[np.zeros(d), 1.0]
        z = np.r_[self.best, (a @ self.best + c).max() + 1.0]
        slack, share = -(g @ z + c), np.full(k, 1.0 / k)
        for _ in range(100):
            mu = slack @ share / k
            dual, primal = h @ z + lin + g.T @ share, g @ z + c + slack
            if mu < 1e-13 and np.abs(dual).max() < 1e-11:
                break
            comp = slack * share - 0.1 * mu
            left, right = h + g.T @ ((share / slack)[:, None] * g), -dual - g.T @ ((share * primal - comp) / slack)
            dz = np.linalg.lstsq(left, right, rcond=None)[0]
            ds = -primal - g @ dz
            dl = -(comp + share * ds) / slack
            step = min([1.0, *(-0.99 * slack[ds < 0] / ds[ds < 0]), *(-0.99 * share[dl < 0] / dl[dl < 0])])
            z, slack, share = z + step * dz, slack + step * ds, share + step * dl
        place = z[:-1]
        self.bound = max(self.bound, float((a @ place + c).max() + self.regular / 2 * place[:-1] @ place[:-1] - slack @ share) - 1e-9)
        return place
