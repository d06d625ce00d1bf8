"""Exact centroid clustering of integer vectors, with lower bounds by Ptolemy's inequality over fixed pivot pairs.

Of any four points p, s, x, c of a Euclidean space d(x, c) d(p, s) >= |d(x, p) d(c, s) - d(x, s) d(c, p)|. The pivots are the centroids that the rounds begin with; a
vector's distances to them are computed once and kept beside it. In each round the bounds of all centroids follow from those and from the
few distances between centroids and pivots. The centroid of the least bound is measured first; of the others only those whose bound, rounded down, does
not lie above the best distance found so far are measured, in whole numbers. So no assignment depends on rounding.

Plan: one narrow pass makes the table of vectors with their pivot distances; each round is one pass over it that hands on sums and counts,
one row for each task, cluster and component, which Spark adds up; centroids are a few vectors on the driver.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from decimal import Decimal
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from assaylake.llm.shared import written
from assaylake.llm.vectors import sound

#: Below this size of components, 64-bit integers hold all squared distances of up to 64 of them; numbers from TOO_LARGE on are refused.
TAME, TOO_LARGE, LONG = 1 << 27, 1 << 62, 1 << 63
#: What the bounds allow for, relative to the terms that they are made of; components of a tame vector at most.
SLACK, MOST = 1e-9, 64


class Pivots:
    """The pivots and the pairs of them that differ."""

    def __init__(self, points: list[list[int]]):
        self.points = np.array(points, np.float64)
        self.between = self.away(self.points)
        self.pairs = [(p, s) for p, s in combinations(range(len(points)), 2) if self.between[p, s] > 0]

    def away(self, rows: np.ndarray) -> np.ndarray:
        """(rows, pivots): distances in double precision."""
        return np.stack([np.sqrt(((rows - p) ** 2).sum(1)) for p in self.points], 1)

    def bounds(self, rows: np.ndarray, centroids: np.ndarray) -> np.ndarray:
        """(rows, centroids): numbers that no distance between the two lies below; both are given by their distances to the pivots."""
        low = np.zeros((len(rows), len(centroids)))
        for p, s in self.pairs:
            one, two = rows[:, p, None] * centroids[:, s], rows[:, s, None] * centroids[:, p]
            np.maximum(low, (np.abs(one - two) - SLACK * (one + two)) / self.between[p, s], out=low)
        return low * (1 - SLACK)


class Centroids:
    """The centroids of a round, and the nearest of them for rows of whole numbers."""

    def __init__(self, points: list[list[int]], pivots: Pivots):
        self.points, self.pivots = points, pivots
        self.away = pivots.away(np.array(points, np.float64))
        self.exact = np.array(points, object)
        self.tame = len(points[0]) <= MOST and all(abs(x) < TAME for p in points for x in p)

    def nearest(self, rows: np.ndarray, away: np.ndarray, tally: dict | None = None) -> tuple[np.ndarray, np.ndarray]:
        """(centroid, squared distance) of each row: int64 rows are tame ones, others are whole numbers of any size. away: their distances to the pivots."""
        quick = self.tame and rows.dtype == np.int64
        points = self.exact.astype(np.int64) if quick else self.exact

        def squared(some: np.ndarray, point: np.ndarray) -> np.ndarray:
            apart = some - point
            return (apart * apart).sum(1)

        low = self.pivots.bounds(away, self.away)
        first = low.argmin(1)
        best = squared(rows if quick else rows.astype(object), points[first])
        found, measured = first.astype(np.int64), len(rows)
        low *= low  # bounds of squared distances
        for c in range(len(points)):
            reach = best.astype(np.float64) * (1 + SLACK)
            open_ = np.flatnonzero((first != c) & (low[:, c] <= reach))
            if len(open_):
                to = squared(rows[open_] if quick else rows[open_].astype(object), points[c])
                better = (to < best[open_]) | ((to == best[open_]) & (c < found[open_]))
                best[open_[better]], found[open_[better]] = to[better], c
                measured += len(open_)
        if tally is not None:
            tally["measured"], tally["pairs"] = tally.get("measured", 0) + measured, tally.get("pairs", 0) + len(rows) * len(points)
        return found, best


def _whole(flat: np.ndarray, size: int, scale: int) -> np.ndarray:
    """floor(scale * x) of each component, as float64."""
    with np.errstate(over="ignore"):
        rows = np.floor(flat.astype(np.float64) * scale).reshape(-1, size)
    if len(rows) and np.abs(rows).max() >= TOO_LARGE:
        raise OverflowError("components from 2^62 on have no distances that a long holds")
    return rows


def _columns(batch: pa.RecordBatch, size: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(places, rows, distances to the pivots) of the tame vectors of a batch and of the others."""
    raw = batch.column("v").to_pylist()
    away = np.frombuffer(b"".join(batch.column("away").to_pylist()), "<f8").reshape(len(raw), -1)
    tame = np.fromiter((len(v) == 4 * size for v in raw), bool, len(raw))
    for kind, dtype in ((True, "<i4"), (False, "<f8")):
        at = np.flatnonzero(tame == kind)
        if len(at):
            rows = np.frombuffer(b"".join([raw[n] for n in at]), dtype).reshape(len(at), size)
            yield at, rows.astype(np.int64) if kind else np.array([[int(x) for x in r] for r in rows.tolist()], object), away[at]


def _prepared(rows: DataFrame, size: int, scale: int, pivots: Pivots) -> DataFrame:
    """(vec_id, v, away): whole numbers and pivot distances of each vector, as bytes."""

    def prepare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            whole = _whole(batch.column(1).flatten().to_numpy(zero_copy_only=False), size, scale)
            tame = np.abs(whole).max(1, initial=0) < (TAME if size <= MOST else 0)
            some = [(row.astype("<i4") if t else row.astype("<f8")).tobytes() for row, t in zip(whole, tame, strict=True)]
            away = [d.tobytes() for d in pivots.away(whole).astype("<f8")]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(some, pa.binary()), pa.array(away, pa.binary())], ["vec_id", "v", "away"])

    return rows.mapInArrow(prepare, "vec_id long, v binary, away binary")


def _sums(table: DataFrame, centroids: Centroids, size: int) -> dict[int, tuple[int, list[int]]]:
    """Count and component sums of each cluster that has members; one row for each cluster and component reaches the driver."""
    k = len(centroids.points)

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count, sums = [0] * k, np.zeros((k, size), object)
        for batch in batches:
            for _, rows, away in _columns(batch, size):
                near, _ = centroids.nearest(rows, away)
                for c in np.unique(near).tolist():
                    mine = rows[near == c]
                    count[c] += len(mine)
                    sums[c] += mine.sum(0).astype(object)
        some = [c for c in range(k) if count[c]]
        yield pa.RecordBatch.from_pydict(
            {
                "cluster": pa.array(np.repeat(some, size).astype("i4"), pa.int32()),
                "place": pa.array(list(range(size)) * len(some), pa.int32()),
                "n": pa.array(np.repeat([count[c] for c in some], size).astype("i8"), pa.int64()),
                "total": pa.array([Decimal(x) for c in some for x in sums[c].tolist()], pa.decimal128(38, 0)),
            }
        )

    added = table.mapInArrow(add, "cluster int, place int, n long, total decimal(38,0)").groupBy("cluster", "place").agg(F.sum("n").alias("n"), F.sum("total").alias("total"))
    out: dict[int, tuple[int, list[int]]] = {}
    for r in sorted(added.collect()):  # k * size rows
        out.setdefault(r["cluster"], (r["n"], []))[1].append(int(r["total"]))
    return out


def cluster(rows: DataFrame, k: int = 8, rounds: int = 10, size: int = 64, scale: int = 1024, seed: int = 3, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """(vec_id, cluster, distance, cluster_inertia, inertia, centroid_sha256) for each vector of `size` components, all finite.

    Components become floor(scale * x). Centroids start as the k vectors (all, if fewer) with the smallest sha256 of `seed:vec_id`, in that order; vectors that share a vec_id
    follow each other by their components. Each round assigns every vector to the nearest centroid (squared distance; ties: the smaller number) and
    replaces each centroid that has members by the floor of their mean; vectors are then assigned once more. Sums and distances are whole numbers throughout.

    Vectors of another size, null ones and those with null or non-finite components are left out. Rows with a null vec_id are assigned and
    counted but start no centroid; where there is no other row the result is empty, as for an empty table. Repeated rows are vectors of their own. Other columns,
    whatever their names, are not read. Components of 2^62 or more, and distances beyond a long, are errors.
    """
    spark = rows.sparkSession
    schema = "vec_id long, cluster int, distance long, cluster_inertia long, inertia long, centroid_sha256 string"
    named = rows.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vector_col).alias("vector")).where((F.size("vector") == size) & sound(F.col("vector")))
    name = F.sha2(F.concat(F.lit(f"{seed}:"), F.col("vec_id").cast("string")), 256)
    starts = named.where("vec_id IS NOT NULL").withColumn("name", name).orderBy("name", "vector").limit(k).collect()
    if not starts:
        return spark.createDataFrame([], schema)
    points = [[int(x) for x in _whole(np.array(r["vector"]), size, scale)[0]] for r in starts]
    pivots = Pivots(points)
    table = written(_prepared(named, size, scale, pivots), "pivot-distances")
    for _ in range(rounds):
        found = _sums(table, Centroids(points, pivots), size)
        new = [[s // found[c][0] for s in found[c][1]] if c in found else p for c, p in enumerate(points)]
        if new == points:  # all later rounds would repeat this one
            break
        points = new
    centroids = Centroids(points, pivots)

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            near, distance = np.zeros(batch.num_rows, np.int64), np.zeros(batch.num_rows, np.int64)
            for at, some, away in _columns(batch, size):
                near[at], found = centroids.nearest(some, away)
                if found.max() >= LONG:
                    raise OverflowError(f"a squared distance is beyond a long: {found.max()}")
                distance[at] = found.astype(np.int64)
            yield pa.RecordBatch.from_arrays([batch.column("vec_id"), pa.array(near.astype("i4")), pa.array(distance)], ["vec_id", "cluster", "distance"])

    assigned = written(table.mapInArrow(assign, "vec_id long, cluster int, distance long"), "assigned")
    inertia = {r["cluster"]: int(r["total"]) for r in assigned.groupBy("cluster").agg(F.sum(F.col("distance").cast("decimal(38,0)")).alias("total")).collect()}  # k rows
    told = lambda value: F.create_map(*(F.lit(x) for c in sorted(inertia) for x in (c, value(c))))[F.col("cluster")] if inertia else F.lit(None)
    digest = [hashlib.sha256(",".join(map(str, p)).encode()).hexdigest() for p in points]
    return assigned.select("vec_id", "cluster", "distance", told(lambda c: str(inertia[c])).cast("long").alias("cluster_inertia"), F.lit(str(sum(inertia.values()))).cast("long").alias("inertia"), told(lambda c: digest[c]).alias("centroid_sha256"))
