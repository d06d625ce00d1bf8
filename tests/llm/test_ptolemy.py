"""Centroid clustering against plain rounds in whole numbers, bounds that hold and rule centroids out, and the cases of a table."""

import hashlib
import math

import numpy as np
import pytest

pytest.importorskip("assaylake.llm.queries")
from assaylake.llm import ptolemy

SCHEMA = "vec_id long, embedding array<double>"


def brute(rows, k=8, rounds=10, size=64, scale=1024):
    kept = [(i, [math.floor(scale * x) for x in v], v) for i, v in rows if v and len(v) == size and all(x is not None and math.isfinite(x) for x in v)]
    starts = sorted((hashlib.sha256(f"3:{i}".encode()).hexdigest(), v, e) for i, e, v in kept if i is not None)[:k]
    points = [e for _, _, e in starts]
    if not points:
        return []
    away = lambda e, p: sum((x - y) ** 2 for x, y in zip(e, p, strict=True))
    near = lambda e: min((away(e, p), c) for c, p in enumerate(points))
    for _ in range(rounds):
        found = [near(e)[1] for _, e, _ in kept]
        points = [[sum(x) // len(x) for x in zip(*mine, strict=True)] if (mine := [e for (_, e, _), f in zip(kept, found, strict=True) if f == c]) else p for c, p in enumerate(points)]
    last = [near(e) for _, e, _ in kept]
    per = {c: sum(d for d, f in last if f == c) for c in range(len(points))}
    digest = [hashlib.sha256(",".join(map(str, p)).encode()).hexdigest() for p in points]
    return sorted(((i, c, d, per[c], sum(per.values()), digest[c]) for (i, _, _), (d, c) in zip(kept, last, strict=True)), key=repr)


def clustered(df, **rule):
    return sorted((tuple(r) for r in ptolemy.cluster(df, **rule).collect()), key=repr)


def blobs(n=300, size=64, groups=12, noise=0.2, seed=12):
    rng = np.random.default_rng(seed)
    middle = rng.standard_normal((groups, size))
    return middle[rng.integers(0, groups, n)] + noise * rng.standard_normal((n, size))


def test_equals_plain_rounds(spark):
    rows = [(i, [float(x) for x in v]) for i, v in enumerate(blobs())]
    rows += [(1000 + i, rows[0][1]) for i in range(200)]  # a very common vector
    assert clustered(spark.createDataFrame(rows, SCHEMA).repartition(5)) == brute(rows)


@pytest.mark.parametrize("scale", [3e4, 2e5])
def test_components_of_any_size(spark, scale):
    rows = [(i, [float(x) for x in v]) for i, v in enumerate(blobs(60) * np.where(np.arange(60) % 7 == 0, scale, 1)[:, None])]
    assert clustered(spark.createDataFrame(rows, SCHEMA), rounds=3) == brute(rows, rounds=3)


def test_too_large_is_an_error(spark):
    rows = [(i, [float(i * 1e8)] * 64) for i in range(12)]
    with pytest.raises(Exception, match="beyond a long"):
        clustered(spark.createDataFrame(rows, SCHEMA), k=2, rounds=1)
    with pytest.raises(Exception, match="2\\^62"):
        clustered(spark.createDataFrame([(1, [1e30] * 64)], SCHEMA))


def test_cases_of_a_table(spark):
    nan, inf = float("nan"), float("inf")
    good = [[float(x) for x in v] for v in blobs(20)]
    rows = [(i, v) for i, v in enumerate(good)] + [(0, good[0]), (0, good[5]), (None, good[3]), (None, good[4])]
    odd = [(50, None), (51, []), (52, [1.0] * 63), (53, [1.0] * 65), (54, [nan] + [0.0] * 63), (55, [inf] + [0.0] * 63), (56, [None] + [0.0] * 63)]
    df = spark.createDataFrame([(*r, 1, "x") for r in rows + odd], SCHEMA + ", cluster int, away string")
    assert clustered(df) == brute(rows)
    few = [r for r in rows if r[0] in (3, 4)]
    assert clustered(spark.createDataFrame(few, SCHEMA)) == brute(few)
    same = [(i, good[0]) for i in range(30)]
    assert clustered(spark.createDataFrame(same, SCHEMA)) == brute(same)
    assert clustered(df.limit(0)) == [] and clustered(df.where("vec_id IS NULL")) == []
    small = [(i, v[:3]) for i, v in enumerate(good)]
    assert clustered(spark.createDataFrame(small, SCHEMA), size=3, k=4) == brute(small, k=4, size=3)


def test_bounds_hold_and_save_distances():
    rows = np.floor(1024 * blobs(3000, noise=0.02))
    points = rows[:8].astype(int).tolist()
    pivots = ptolemy.Pivots(points)
    centroids = ptolemy.Centroids((rows[8:16] + 5).astype(int).tolist(), pivots)
    low = pivots.bounds(pivots.away(rows), centroids.away)
    true = np.sqrt(((rows[:, None] - np.array(centroids.points)) ** 2).sum(2))
    assert (low <= true).all() and (low > 0.2 * true).mean() > 0.2
    tally = {}
    near, best = centroids.nearest(rows.astype(np.int64), pivots.away(rows), tally)
    assert (near == true.argmin(1)).all() and (best == (true.min(1) ** 2).round()).all()
    assert tally["pairs"] == 8 * len(rows) and tally["measured"] < 0.6 * tally["pairs"]
