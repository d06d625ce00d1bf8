"""Nearest-neighbour tables, DBSCAN and components against brute force, over many units, rings and whole bundles."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from assaylake.operators import graph, metric, models


def frame(spark, rows, kind="array<double>"):
    return spark.createDataFrame([(i, None if v is None else [None if x is None else float(x) for x in v]) for i, v in enumerate(rows)], f"hash long, e {kind}")


def blobs(n, groups, size, noise, seed=1):
    rng = np.random.default_rng(seed)
    middle = 4 * rng.standard_normal((groups, size))
    return middle[rng.integers(0, groups, n)] + noise * rng.standard_normal((n, size))


def brute_graph(rows, k):
    out = []
    for i, x in enumerate(rows):
        d = np.round(np.sqrt(((rows - x) ** 2).sum(1)), 9)
        order = [j for j in np.lexsort((np.arange(len(rows)), d)) if j != i][:k]
        out += [(i, int(j), n + 1, float(d[j])) for n, j in enumerate(order)]
    return sorted(out)


def brute_dbscan(rows, eps, least):
    near = np.array([((rows - x) ** 2).sum(1) <= eps * eps for x in rows])
    core = near.sum(1) >= least
    label = np.where(core, np.arange(len(rows)), len(rows))
    while True:
        new = np.where(core, np.where(near & core, label, len(rows)).min(1), len(rows))
        if (new == label).all():
            break
        label = new
    side = np.where(near & core, label, len(rows)).min(1)
    found = np.where(core, label, side)
    return [(i, bool(c), int(f) if f < len(rows) else -1) for i, (c, f) in enumerate(zip(core, found, strict=True))]


@pytest.mark.parametrize(("size", "unit"), [(2, 64), (64, 50)])
def test_knn_graph(spark, monkeypatch, size, unit):
    monkeypatch.setattr(metric, "PIVOTS", 12)  # so that cells have rings and several units
    rows = np.concatenate([blobs(500, 9, size, 0.3), np.random.default_rng(2).standard_normal((100, size)), np.zeros((150, size))])
    got = sorted(map(tuple, metric.knn_graph(frame(spark, rows).repartition(3), "hash", ["e"], 6, unit).collect()))
    assert got == brute_graph(rows, 6)


def test_knn_graph_of_few_and_odd_rows(spark):
    rows = [[1.0, 2.0], [1.0, 2.5], None, [], [None, 1.0], [float("nan"), 1.0], [float("inf"), 0.0]]
    assert sorted(map(tuple, metric.knn_graph(frame(spark, rows), "hash", ["e"], 3).collect())) == [(0, 1, 1, 0.5), (1, 0, 1, 0.5)]
    df = frame(spark, [[1.0]])
    assert metric.knn_graph(df, "hash", ["e"]).collect() == [] and metric.knn_graph(df.limit(0), "hash", ["e"]).collect() == []
    named = spark.createDataFrame([(f"k{i}", float(i * i), 0.0) for i in range(5)], "hash string, a double, vector double")
    assert [r["dst"] for r in metric.knn_graph(named, "hash", ["a", "vector"], 1).orderBy("src").collect()] == ["k1", "k0", "k1", "k2", "k3"]


def test_affinity_weighs_mutual_neighbours(spark):
    rows = np.array([[0.0], [1.0], [1.5], [9.0]])
    got = sorted(map(tuple, metric.affinity(metric.knn_graph(frame(spark, rows), "hash", ["e"], 1)).collect()))
    assert got == [(0, 1, 0.5), (1, 2, 1.0), (2, 3, 0.5)]


@pytest.mark.parametrize(("eps", "least", "unit"), [(0.5, 5, 32), (3.0, 8, 32), (40.0, 3, 4096)])
def test_dbscan_in_many_dimensions(spark, monkeypatch, eps, least, unit):
    monkeypatch.setattr(metric, "PIVOTS", 16)
    rows = np.concatenate([blobs(300, 6, 16, 0.25), blobs(60, 3, 16, 0.01, 5), np.random.default_rng(3).standard_normal((60, 16)) * 3, np.tile(np.arange(16.0), (150, 1))])
    got = sorted(map(tuple, metric.dbscan(frame(spark, rows).repartition(3), ["e"], eps, least, unit=unit).collect()))
    assert got == brute_dbscan(rows, eps, least)


def test_dbscan_on_a_chain_with_border_points(spark):
    rows = np.array([[0.4 * i, 0.0] for i in range(120)] + [[200.0 + 0.4 * i, 0.0] for i in range(40)] + [[-0.45, 0.0], [500.0, 1.0]])
    got = sorted(map(tuple, metric.dbscan(frame(spark, rows), ["e"], 0.5, 3, unit=16).collect()))
    assert got == brute_dbscan(rows, 0.5, 3) and {c for *_, c in got} == {-1, 0, 121}


def test_dbscan_of_odd_rows_and_clashing_names(spark):
    df = spark.createDataFrame([(1, 0.0, 0.0), (2, 0.1, None), (3, 0.1, 0.0), (4, 0.0, float("nan")), (None, 0.0, 0.0)], "a long, b double, core double")
    got = sorted(map(tuple, metric.dbscan(df, ["b", "core"], 0.2, 2, key="a").collect()), key=repr)
    assert got == sorted([(1, True, 1), (3, True, 1), (2, False, -1), (4, False, -1), (None, False, -1)], key=repr)
    assert metric.dbscan(df.limit(0), ["b", "core"], 0.2, 2, key="a").collect() == []


@pytest.mark.parametrize("shape", ["dense", "spread"])
def test_links_of_dbscan_are_no_pairs(spark, monkeypatch, shape):
    made = []
    monkeypatch.setattr(metric, "written", lambda df, name: made.append((name, out := df.checkpoint())) or out)
    monkeypatch.setattr(metric, "PIVOTS", 8)
    rows = np.random.default_rng(4).standard_normal((800, 3)) * (0.1 if shape == "dense" else 1)
    metric.dbscan(frame(spark, rows), ["e"], 0.9, 4, unit=64).collect()
    near = sum(int((((rows - x) ** 2).sum(1) <= 0.81).sum()) for x in rows)
    sizes = {name: df.count() for name, df in made if name in ("dbscan-links", "dbscan-visits")}
    assert sizes["dbscan-links"] < 8 * len(rows) and near > 40 * len(rows)


@pytest.mark.parametrize("order", ["rising", "mixed"])
def test_components_of_chains_stars_and_odd_links(spark, order):
    n = 120
    ids = {"rising": np.arange(n), "mixed": np.random.default_rng(6).permutation(n)}[order].tolist()
    links = list(zip(ids, ids[1:], strict=False)) + [(1000, k) for k in range(1001, 1100)] + [(2000, 2000), (None, 5), (7, None), (ids[3], ids[4])]
    got = {r["node"]: r["component"] for r in graph.components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert got == dict.fromkeys(range(n), 0) | dict.fromkeys(range(1000, 1100), 1000) | {2000: 2000}
    assert graph.components(spark.createDataFrame([], "a long, b long")).collect() == []


def test_spectral_separates_rings_and_blobs(spark):
    rng = np.random.default_rng(8)
    turn = 2 * np.pi * np.arange(40) / 40
    ring = np.stack([np.cos(turn), np.sin(turn), *np.zeros((6, 40))], 1) * 3
    inner = ring / 3 + 0.01 * rng.standard_normal(ring.shape)
    rows = np.concatenate([ring, inner])
    far = models.cluster(frame(spark, rows).select("hash", *(F.col("e")[i].alias(f"e{i}") for i in range(8))), [f"e{i}" for i in range(8)], 2)
    assert len({r["cluster"] for r in far.where("hash < 40").collect()}) == 2  # no centroids tell the rings apart
    got = {r["id"]: r["cluster"] for r in models.spectral(frame(spark, rows), "hash", ["e"], 2, neighbours=6).collect()}
    assert len({got[i] for i in range(40)}) == 1 == len({got[40 + i] for i in range(40)}) and got[0] != got[40]
    rows = np.concatenate([3 * rng.standard_normal(8) + 0.5 * rng.standard_normal((30, 8)) for k in range(4)])
    got = {r["id"]: r["cluster"] for r in models.spectral(frame(spark, rows), "hash", ["e"], 4).collect()}
    assert [len({got[30 * k + i] for i in range(30)}) for k in range(4)] == [1] * 4 and len(set(got.values())) == 4


def test_spectral_embedding_equals_the_eigenvectors(spark):
    rows = blobs(60, 3, 4, 1.5)
    edges = metric.affinity(metric.knn_graph(frame(spark, rows), "hash", ["e"], 8)).checkpoint()
    dense = np.zeros((60, 60))
    for a, b, w in edges.collect():
        dense[a, b] = dense[b, a] = w
    scale = dense.sum(1) ** -0.5
    value, vector = np.linalg.eigh(scale[:, None] * dense * scale)
    got = np.array([r["features"].toArray() for r in models.spectral_embedding(edges, 3, rounds=40).orderBy("id").collect()])
    want = vector[:, -3:] / np.linalg.norm(vector[:, -3:], axis=1)[:, None]
    assert np.allclose(got @ got.T, want @ want.T, atol=1e-3)


def test_visitors_are_sent_some_at_a_time(monkeypatch):
    monkeypatch.setattr(metric, "SENT", 64)
    batch = pd.DataFrame({"key": np.arange(5), "vector": list(np.ones((5, 16)))})
    row, unit = np.repeat(np.arange(5), 20), np.tile(np.arange(20), 5)  # each visits every unit
    sent = list(metric._sent(batch, row, unit, made=None))
    assert max(map(len, sent)) == 4 and sum(map(len, sent)) == 100
    whole = pd.concat(sent)
    assert list(zip(whole.key, whole.unit, strict=True)) == list(zip(row, unit, strict=True)) and list(whole.columns) == ["key", "vector", "unit", "made"]


@pytest.mark.parametrize("scale", [1.0, 1e-9, 1e30])
def test_single_precision_only_screens(scale):
    rng = np.random.default_rng(9)
    held, asked = scale * rng.standard_normal((300, 8)), scale * rng.standard_normal((40, 8))
    asked[:20] = held[:20] + scale * 1e-7 * rng.standard_normal((20, 8))  # nearer than single precision tells
    exact = ((asked[:, None] - held) ** 2).sum(2)
    for eps in (float(np.sqrt(exact[3, 3])), float(np.sqrt(np.median(exact)))):
        assert (metric._within(asked, metric.Held(held), eps) == (exact <= eps * eps)).all()
    rows, visitors = pd.DataFrame({"key": np.arange(300), "vector": list(held)}), pd.DataFrame({"key": np.arange(1000, 1040), "vector": list(asked)})
    limit = np.round(np.sqrt(np.sort(exact, 1)[:, 2]), 9)
    got = [(q, m) for n, some, _ in metric._best(rows, visitors, 5, limit) for q, m in zip(n.tolist(), some.tolist(), strict=True)]
    near = np.round(np.sqrt(exact), 9)
    assert got == [(q, int(m)) for q in range(40) for m in np.lexsort((np.arange(300), near[q]))[:5] if near[q, m] <= limit[q]]  # what is beyond the limit goes no further
