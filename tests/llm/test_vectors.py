"""Pivots, rings and bounds: nothing is lost, and clustered vectors are met in few places."""

import numpy as np
import pytest

pytest.importorskip("assaylake.llm.queries")
from assaylake.llm import mtree, rabitq, vectors


def clustered(n=4000, centres=20, size=24, noise=0.05, seed=1):
    rng = np.random.default_rng(seed)
    middle = rng.standard_normal((centres, size)) * 3
    return middle[rng.integers(0, centres, n)] + noise * rng.standard_normal((n, size))


def frame(spark, rows):
    return spark.createDataFrame([(i, [float(x) for x in v]) for i, v in enumerate(rows)], "vec_id long, embedding array<double>")


def brute(rows, queries, k=5):
    ints = np.floor(256 * rows)
    out = []
    for q in queries:
        score = ints @ ints[q]
        order = [i for i in np.lexsort((np.arange(len(rows)), -score)) if i != q][:k]
        out += [(q, n + 1, int(i), int(score[i])) for n, i in enumerate(order)]
    return sorted(out)


def test_search_over_many_shards(spark, monkeypatch):
    monkeypatch.setattr(mtree, "QUERIES", 40)
    rows = np.concatenate([clustered(900, 6), np.random.default_rng(2).standard_normal((300, 24)), np.tile(np.arange(24.0), (400, 1))])  # clusters, noise, a third equal
    df = frame(spark, rows).repartition(3)
    got = sorted(tuple(r) for r in mtree.top_k(df, df.where("vec_id % 10 = 0"), shard=64).collect())
    assert got == brute(rows, range(0, len(rows), 10))


def test_clustered_vectors_need_few_products():
    rows = np.floor(256 * clustered())
    tree = mtree.MTree(np.arange(len(rows)), rows, leaf=64)
    computed = sum(tree.search(rows[q], q, 5)[1] for q in range(0, len(rows), 50))
    assert computed < 0.35 * len(rows) * len(range(0, len(rows), 50))
    floor = sorted(rows @ rows[0])[-6]
    assert tree.search(rows[0], 0, 5, floor)[0] == tree.search(rows[0], 0, 5)[0] and tree.search(rows[0], 0, 5, floor)[1] <= tree.search(rows[0], 0, 5)[1]


def test_groups_hold_all_rows_and_bounds_hold(spark):
    rows = clustered(1500, 8)
    df = frame(spark, rows).selectExpr("vec_id", "embedding AS vector", "size(embedding) AS size")
    away = lambda points, pivots: np.sqrt(np.maximum(((points[:, None] - pivots) ** 2).sum(2), 0)) + 1e-6
    dealt, groups = vectors.deal(df, "vec_id", lambda x: x, away, 50, "test-groups")
    placed = dealt.toPandas()
    assert sorted(placed.vec_id) == list(range(1500)) and len(groups.table) > 8
    names, blocks, most = mtree.bounds(np.floor(256 * rows[:40]), groups, 24)
    visited = 0
    for n, group in enumerate(names):
        mine = placed[placed.group == group]
        assert mine.block.nunique() <= blocks[n]
        score = np.floor(256 * rows[:40]) @ np.floor(256 * rows[mine.vec_id.to_numpy()]).T
        assert (score <= most[:, [n]]).all()
    ints = np.floor(256 * rows)
    floor = np.sort(ints[:40] @ ints.T, axis=1)[:, -6]
    visited = (most >= floor[:, None]).mean()
    assert visited < 0.5  # of the groups, for queries that know a good floor


def components_of(n, links):
    label = list(range(n))
    for _ in range(n):
        before = label[:]
        for a, b in links:
            label[a] = label[b] = min(label[a], label[b])
        if label == before:
            break
    return label


def test_links_over_many_blocks(spark):
    rng = np.random.default_rng(8)
    rows = np.concatenate([clustered(160, 10, 12, 0.3), rng.standard_normal((60, 12)), np.tile(rng.standard_normal(12), (90, 1)), 1e200 * clustered(20, 2, 12, 0.1), 1e-200 * clustered(20, 2, 12, 0.1, 3)])
    ids = [*range(len(rows) - 3), 5, 5, 7]  # ids that several vectors share
    df = spark.createDataFrame([(i, [float(x) for x in v], "clash") for i, v in zip(ids, rows, strict=True)], "vec_id long, embedding array<double>, rep string").repartition(3)
    got = sorted(tuple(r) for r in rabitq.near_duplicates(df, block=16).collect())
    points = rabitq.unit(rows)
    near = points @ points.T >= 0.95
    links = [(a, b) for a, b in np.argwhere(near).tolist() if a != b]
    label = components_of(len(rows), links)
    smallest = {c: min(ids[i] for i in range(len(rows)) if label[i] == c) for c in set(label)}
    assert got == sorted((ids[i], int(near[i].sum()) - 1, smallest[label[i]], ids[i] == smallest[label[i]]) for i in range(len(rows)))
    assert rabitq.near_duplicates(df.limit(0)).count() == 0
    with pytest.raises(ValueError):
        rabitq.near_duplicates(df, threshold=0)


def block_of(rows):
    vector = rabitq.unit(rows)
    bits, factor, turned = rabitq.coded(vector, rabitq.rotation(rows.shape[1]))
    return {"cid": np.arange(len(rows)), "n": np.ones(len(rows), int), "vector": vector, "norm": np.linalg.norm(vector, axis=1), "bits": bits, "factor": factor, "turned": turned}


def test_few_pairs_are_recomputed():
    for rows in (np.random.default_rng(4).standard_normal((1500, 64)), clustered(1500, 30, 64, 0.4)):
        block, tally = block_of(rows), {}
        found = {(a, b) for i, j in rabitq.near_pairs(block, block, 0.95, True, tally=tally) for a, b in zip(i.tolist(), j.tolist(), strict=True)}
        cosine = block["vector"] @ block["vector"].T
        want = {(a, b) for a, b in np.argwhere(cosine >= 0.95).tolist() if a < b}
        assert found == want and tally["pairs"] == 1500 * 1499 // 2
        assert tally["exact"] < len(want) + 0.02 * tally["pairs"]


def test_rings_that_hold_no_link_do_not_meet(spark):
    rows = clustered(2000, 40, 16, 0.2)
    df = frame(spark, rows).selectExpr("vec_id AS cid", "embedding AS vector", "size(embedding) AS size", "1L AS n")
    away = lambda points, pivots: np.arccos(np.clip(points @ pivots.T, -1, 1))
    dealt, groups = vectors.deal(df, "cid", rabitq.unit, away, 32, "test-angles")
    placed = dealt.toPandas().set_index("cid").group
    pairs = {(g, h) for g, _, h, _ in rabitq.meeting(groups, 0.95)} | {(h, g) for g, _, h, _ in rabitq.meeting(groups, 0.95)}
    points = rabitq.unit(rows)
    assert all((placed[a], placed[b]) in pairs for a, b in np.argwhere(points @ points.T >= 0.95).tolist())
    assert len(pairs) < 0.3 * len(groups.table) ** 2


@pytest.mark.parametrize("together", [1, 3])
def test_a_tree_or_block_sent_once_for_several_partners(spark, monkeypatch, together):
    monkeypatch.setattr(mtree, "QUERIES", 20)
    monkeypatch.setattr(mtree, "TOGETHER", together)
    monkeypatch.setattr(rabitq, "TOGETHER", together)
    rows = np.concatenate([clustered(300, 4), np.random.default_rng(3).standard_normal((60, 24))])
    df = frame(spark, rows)
    assert sorted(tuple(r) for r in mtree.top_k(df, df.where("vec_id % 4 = 0"), shard=64).collect()) == brute(rows, range(0, len(rows), 4))
    points = rabitq.unit(rows)
    near = points @ points.T >= 0.95
    links = {r.vec_id: r.n_links for r in rabitq.near_duplicates(df, block=32).collect()}
    assert links == {i: int(near[i].sum()) - 1 for i in range(len(rows))}


def test_pivots_grow_and_groups_stay_bounded(spark, monkeypatch):
    monkeypatch.setattr(vectors, "PIVOTS", 24)
    monkeypatch.setattr(vectors, "GROUPS", 48)
    df = frame(spark, clustered(1200, 10, 16, 0.3)).selectExpr("vec_id AS cid", "embedding AS vector", "size(embedding) AS size", "1L AS n")
    away = lambda points, pivots: np.arccos(np.clip(points @ pivots.T, -1, 1))
    dealt, groups = vectors.deal(df, "cid", rabitq.unit, away, 16, "test-bounds")
    assert dealt.count() == 1200 and 8 < len(groups.table) <= 48 + 1
    assert len(groups.pivots[16]) > 8
