"""Hard negatives against brute force: many shards and groups, packed fields of all kinds, ties, and the cases of a table."""

import math
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

pytest.importorskip("assaylake.llm.queries")
from assaylake.llm import hardneg, queries

SCHEMA = "vec_id long, embedding array<double>, label int"


def brute(rows, is_anchor, k=5, scale=256):
    able = [(i, [math.floor(scale * x) for x in v], c) for i, v, c in rows if i is not None and c is not None and v and all(x is not None and math.isfinite(x) for x in v)]
    out = []
    for a, va, ca in able:
        if not is_anchor(a):
            continue
        scored = [(sum(x * y for x, y in zip(va, v, strict=True)), i, c) for i, v, c in able if len(v) == len(va)]
        scored.sort(key=lambda s: (-s[0], s[1]))
        for ps, p, _ in [s for s in scored if s[2] == ca and s[1] != a][:k]:
            fit = [s for s in scored if s[2] != ca and 80 * ps <= 100 * s[0] <= 100 * ps][:k]
            out += [(a, p, n + 1, i, ps, ns) for n, (ns, i, _) in enumerate(fit)]
    return sorted(out)


def mined(df, of=10, **rule):
    return sorted(tuple(r) for r in hardneg.mine(df, F.col("vec_id") % of == 0, **rule).collect())


def clusters(n=600, size=12, seed=11):
    rng = np.random.default_rng(seed)
    middle = rng.standard_normal((8, size))
    rows = middle[rng.integers(0, 8, n)] + 0.4 * rng.standard_normal((n, size))
    return [(i, [float(x) for x in v / np.linalg.norm(v)], int(rng.integers(0, 5)) if i % 3 else 2) for i, v in enumerate(rows)]  # one label holds more than a third


@pytest.mark.parametrize(("shard", "group"), [(8192, 1 << 18), (16, 7)])
def test_equals_brute_force(spark, monkeypatch, shard, group):
    monkeypatch.setattr(hardneg, "GROUP", group)
    rows = clusters()
    df = spark.createDataFrame(rows, SCHEMA).repartition(3)
    want = brute(rows, lambda i: i % 10 == 0)
    assert len(want) > 500 and mined(df, shard=shard) == want


def test_ties_and_a_very_common_vector(spark):
    rows = clusters(200, 4) + [(1000 + i, [0.5, 0.5, 0.5, 0.5], i % 4) for i in range(200)]
    df = spark.createDataFrame(rows, SCHEMA)
    assert mined(df, shard=32) == brute(rows, lambda i: i % 10 == 0)


@pytest.mark.parametrize("size", [1.0, 30.0, 5000.0, 1e6, 3e14])
def test_wide_components(spark, size):
    rng = np.random.default_rng(5)
    rows = [(i, [float(x) * (size if i % 4 else 1) for x in rng.standard_normal(6) + 1], i % 3) for i in range(80)]
    got = [] if size > 1e12 else mined(spark.createDataFrame(rows, SCHEMA), shard=32)
    if size > 1e12:
        with pytest.raises(Exception, match="beyond a long"):
            mined(spark.createDataFrame(rows, SCHEMA))
    else:
        assert got == brute(rows, lambda i: i % 10 == 0)


def test_fields_hold_exact_products():
    rng = np.random.default_rng(1)
    for top in (3, 200, 2_000, 1 << 22, 1 << 50):
        rows = rng.integers(-top, top + 1, (101, 16)).astype(float)
        rows[0], rows[1] = top, -top
        anchors = rng.integers(-top, top + 1, (9, 16)).astype(float)
        anchors[0], anchors[1] = -top, top
        shard = hardneg.Packed(np.arange(101), np.zeros(101, int), rows)
        want = np.array([[int(x) for x in r] for r in anchors], object) @ np.array([[int(x) for x in r] for r in rows], object).T
        kinds = set()
        for some, bits in shard.parts(anchors):
            quick = bits <= hardneg.BITS // 2
            kinds.add(quick)
            if quick:
                assert hardneg.BITS // bits >= 2 and (shard.scores(anchors[some], bits) == want[some].astype(np.int64)).all()
            assert (shard.wide_scores(anchors[some[0]], bits) == want[some[0]]).all()
        assert kinds == {top < 2_000}


def test_cases_of_a_table(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(0, [1.0, 0.0], 1), (1, [0.9, 0.0], 1), (1, [0.9, 0.0], 1), (2, [0.85, 0.1], 2), (3, [0.8, 0.1], 3), (3, [0.8, 0.1], 3), (10, [-1.0, 0.0], 1), (20, [0.0, 0.0], 2), (21, [0.0, 0.0], 2), (30, [1.0, 1.0, 1.0], 1), (31, [1.0, 1.0, 1.0], 1), (32, [1.0, 1.0, 0.9], 2)]
    odd = [(None, [1.0, 0.0], 1), (40, None, 1), (50, [1.0, 0.0], None), (60, [], 1), (70, [1.0, None], 1), (80, [nan, 1.0], 2), (90, [inf, 1.0], 2)]
    df = spark.createDataFrame([(*r, 7, "x", r[0]) for r in rows + odd], SCHEMA + ", size int, class string, row long")
    want = brute(rows, lambda i: i % 10 == 0)
    assert want and mined(df) == want
    assert mined(df.limit(0)) == [] and mined(df.where("label = 1")) == [] and mined(df.where("vec_id % 10 <> 0")) == []
    one = spark.createDataFrame(rows, SCHEMA)
    twice = one.unionByName(one)
    assert mined(twice) == brute(rows + rows, lambda i: i % 10 == 0)


def test_no_all_pairs_plan(spark, sf):
    plan = queries.op11_hard_negatives(spark, sf)._jdf.queryExecution().toString()
    assert not re.search("CartesianProduct|BroadcastNestedLoopJoin", plan)
