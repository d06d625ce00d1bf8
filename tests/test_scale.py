"""Operators that split their work: against plain Python, with the split made small."""

import math

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from assaylake.functions import content
from assaylake.operators import derive, history, metrics, models, preprocess, quality, quantiles, selection, similarity
from assaylake.sources.scratch import new_folder
from assaylake.streaming import updates


def test_quantiles_of_all_kinds(spark, monkeypatch):
    monkeypatch.setattr(quantiles, "FEW", 20)
    rng = np.random.default_rng(1)
    columns = {"a": rng.normal(size=3000), "b": rng.integers(0, 4, 3000).astype(float), "c": np.r_[np.zeros(2500), rng.exponential(size=500)], "d": np.full(3000, 7.5)}
    df = spark.createDataFrame(pd.DataFrame(columns)).withColumn("e", F.lit(None).cast("double")).withColumn("f", F.when(F.col("b") == 1, F.col("a")))
    shares = [0.0, 0.001, 0.25, 0.333, 0.5, 0.9, 0.999, 1.0]
    got = quantiles.exact(df, [*columns, "e", "f"], shares)
    for c, x in columns.items():
        assert np.allclose(got[c], np.quantile(x, shares), rtol=1e-12, atol=1e-15)
    assert np.allclose(got["f"], np.quantile(columns["a"][columns["b"] == 1], shares)) and got["e"] == [None] * len(shares)


def test_running_sums(spark):
    rows = [(g, float(x), x % 5) for g in ("p", "q", None) for x in range(300)]
    got = quantiles.running(spark.createDataFrame(rows, "g string, x double, n long"), ["g"], "x", {"s": "n"}).collect()
    assert len(got) == 900 and all(r["s"] == sum(k % 5 for k in range(int(r["x"]) + 1)) for r in got)
    assert quantiles.running(spark.createDataFrame(rows[:300], "g string, x double, n long"), [], "x", {"s": "n"}).agg(F.max("s")).first()[0] == 600


def test_normal_quantiles(spark):
    from statistics import NormalDist

    p = [1e-6, 0.001, 0.02, 0.1, 0.5, 0.77, 0.98, 0.9999]
    got = spark.createDataFrame([(x,) for x in p], "p double").select(preprocess.normal_quantile(F.col("p")).alias("z")).collect()
    assert all(abs(r["z"] - NormalDist().inv_cdf(x)) < 1e-7 for r, x in zip(got, p, strict=True))


def entropy(counts):
    n = sum(counts)
    return -sum(c / n * math.log2(c / n) for c in counts if c)


def test_byte_features_of_odd_contents(spark, monkeypatch):
    monkeypatch.setattr(content, "BATCH", 7)
    monkeypatch.setattr(content, "BLOCKS", 2)
    rng = np.random.default_rng(2)
    blobs = [None, b"", b"a", b"ab", bytes(range(256)) * 5, b"\0" * 700, bytes(rng.integers(0, 256, 5000, dtype=np.uint8)), b"abab" * 300]
    df = spark.createDataFrame([(i, b, "x") for i, b in enumerate(blobs)], "doc_id long, content binary, gram string").repartition(2)
    counts = {}
    for r in content.gram_counts(df, 2).collect():
        counts.setdefault(r["doc_id"], {})[r["gram"]] = r["n"]
    for i, b in enumerate(blobs):
        want = {}
        for k in range(len(b or b"") - 1):
            g = b[k : k + 2].hex().upper()
            want[g] = want.get(g, 0) + 1
        assert counts.get(i, {}) == want
    got = {r["doc_id"]: r["entropy"] for r in content.file_entropy(df).collect()}
    assert set(got) == {2, 3, 4, 5, 6, 7} and all(abs(got[i] - entropy(np.bincount(list(blobs[i])))) < 1e-6 for i in got)
    blocks = {r["doc_id"]: r for r in content.block_entropy(df).collect()}
    assert 5 not in blocks and blocks[4]["blocks"] == 5 and blocks[4]["avg_entropy"] == 8
    for pruning in content.PRUNINGS:
        places = [(r["doc_id"], r["place"], r["window"], r["score"]) for r in content.randomness_profile(df, keep=6, pruning=pruning).collect()]
        for i in (2, 3, 4, 5, 6, 7):
            sums = content.window_sums(np.frombuffer(blobs[i], np.uint8))
            mine = sorted((p, w, s) for d, p, w, s in places if d == i)
            assert [p for p, *_ in mine] == list(range(len(mine))) and all(abs(s - sums[w] / sums.max()) < 1e-6 for _, w, s in mine)
            assert len(mine) == (min(4, len(sums)) + min(3, len(sums)) if pruning == "trunk" else min(6, len(sums)))
            if pruning == "smallest":
                assert [s for *_, s in mine] == sorted(s for *_, s in mine)
    assert {r["doc_id"] for r in content.bigram_bins(df, 50).collect()} == {2, 3, 4, 5, 6, 7}


def test_similar_pairs_of_a_hot_bucket(spark, monkeypatch):
    monkeypatch.setattr(similarity, "PART", 8)
    rng = np.random.default_rng(3)
    base = [f"w{k}" for k in rng.integers(0, 1000, 120)]
    texts = [" ".join(base[:i] + ["odd"] + base[i:]) for i in range(0, 120, 3)] + [" ".join(base)] * 3 + [" ".join(f"v{k}" for k in rng.integers(0, 1000, 120)) for _ in range(10)] + ["", "a b"]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    index = similarity.rare_items(similarity.classes(df, "doc_id", "text")[0], "doc_id", 80.0)
    met = similarity.candidates(index, "doc_id", 80.0, part=8)
    whole = similarity.candidates(index, "doc_id", 80.0, part=10_000)
    assert sorted(map(tuple, met.collect())) == sorted(map(tuple, whole.collect()))
    sets = {}
    for i, t in enumerate(texts):
        words = t.split() or [""]
        sets.setdefault(frozenset(" ".join(words[k : k + 5]) for k in range(max(1, len(words) - 4))), i)
    keys = sorted((i, s) for s, i in sets.items())
    want = {(a, b) for a, s in keys for b, t in keys if a < b and len(s & t) / len(s | t) >= 0.8}
    assert {(r["a"], r["b"]) for r in similarity.similar_pairs(df, "doc_id", "text").collect()} == want
    sets, members = similarity.classes(df, "doc_id", "text")
    later = similarity.with_earlier(sets, "doc_id")
    assert sorted(r["doc_id"] for r in later.collect()) == sorted({b for _, b in want})
    share = quality.similarity_score(df, members, later, "doc_id").first()["similarity"]
    assert share == round(1 - (2 + len({b for _, b in want})) / len(texts), 6)


@pytest.mark.parametrize("threshold", [30.0, 50.0, 80.0, 100.0])
def test_set_joins_are_exact_at_any_threshold(spark, threshold):
    rng = np.random.default_rng(17)
    base = [sorted(set(rng.integers(0, 500, n).tolist())) for n in (1, 2, 5, 10, 40, 120)]
    sets = [[]]
    for one in base:  # drifting copies: each a little further from the first
        for k in range(12):
            sets.append(sorted({*one[k // 2 :], *rng.integers(0, 5000, k // 3).tolist()}))
    sets = [list(x) for x in sorted({tuple(x) for x in sets}, key=lambda x: rng.random())]
    df = spark.createDataFrame(list(enumerate(sets)), "k long, items array<long>").checkpoint()
    score = {(i, j): len(set(a) & set(b)) / len(set(a) | set(b)) for j, b in enumerate(sets) for i, a in enumerate(sets) if i < j and (a or b)}
    want = {p for p, x in score.items() if x >= threshold / 100 - 1e-12}
    assert {(r["a"], r["b"]) for r in similarity.pairs_of(df, "k", threshold).collect()} == want and (len(want) > 20 or threshold == 100)
    assert sorted(r["k"] for r in similarity.with_earlier(df, "k", threshold).collect()) == sorted({b for _, b in want})
    kept = []
    for j in range(len(sets)):
        if not any((i, j) in want for i in kept):
            kept.append(j)
    assert sorted(r["k"] for r in similarity.keep_greedily(df, "k", threshold).collect()) == kept


def test_sets_without_room_leave_early_and_one_index_serves_all_rounds(spark, monkeypatch):
    base = list(range(100))
    sets = [base, base[:95] + [200], base[:90] + [300, 301]] + [[4003, *range(1000 * k, 1000 * k + 100)] for k in range(10, 50)] + [[], [4003], [4003, 4007]]
    df = spark.createDataFrame(list(enumerate(sets)), "k long, items array<long>").checkpoint()
    listed = [(r["k"], r["item"]) for r in similarity.shared_items(df, "k", 80.0).collect()]
    assert {k for k, _ in listed} == {0, 1, 2, 44, 45} and {i for k, i in listed if k > 2} == {4003}  # the lone sets were gone before their last part
    calls = []
    one = similarity.rare_items
    monkeypatch.setattr(similarity, "rare_items", lambda *a: calls.append(1) or one(*a))
    assert sorted(r["k"] for r in similarity.keep_greedily(df, "k").collect()) == [0, *range(3, len(sets))] and len(calls) == 1
    assert [r["k"] for r in similarity.with_earlier(df, "k", 50.0).orderBy("k").collect()] == [1, 2, 45]


def test_items_are_counted_in_parts(spark, monkeypatch):
    removed = []
    one = similarity.remove
    monkeypatch.setattr(similarity, "remove", lambda s, path: removed.append(path) or one(s, path))
    rng = np.random.default_rng(23)
    sets = [sorted(set(rng.integers(-200, 200, n).tolist())) for n in (0, 1, 3, 30, 60, 60)] + [[-7, 7]] * 2
    df = spark.createDataFrame(list(enumerate(sets)), "k long, items array<long>")
    held = {}
    for one_set in sets:
        for item in one_set:
            held[item] = held.get(item, 0) + 1
    want = sorted((k, len(s), i, held[i]) for k, s in enumerate(sets) for i in s if held[i] > 1)
    assert sorted((r["k"], r["n"], r["item"], r["held"]) for r in similarity.shared_items(df, "k").collect()) == want
    texts = ["a b c d e f", "A  b c d e f", None, "", "x", "a b c d e g"]
    distinct, members = similarity.classes(spark.createDataFrame(list(enumerate(texts)), "k long, text string").where("text is not null"), "k", "text")
    assert len(removed) == similarity.PARTS
    assert sorted(r["k"] for r in distinct.collect()) == [0, 3, 4, 5] and {r["k"]: r["first"] for r in members.collect()} == {0: 0, 1: 0, 3: 3, 4: 4, 5: 5}


def test_near_copies_of_a_template_need_few_pairs(spark, monkeypatch):
    tried = []
    one = similarity.scored
    monkeypatch.setattr(similarity, "scored", lambda pairs, *rest: tried.append(pairs.count()) or one(pairs, *rest))
    items = list(range(100))
    sets = [[*items, 1000 + i] for i in range(300)] + [[5000 + 50 * i + k for k in range(50)] for i in range(20)]
    df = spark.createDataFrame(list(enumerate(sets)), "k long, items array<long>").checkpoint()
    assert similarity.with_earlier(df, "k").count() == 299 and sum(tried) < 2 * 300
    tried.clear()
    assert sorted(r["k"] for r in similarity.keep_greedily(df, "k").collect()) == [0, *range(300, 320)] and sum(tried) < 4 * 300


def test_divisors(spark):
    df = spark.createDataFrame([(6.0, 2.0, 0.0)], "a double, b double, c double")
    made = {"x": "(a + b) / c", "y": "a / (b - 2) + 1", "z": "a / b / 3", "q": "a / -greatest(b, c) * 2", "t": "length('a/b')", "m": "a % c", "is_on": "a / b > 2"}
    row = derive.derive(df, made).first()
    assert (row["x"], row["y"], row["z"], row["q"], row["t"], row["m"], row["is_on"]) == (None, None, 1.0, -6.0, 3, None, True)
    with pytest.raises(Exception, match="gone"):
        derive.derive(df, {"x": "gone + 1"})
    with pytest.warns(UserWarning):
        assert derive.derive(df, {"x": "gone + 1", "y": "a"}, fail="warning").first()["x"] is None
    assert derive.derive(df, {"x": "gone + 1", "y": "a"}, fail="continue").columns == ["a", "b", "c", "y"]


def test_history(spark):
    folder = new_folder(spark, "history")
    tables = [spark.range(n).withColumn("v", F.lit(None).cast("string")) for n in (5, 6, 7, 8, 9, 10)]
    assert [history.take(t, folder) for t in tables[:2]] == [0, 1]
    assert history.take(tables[1].repartition(3), folder) is None
    assert history.take(tables[1].withColumn("v", F.lit("")), folder) == 2
    for t in tables[2:]:
        history.take(t, folder)
    assert history.numbers(spark, folder) == [0, 4, 5, 6]
    assert (history.revert(spark, folder).count(), history.revert(spark, folder, "initial").count()) == (10, 5)
    with pytest.raises(ValueError):
        history.revert(spark, folder + "-none")


def test_stream_update_goes_on_after_a_restart(spark, tmp_path):
    schema, folder = "hash long, event_id long, label string", new_folder(spark, "stream")

    def run():
        stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in")
        return {tuple(r) for r in updates.upsert_batches(spark, stream, "event_id", folder).collect()}

    def add(*rows):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")

    (tmp_path / "in").mkdir()
    assert run() == set()
    add((1, 5, "?"), (2, 6, "x"), (3, 7, None))
    assert run() == {(1, 5, "?"), (2, 6, "x"), (3, 7, None)}
    add((1, 9, "late"), (2, 1, "y"), (3, 2, "?"))
    assert run() == {(1, 9, "late"), (2, 1, "y"), (3, 2, "?")}
    assert run() == {(1, 9, "late"), (2, 1, "y"), (3, 2, "?")}


def test_clustering_scores(spark):
    rng = np.random.default_rng(4)
    x = np.r_[rng.normal(0, 1, (40, 2)), rng.normal(5, 1, (30, 2)), [[9.0, 9.0]]]
    c, t = np.r_[np.zeros(40), np.ones(30), [2]].astype(int), rng.integers(0, 3, 71)
    df = spark.createDataFrame(pd.DataFrame({"x": x[:, 0], "y": x[:, 1], "c": c, "t": t}))
    away = ((x[:, None] - x) ** 2).sum(2)
    want = []
    for i in range(71):
        own = c == c[i]
        a = away[i, own].sum() / max(1, own.sum() - 1)
        b = min(away[i, c == k].mean() for k in {0, 1, 2} - {c[i]})
        want.append(0 if own.sum() == 1 else (b - a) / max(a, b))
    assert abs(metrics.silhouette(df, ["x", "y"], "c").first()[0] - np.mean(want)) < 1e-5
    a, b = [40, 30, 1], [int((t == k).sum()) for k in range(3)]
    draws = []
    for _ in range(4000):
        s = rng.permutation(c)
        draws.append(sum((n := ((s == i) & (t == j)).sum()) and n / 71 * math.log(71 * n / (a[i] * b[j])) for i in range(3) for j in range(3)))
    assert abs(metrics.expected_information(a, b) - np.mean(draws)) < 0.002
    assert metrics.adjusted_information(df, "c", "c").first()["adjusted"] == 1 and abs(metrics.adjusted_information(df, "c", "t").first()["adjusted"]) < 0.1
    assert math.isfinite(metrics.expected_information([10**11, 10**11], [10**10, 19 * 10**10]))


def test_flipped_classes(spark):
    df = spark.createDataFrame([(0, 1), (0, 1), (1, 0), (1, 1), (0, 0)] * 3, "t int, p int")
    plain, turned = metrics.binary_metrics(df, "t", "p", "p").first(), metrics.binary_metrics(df, "t", "p", "p", flip=True).first()
    assert plain["mcc"] < 0 < turned["mcc"] == -plain["mcc"] and turned["accuracy"] == round(1 - plain["accuracy"], 6) and turned["auc"] == round(1 - plain["auc"], 6)


def test_knn_over_blocks(spark, monkeypatch):
    monkeypatch.setattr(models, "BLOCK", 16)
    rng = np.random.default_rng(5)
    x, label = rng.integers(0, 5, (90, 3)).astype(float), rng.integers(0, 3, 90)
    df = spark.createDataFrame(pd.DataFrame({"hash": range(90), "a": x[:, 0], "b": x[:, 1], "c": x[:, 2], "label": label}))
    for p, weights in ((1, "uniform"), (2, "distance")):
        got = {r["hash"]: r["prediction"] for r in models.knn(df, df.where("hash % 3 = 0"), ["a", "b", "c"], "label", 4, p, weights).collect()}
        for q in range(0, 90, 3):
            away = sorted(((abs(x[i] - x[q]) ** p).sum(), i) for i in range(90) if i != q)[:4]
            votes = {}
            for d, i in away:
                votes[label[i]] = votes.get(label[i], 0) + (1 if weights == "uniform" else 1e300 if d == 0 else d ** (-1 / p))
            assert got[q] == max(votes, key=lambda v: (votes[v], v))


def test_elimination_finds_the_useful_features(spark):
    rng = np.random.default_rng(6)
    x = rng.normal(size=(400, 4))
    df = spark.createDataFrame(pd.DataFrame({"hash": range(400), **{f"f{i}": x[:, i] for i in range(4)}, "y": (x[:, 0] + x[:, 2] > 0).astype(int)}))
    got = {r["feature"]: r for r in selection.rfecv(df, ["f0", "f1", "f2", "f3"], "y").collect()}
    assert {f for f, r in got.items() if r["rank"] == 1} >= {"f0", "f2"} and len(got) == 4
    assert max(r["score"] for r in got.values()) > 0.6
    kept = selection.filter_pipeline(df, ["f0", "f1", "f2", "f3"], "y", 0.001, 3).orderBy("rank").collect()
    assert {kept[0]["feature"], kept[1]["feature"]} == {"f0", "f2"}


def test_forests_on_cells_are_forests_on_their_rows(spark, monkeypatch):
    rng = np.random.default_rng(11)
    x = rng.integers(0, 6, (600, 2))
    df = spark.createDataFrame(pd.DataFrame({"hash": range(600), "f0": x[:, 0] * 1.0, "f1": x[:, 1] * 1.0, "y": (x[:, 0] > 2).astype(int) ^ (rng.random(600) < 0.1)}).astype({"y": int}))
    rows = selection.folded(df, 2)
    found = selection.cells(rows, ["f0", "f1"], "y").collect()
    assert sum(r["n"] for r in found) == 600 and len(found) <= 6 * 6 * 2 * 2
    assert selection._dense(rows, ["f0", "f1"], "y") is None  # too few rows a cell
    plain = selection.cross_validated(rows, ["f0", "f1"], "y", 2)
    monkeypatch.setattr(selection, "DENSE", 2)
    dense = selection._dense(rows, ["f0", "f1"], "y")
    assert abs(selection._validated(dense, ["f0", "f1"], "y", 2) - plain) < 0.05 and plain > 0.6
    got = {r["feature"]: (r["rank"], r["score"]) for r in selection.rfecv(df, ["f0", "f1"], "y", folds=2).collect()}
    assert got["f0"][0] == 1 and got["f0"][1] > 0.6 and set(got) == {"f0", "f1"}


def test_filter_pipeline_drops_a_redundant_feature(spark, monkeypatch):
    rng = np.random.default_rng(7)
    x = rng.normal(size=(2000, 2))
    twin = x[:, 0] + 0.01 * rng.normal(size=2000)
    df = spark.createDataFrame(pd.DataFrame({"hash": range(2000), "f0": x[:, 0], "f1": twin, "f2": x[:, 1], "y": (x[:, 0] + 0.8 * x[:, 1] > 0).astype(int)}))
    seen, real = [], selection._eliminated
    monkeypatch.setattr(selection, "_eliminated", lambda rows, dense, names, *more: seen.append(sorted(names)) or real(rows, dense, names, *more))
    kept = {r["feature"] for r in selection.filter_pipeline(df, ["f0", "f1", "f2"], "y", 0.001, 3).collect()}
    assert seen in ([["f0", "f2"]], [["f1", "f2"]]) and kept <= set(seen[0]) and "f2" in kept
    assert selection.mrmr(df, ["f0", "f1", "f2"], "y", 3).count() == 3
