"""Small hand-made tables."""

import duckdb
import numpy as np
from pyspark.sql import functions as F

from assaylake.functions import content
from assaylake.operators import derive, joins, metric, preprocess, project, similarity, voting
from assaylake.plans import learning, registry


def test_upsert_keeps_labelled_rows(spark):
    old = spark.createDataFrame([("a", "x"), ("b", None)], "hash string, label string")
    new = spark.createDataFrame([("a", "y"), ("b", "z"), ("c", "w")], "hash string, label string")
    assert {tuple(r) for r in joins.upsert(old, new).collect()} == {("a", "x"), ("b", "z"), ("c", "w")}
    assert {tuple(r) for r in joins.upsert(old, new, update=True).collect()} == {("a", "y"), ("b", "z"), ("c", "w")}


def test_merge_is_idempotent(spark):
    one = spark.createDataFrame([("a", "x"), ("b", None)], "hash string, label string")
    assert joins.differing(joins.merge(one, one), one).first()[:] == (0, 0)


def test_split_is_a_partition(spark):
    df = spark.createDataFrame([(1, "a"), (2, None), (3, "b")], "hash int, label string")
    a, b = joins.split(df, "label = 'a'")
    assert (a.count(), b.count()) == (1, 2)


def test_decide_ties(spark):
    votes = [("h", 1, "upx"), ("h", 2, "upx"), ("h", 3, "upx2"), ("h", 4, "upx2"), ("k", 1, "p"), ("k", 2, "q"), ("m", 1, "-"), ("n", 1, "p"), ("n", 2, "-"), ("n", 3, "x")]
    df = spark.createDataFrame(votes, "hash string, detector_rank int, label string")
    got = {r["hash"]: r["label"] for r in voting.decide(df, threshold=1).collect()}
    assert got == {"h": "upx2", "k": "?", "m": "-", "n": "?"}


def test_responses_end_words_at_ascii_letters(spark):
    texts = ["noñas", "ciónno", "ñpackedñ", "no_", "not\rpacked", "not\npacked", "notpacked", "NOT\u2028PACKED yes", "mal\u0130cious", "PAC\u212aED", "ye\u017f", "UNPACKED", "it is packed.", "nope", "", None]
    rows = spark.createDataFrame(list(enumerate(texts)), "conv_id long, text string")
    got = rows.select("conv_id", voting.parse_response(F.col("text")).alias("answer")).collect()
    con = duckdb.connect()
    con.sql("CREATE TABLE conversations (conv_id BIGINT, turn INTEGER, text VARCHAR)")
    con.executemany("INSERT INTO conversations VALUES (?, 1, ?)", [(4 * n + 2, t) for n, t in enumerate(texts)])  # where the query adds nothing
    asked = con.sql(registry.oracle_sql()["response_parse"]).fetchall()
    assert {r["conv_id"]: r["answer"] for r in got} == {(n - 2) // 4: answer for n, _, answer in asked}


def test_queries_in_data_frame_style():
    assert project.to_sql('label == "x" and f in ["a", "b"]') == "label = 'x' and f IN ('a', 'b')"


def test_feature_levels_leave_cycles_out():
    assert derive.order_features({"b": "a + 1", "a": "x * 2", "p": "q", "q": "p"}, ["x"]) == [["a"], ["b"]]


def test_huffman_lengths():
    assert content.huffman([(1, 8), (2, 1), (3, 1)]) == {1: 1, 2: 2, 3: 2}
    # Ties by appearance, joined ones last: 1 and 2 are joined (2), then 3 and the next single one, not the pair.
    assert content.huffman([(9, 1), (4, 1), (7, 1), (1, 2)]) == {9: 2, 4: 2, 7: 2, 1: 2}
    assert content.huffman([(5, 3)]) == {5: 1} and content.huffman([]) == {}


def walked_profile(data, window, skip, keep, pruning):
    """The profile by a walk over a tree of nodes, written apart from the library's."""
    order = []
    for b in data:
        if b not in order:
            order.append(b)
    nodes = [[data.count(b), place, b] for place, b in enumerate(order)]
    depth = {}
    if len(nodes) == 1:
        depth[order[0]] = 1
    else:
        born = len(nodes)
        while len(nodes) > 1:
            nodes.sort(key=lambda n: (n[0], n[1]))
            one, two = nodes[:2]
            nodes = [*nodes[2:], [one[0] + two[0], born, (one, two)]]
            born += 1

        def walk(node, level):
            if isinstance(node[2], tuple):
                for side in node[2]:
                    walk(side, level + 1)
            else:
                depth[node[2]] = level

        walk(nodes[0], 0)
    sums = [sum(depth[b] for b in data[i : i + window]) for i in range(0, len(data) - window + 1, skip)] or [sum(depth[b] for b in data)]
    profile = [x / max(sums) for x in sums]
    if pruning == "first":
        return profile[:keep]
    if pruning in ("smallest", "ordered_smallest"):
        return sorted(profile)[:keep]
    return profile[: round(keep / 2 + 0.5)] + profile[-round(keep / 2) :]


def test_profiles_equal_a_walk(spark, sf):
    texts = [r["text"].encode() for r in spark.read.parquet(f"{sf}/documents.parquet").orderBy("doc_id").limit(40).collect() if r["text"]]
    blobs = [*texts, b"a", b"zzzz", b"abcabd" * 9, bytes(range(256)) * 2, bytes(range(255, -1, -1)) * 2, b"\x00\xff" * 40]
    df = spark.createDataFrame(list(enumerate(blobs)), "doc_id long, content binary")
    for pruning, keep in (("trunk", 50), ("trunk", 7), ("trunk", 48), ("first", 50), ("smallest", 9), ("ordered_smallest", 9)):
        got = {}
        for r in content.randomness_profile(df, keep=keep, pruning=pruning).orderBy("doc_id", "place").collect():
            got.setdefault(r["doc_id"], []).append((r["window"], r["score"]))
        for i, b in enumerate(blobs):
            want = walked_profile(b, 32, 32, keep, pruning)
            assert [s for _, s in got[i]] == [round(x, 6) for x in want]
            if pruning == "ordered_smallest":
                assert got[i] == sorted(got[i], key=lambda x: (x[1], x[0]))


def test_greedy_keep_follows_the_order(spark):
    keys = spark.createDataFrame([(i,) for i in range(5)], "k int")
    pairs = spark.createDataFrame([(0, 1), (1, 2), (2, 3)], "a int, b int")
    assert sorted(r[0] for r in similarity.greedy_keep(keys, pairs, "k").collect()) == [0, 2, 4]


def test_shingles_of_short_and_empty_texts(spark):
    df = spark.createDataFrame([("a b",), ("",)], "t string").select(similarity.shingles(F.col("t")).alias("s"))
    assert [r[0] for r in df.collect()] == [["a b"], [""]]


def test_dbscan_on_two_groups(spark):
    points = [(i, 0.01 * i, 0.0) for i in range(5)] + [(10 + i, 5 + 0.01 * i, 0.0) for i in range(5)] + [(99, 50.0, 50.0)]
    df = spark.createDataFrame(points, "hash long, x double, y double")
    got = {r["hash"]: r["cluster"] for r in metric.dbscan(df, ["x", "y"], 0.05, 3).collect()}
    assert got[99] == -1 and {got[i] for i in range(5)} == {0} and {got[10 + i] for i in range(5)} == {10}


def test_stream_votes_count_every_event(spark, sf, tmp_path):
    events = learning.table(spark, sf, "events")
    day = F.date_format(F.date_trunc("day", F.col("ts").cast("timestamp")), "yyyy-MM-dd HH:mm:ss")
    want = sorted(tuple(r) for r in events.select(day.alias("start"), F.col("user_id").alias("hash"), F.col("event_type").alias("label")).groupBy("start", "hash", "label").count().collect())
    late_first = events.repartitionByRange(9, F.col("ts").desc())
    for n in range(9):  # more files than a micro-batch takes, the latest events first
        late_first.where(F.spark_partition_id() == n).coalesce(1).write.mode("append").parquet(f"{tmp_path}/events.parquet")
    for folder in (sf, str(tmp_path)):
        got = learning.stream_votes(spark, folder)
        assert got.columns == ["start", "hash", "label", "n"] and sorted(tuple(r) for r in got.collect()) == want
    assert sorted(map(tuple, learning.stream_decisions(spark, str(tmp_path)).collect())) == sorted(map(tuple, learning.stream_decisions(spark, sf).collect()))


def test_greedy_keep_of_a_long_chain(spark, monkeypatch):
    n = 130
    keys = spark.createDataFrame([(i,) for i in range(n)], "k int")
    pairs = spark.createDataFrame([(i, i + 1) for i in range(n - 1)], "a int, b int")
    assert sorted(r[0] for r in similarity.greedy_keep(keys, pairs, "k").collect()) == list(range(0, n, 2))
    monkeypatch.setattr(similarity, "FEW", n - 12)  # the rounds go on until few are open
    assert sorted(r[0] for r in similarity.greedy_keep(keys, pairs, "k").collect()) == list(range(0, n, 2))


def test_rounding_without_decimals_is_rounding_to_the_bit(spark):
    rng = np.random.default_rng(18)
    ties = (rng.integers(-(10**9), 10**9, 3000) * 2 + 1) / 2e6
    values = [*ties, *np.nextafter(ties, 0), *rng.normal(size=3000), *rng.normal(size=3000) * 1e4, *rng.normal(size=300) * 1e12, *rng.normal(size=300) * 1e-7, 0.0, -0.0, 1e300, float("inf"), float("-inf"), 99999.9999995, -1e-9]
    df = spark.createDataFrame([(float(v),) for v in values] + [(None,)], "x double").withColumn("y", F.when(F.col("x") > -1e9, F.lit(float("nan"))))
    for c in ("x", "y"):
        bits = df.select(preprocess.rounded(F.col(c)).alias("a"), F.round(c, 6).alias("b")).where("hex(cast(a as string)) <> hex(cast(b as string)) or (a is null) <> (b is null)")
        assert bits.count() == 0
    assert preprocess.impute(spark.createDataFrame([(1,), (1,), (None,)], "n int"), "n", "mode").dtypes == [("n", "int")]


def test_pca_standardises_once(spark, monkeypatch):
    tables = []
    one = preprocess.written
    monkeypatch.setattr(preprocess, "written", lambda df, name: tables.append(name) or one(df, name))
    df = spark.createDataFrame([(k, float(k), float(k % 3)) for k in range(20)], "hash long, a double, b double")
    out = preprocess.pca(df, ["a", "b"])
    assert tables == ["standardised"] and out.columns == ["hash", "a", "b", "pc1", "pc2"] and out.count() == 20
