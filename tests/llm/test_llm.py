"""The operators of the llm folder against brute force, on small tables with nulls, empty and long texts, repeats and clashing columns."""

import hashlib
import math
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

pytest.importorskip("assaylake.llm.queries")
import public_tokenizers
from tokenizers import Tokenizer

from assaylake.llm import bpe, components, lattice, mixing, mtree, rabitq, simhash, tokenfile, toolcalls, toxicity, warc

PATH = public_tokenizers.path("byte_bpe_50k.json")
TEXTS = [None, "", " ", "a", "one two three four five six", "one two three four five six", "A  b\n\n c\t d ", "x<|endoftext|>y <|endoftext|>", "日本語 ＡＢ it's 'll 12３ é z\x1c q", "na\0me \0 x", "word " * 3000, "!?#" * 700, "end. end, the end.", "tab\t x\r\n"]


def documents(spark, texts=TEXTS):
    rows = [(i if i != 3 else None, t, "en" if i % 2 else None, f"s{i % 3}" if i % 5 else None, i, "other") for i, t in enumerate(texts)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, fp string")
    return df.withColumn("key", F.lit("clash")).withColumn("size", F.lit(-1))


def test_bpe_equals_the_library(spark):
    library = Tokenizer.from_file(PATH)
    got = sorted(bpe.round_trip(documents(spark), PATH).collect(), key=lambda r: (r[0] is None, r[0] or 0))
    want = []
    for i, t in enumerate(TEXTS):
        ids = library.encode(t or "", add_special_tokens=False).ids
        want.append((i if i != 3 else None, len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(library.decode(ids, skip_special_tokens=False).encode()).hexdigest()))
    assert [tuple(r) for r in got] == sorted(want, key=lambda r: (r[0] is None, r[0] or 0))
    ids = bpe.encode(documents(spark), PATH)
    assert {(r[0], r[1]) for r in bpe.decode(ids, PATH).collect()} == {(i if i != 3 else None, t or "") for i, t in enumerate(TEXTS)}
    assert bpe.round_trip(documents(spark).limit(0), PATH).count() == 0


def test_forced_cuts_stand_in_no_token():
    enc = bpe.Encoder(bpe.tokenizer_file(PATH))
    parts = enc.fragments("".join(enc.letters[b] for b in "漢字かな߿".encode()))
    assert len(parts) > 1 and all(a[-1] + b[0] not in enc.inside for a, b in zip(parts, parts[1:], strict=False))


def test_token_files(spark):
    library = Tokenizer.from_file(PATH)
    got = {r[0]: tuple(r)[1:] for r in tokenfile.token_files(documents(spark), PATH).collect()}
    start = 0
    for i in [3, *(i for i in range(len(TEXTS)) if i != 3)]:  # the null id comes first
        ids = np.array([*library.encode(TEXTS[i] or "", add_special_tokens=False).ids, 2], "<u4")
        assert got[None if i == 3 else i] == (start, len(ids), zlib.crc32(ids.tobytes()))
        start += len(ids)
    assert tokenfile.token_files(documents(spark).limit(0), PATH).count() == 0


def test_warc(spark):
    big = "<p>" + "payload " * 50
    html = {0: big, 1: None, 2: "", 3: big, 4: "short", 5: "short", 6: big, 7: "ü" * 60, 8: "ü" * 60, None: big}
    rows = [(k, f"http://x/{k}\r\nInjected: 1", v, "clash") for k, v in html.items()] + [(0, None, big, "clash")]
    df = spark.createDataFrame(rows, "page_id long, url string, html string, payload string")
    got = sorted(tuple(r) for r in warc.archived(df).where("page_id is not null").collect())
    digest = lambda t: hashlib.sha256((t or "").encode()).hexdigest()
    refers = {3: 0, 6: 0, 8: 7}
    want = [(k, len((html[k] or "").encode()), digest(html[k]), "revisit" if k in refers else "response", refers.get(k)) for k in [0, *range(9)]]
    assert [tuple(x if x is not None else -1 for x in r) for r in got] == [tuple(x if x is not None else -1 for x in r) for r in sorted(want, key=str)] or sorted(map(str, got)) == sorted(map(str, want))
    assert warc.archived(df.limit(0)).count() == 0


def components_of(n, links):
    label = list(range(n))
    for _ in range(n):
        for a, b in links:
            label[a] = label[b] = min(label[a], label[b])
    return label


def test_simhash_against_all_pairs(spark):
    rng = np.random.default_rng(0)
    base = [" ".join(rng.choice(["alpha", "beta", "gamma", "delta", "eps"], 60)) for _ in range(12)]
    texts = TEXTS + base + [b + " tail" for b in base] + [b.replace("alpha", "ALPHA") for b in base]
    got = {r[0]: (r[1], r[2]) for r in simhash.simhash_components(documents(spark, texts)).collect() if r[0] is not None}
    fps = [simhash.fingerprint(t) for t in texts]
    links = [(a, b) for a in range(len(fps)) for b in range(a) if (fps[a] ^ fps[b]).bit_count() <= 4]
    label = components_of(len(fps), links)
    smallest = {}
    for i, c in enumerate(label):
        if i != 3:
            smallest[c] = min(smallest.get(c, i), i)
    assert got == {i: (f"{fps[i]:016x}", smallest[label[i]]) for i in range(len(fps)) if i != 3}


def test_keep_first_keeps_texts_without_ids_of_their_own(spark):
    rng = np.random.default_rng(7)
    text = lambda: " ".join(rng.choice([f"w{k}" for k in range(500)], 50))
    a, b, c, d, e, f = (text() for _ in range(6))
    rows = [(None, a), (None, b), (None, b), (7, c), (7, d), (1, c), (9, e), (9, e), (2**60 + 1, f), (2**60, f + " "), (None, c), (None, None), (None, "")]
    df = spark.createDataFrame([(i, t, None, None) for i, t in rows], "doc_id long, text string, lang string, source string")
    got = simhash.keep_first(df.repartition(3))
    assert got.columns == df.columns
    kept = {(r["doc_id"], r["text"] or "") for r in got.collect()}
    assert got.count() == 7 and kept == {(None, a), (None, b), (1, c), (7, d), (9, e), (2**60, f + " "), (None, "")}


def test_bk_forest_finds_all_neighbours():
    value = np.random.default_rng(1).integers(0, 1 << 12, 300).astype(np.uint64)
    value = np.unique(value)
    forest = simhash.BKForest(np.zeros(len(value), np.int64), value)
    found = {(a, b) for x, y in forest.links(np.arange(len(value)), forest.root, 3) for a, b in zip(x.tolist(), y.tolist(), strict=True)}
    assert found == {(a, b) for a in range(len(value)) for b in range(len(value)) if a != b and int(value[a] ^ value[b]).bit_count() <= 3}


def test_split_shards_lose_no_link(spark):
    value = np.random.default_rng(2).integers(0, 1 << 9, 200)
    df = spark.createDataFrame([(int(v),) for v in set(value.tolist())], "fp long")
    whole = components.connected_components(simhash.links_of(df)).groupBy("component").count().count()
    assert components.connected_components(simhash.links_of(df, part=16)).groupBy("component").count().count() == whole


def test_components_of_a_chain_and_a_star(spark):
    chain, star = [(i, i + 1) for i in range(40)], [(100, i) for i in range(101, 160)]
    df = spark.createDataFrame([*chain, *star, (7, 7), (None, 5)], "a long, b long")
    got = {r[0]: r[1] for r in components.connected_components(df).collect()}
    assert got == {**dict.fromkeys(range(41), 0), **dict.fromkeys(range(100, 160), 100)}


def vectors(spark):
    rng = np.random.default_rng(3)
    base = rng.standard_normal((30, 16))
    near = base[:10] + 0.05 * rng.standard_normal((10, 16))
    rows = [v.astype("f4").tolist() for v in np.concatenate([base, near, base[:5]])]
    rows += [None, [], [0.0] * 16, [float("nan")] * 16, [None] * 16, [float("inf")] + [0.0] * 15, rows[0][:8]]
    data = [(i, v, "clash") for i, v in enumerate(rows)] + [(2, rows[2], "clash"), (None, rows[0], "clash")]
    return rows, spark.createDataFrame(data, "vec_id long, embedding array<float>, rep string")


def able(v, zero=True):
    return v and all(x is not None and math.isfinite(x) for x in v) and (zero or any(v))


def test_mtree_against_all_pairs(spark):
    rows, df = vectors(spark)
    got = sorted(tuple(r) for r in mtree.top_k(df, df.where("vec_id % 4 = 0"), shard=10).collect())
    ints = {i: np.floor(256 * np.array(v, "f8")).astype(int) for i, v in enumerate(rows) if able(v)}
    want = []
    for q in (i for i in ints if i % 4 == 0):
        scores = [(-int(ints[q] @ ints[i]), i) for i in [*ints, 2] if i != q and len(ints[i]) == len(ints[q])]
        want += [(q, n + 1, i, -s) for n, (s, i) in enumerate(sorted(scores)[:5])]
    assert got == sorted(want)
    assert mtree.top_k(df.limit(0), df.limit(0)).count() == 0


def test_mtree_with_large_components(spark):
    rng = np.random.default_rng(11)
    rows = rng.standard_normal((60, 8)).astype("f4").astype("f8")
    rows[3] *= 1e5
    rows[7, 0], rows[8, 0] = 40_000.5, -1e6
    rows[20:23] = 0  # scores that one unit tells apart, too large for float64
    rows[20:23, 7], rows[20:23, 6] = 2.0**22, [0, 1 / 256, -1 / 256]
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(rows)], "vec_id long, embedding array<double>")
    ints = [[int(x) for x in np.floor(256 * v)] for v in rows]
    for shard in (8192, 10):
        got = sorted(tuple(r) for r in mtree.top_k(df, df, shard=shard).collect())
        want = []
        for q in range(60):
            scores = sorted((-sum(x * y for x, y in zip(ints[q], ints[i], strict=True)), i) for i in range(60) if i != q)
            want += [(q, n + 1, i, -s) for n, (s, i) in enumerate(scores[:5])]
        assert got == sorted(want)
    tree = mtree.MTree(np.arange(3), np.array([[2.0**70, 1], [2.0**70, 2], [0, 3]]))
    assert tree.search(np.array([2.0**70, 1]), 9, 2)[0] == [(2**140 + 2, 1), (2**140 + 1, 0)]


def test_mtree_of_equal_rows():
    tree = mtree.MTree(np.arange(3000), np.ones((3000, 4)), leaf=64)
    assert tree.search(np.ones(4), 0, 5)[0] == [(4, i) for i in range(1, 6)]


def test_rabitq_against_all_pairs(spark):
    rows, df = vectors(spark)
    got = sorted(tuple(r)[:3] for r in rabitq.near_duplicates(df, block=8).where("vec_id is not null").collect())
    every = [*enumerate(rows), (2, rows[2])]
    good = [(i, np.array(v, "f8")) for i, v in every if able(v, False)]
    cos = lambda a, b: len(a) == len(b) and a @ b / (np.linalg.norm(a) * np.linalg.norm(b)) >= 0.95
    links = [(x, y) for x in range(len(good)) for y in range(len(good)) if x != y and cos(good[x][1], good[y][1])]
    label = components_of(len(good), links)
    want = [(i, sum(a == x for a, _ in links), min(good[z][0] for z in range(len(good)) if label[z] == label[x])) for x, (i, _) in enumerate(good)]
    want += [(i, 0, i) for i, v in every if not able(v, False)]
    assert got == sorted(want)


def test_rabitq_bounds_hold():
    rng = np.random.default_rng(5)
    unit = rng.standard_normal((200, 64))
    unit /= np.linalg.norm(unit, axis=1)[:, None]
    bits, factor, turned = rabitq.coded(unit, rabitq.rotation(64))
    estimate, low, high = rabitq.estimate(bits, factor, turned)
    truth = unit @ unit.T
    assert (low - 1e-5 <= truth).all() and (truth <= high + 1e-5).all()
    off = ~np.eye(200, dtype=bool)
    assert abs((estimate - truth)[off].mean()) < 0.01


def test_mixing(spark):
    texts = [" ".join(["w"] * (i * 37 % 400)) for i in range(120)] + [None, "", " \t"]
    df = documents(spark, texts)
    got = mixing.mix(df, block=16).toPandas()
    again = mixing.mix(df.repartition(7), block=16).toPandas()
    assert len(got) == len(texts) and sorted(map(str, got.to_dict("records"))) == sorted(map(str, again.to_dict("records")))
    sizes = [len(re.findall(r"[^\x20\x09-\x0D]+", t or "")) for t in texts]
    assert sorted(got["size"]) == sorted(sizes) and (got.taken <= 2 * got["size"]).all()
    rows = df.select("doc_id", "source").toPandas()
    rows["words"] = sizes
    by = rows.fillna({"source": "~"}).groupby("source").words.sum()
    weight = dict(zip(by.index, [3, 1, 2, 3, 1], strict=False))
    target, free, left = {}, set(by.index), 1.5 * by.sum()
    while True:
        level = left / sum(weight[s] for s in free)
        full = {s for s in free if weight[s] * level > 2 * by[s]}
        if not full:
            break
        for s in full:
            target[s] = 2.0 * by[s]
            left -= target[s]
        free -= full
    target |= {s: weight[s] * level for s in free}
    joined = got.merge(rows.fillna({"source": "~"}), on="doc_id")
    for s, part in joined.groupby("source"):
        assert abs(part.target.iloc[0] - target[s]) < 1e-6 * target[s] and abs(part.taken.sum() - target[s]) <= 0.5 + 1e-6
    texts_out = mixing.mixed_documents(df, block=16)
    assert texts_out.columns == df.columns
    words = sum(len(re.findall(r"[^\x20\x09-\x0D]+", r["text"] or "")) for r in texts_out.collect())
    assert words == got.taken.sum()
    assert mixing.mix(df.limit(0)).count() == 0


def test_permutation_is_one(spark):
    df = spark.range(1000).select(mixing.permuted(F.col("id"), F.lit(1000), 1, 2).alias("p"))
    assert sorted(r[0] for r in df.collect()) == list(range(1000))


def test_lattice_sums_all_segmentations():
    pieces = lattice.Pieces(open(public_tokenizers.path("piece_bpe_32k.model"), "rb").read())
    counts = pieces.counts(["hello", "help", "low", "el"], np.array([[3, 2, 1, 4], [1, 1, 9, 1]]))
    model = lattice.Lattice(pieces, counts, np.array([10.0, 12.0]))
    index = {name: i for i, name in enumerate(pieces.names) if pieces.plain[i]}
    total = counts.sum(1) + lattice.ADDED * counts.shape[1] + np.array([10.0, 12.0]) + 1

    def brute(text):
        if not text:
            return np.ones(2)
        out = np.zeros(2)
        for n in range(1, len(text) + 1):
            if text[:n] in index and (n == 1 or counts[:, index[text[:n]]].any()):
                out = out + (counts[:, index[text[:n]]] + lattice.ADDED) / total * brute(text[n:])
        return out

    for word in ("hello", "lowel", "xhelpx"):
        want = np.log(brute("▁" + word)) + np.log(model.end)
        assert np.allclose(model.log_chance([word])[0], want)
    assert np.isfinite(model.log_chance(["", "一\U0001f600߿", "z" * 2000])).all()


def test_lattice_of_long_words():
    pieces = lattice.Pieces(open(public_tokenizers.path("piece_bpe_32k.model"), "rb").read())
    counts = pieces.counts(["hello", "help", "low", "el"], np.array([[3, 2, 1, 4], [1, 1, 9, 1]]))
    model = lattice.Lattice(pieces, counts, np.array([10.0, 12.0]))
    total = counts.sum(1) + lattice.ADDED * counts.shape[1] + np.array([10.0, 12.0]) + 1
    logs = {name: np.log((counts[:, i] + lattice.ADDED) / total) for i, name in enumerate(pieces.names) if pieces.plain[i] and (len(name) == 1 or counts[:, i].any())}

    def forward(text):
        sums = [np.zeros(2)]
        for j in range(1, len(text) + 1):
            terms = [sums[j - n] + logs[text[j - n : j]] for n in range(1, min(j, model.longest) + 1) if text[j - n : j] in logs]
            terms = terms or [sums[j - 1] + sum(np.log(model.byte[b]) for b in text[j - 1].encode())]
            sums.append(np.logaddexp.reduce(terms))
        return sums[-1] + np.log(model.end)

    words = ["lowhello" * n for n in (1, 11, 12, 31, 32, 33, 64, 200)] + ["\U0001f600" * 40 + "hello", "\U00012345low" * 300, "z" * 5000]
    got = model.log_chance(words)
    assert np.allclose(got, [forward("▁" + w) for w in words], rtol=1e-9)
    assert got[-1].max() < -10_000


def test_lattice_scores_tell_long_words_apart(spark):
    held = [i for i in range(1000) if zlib.crc32(str(i).encode()) % 10 == 0][:2]
    rows = [(i, "the cat sat on the mat") for i in range(60) if i not in held] + [(held[0], "q7" * 200), (held[1], "q7" * 2000)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r["doc_id"]: r["score"] for r in lattice.lattice_scores(df, public_tokenizers.path("piece_bpe_32k.model")).collect()}
    assert got[held[1]] < 5 * got[held[0]] < -1500


def test_lattice_scores(spark):
    texts = [*TEXTS, *(f"the cat sat on mat number {i}" for i in range(60))]
    got = {r["doc_id"]: r for r in lattice.lattice_scores(documents(spark, texts), public_tokenizers.path("piece_bpe_32k.model")).collect() if r["doc_id"] is not None}
    c = Counter()
    held = lambda i: i == 3 or zlib.crc32(str(i).encode()) % 10 == 0
    for i, t in enumerate(texts):
        if not held(i):
            c.update([*(t or "").encode().lower().split(), b""])
    n, v = sum(c.values()), len(c)
    assert len(got) == len(texts) - 1
    for i, t in enumerate(texts):
        if i != 3:
            tokens = [*(t or "").encode().lower().split(), b""]
            r = got[i]
            assert (r["held_out"], r["n_tokens"], r["n_known"], r["train_tokens"]) == (held(i), len(tokens), sum(c[w] > 0 for w in tokens), n)
            assert math.isclose(r["base_score"], sum(math.log10((c[w] + 0.1) / (n + 0.1 * (v + 1))) for w in tokens), rel_tol=1e-9)
            assert math.isfinite(r["score"]) and r["score"] < 0


def test_toxicity_learns_words_and_stems(spark):
    rng = np.random.default_rng(6)
    rows, labels = [], []
    for i in range(900):
        words = rng.choice([f"w{k}" for k in range(300)], 40).tolist()
        toxic = i % 3 == 0
        if toxic:
            words[int(rng.integers(40))] = f"nasty{rng.integers(50)}"
        rows.append((i, " ".join(words), "en", "clash"))
        labels.append((i, int(toxic)))
    docs = spark.createDataFrame([*rows, (None, None, None, "c"), (5000, "", "xx", "c")], "doc_id long, text string, lang string, score string")
    got = toxicity.toxicity(docs, spark.createDataFrame(labels, "doc_id long, toxic int")).toPandas()
    assert len(got) == 902 and got.score.between(0, 1).all()
    held = got[got.held_out & (got.doc_id < 900)]
    assert (held.predicted == (held.doc_id % 3 == 0)).mean() > 0.95
    none = toxicity.toxicity(docs, spark.createDataFrame([], "doc_id long, toxic int"))
    assert none.where("score between 0 and 1").count() == 902
    assert toxicity.without_toxic(docs, spark.createDataFrame(labels, "doc_id long, toxic int")).columns == docs.columns


def test_thresholds_count_all_labelled_rows(spark):
    rng = np.random.default_rng(8)
    ids = [i for i in range(20_000) if zlib.crc32(str(i).encode()) % 4 != 2][:4000]
    rows, labels = [], []
    for n, i in enumerate(ids):  # a rare language, and one with hardly a label
        toxic = n % 10 == 0
        lang = "rare" if n % 100 < 2 else "none" if n == 55 else "main"
        score = 0.9 if lang == "rare" and toxic else 0.72 if lang == "rare" else float(rng.uniform(0.5, 1)) if toxic else float(rng.uniform(0, 0.5))
        rows.append((i, lang, score))
        labels.append((i, int(toxic)))
    net = toxicity.Net.new(1)
    net.taught = [i for n, i in enumerate(ids) if n % 20 == 0 and n % 100]  # more of the toxic than of the others
    got = toxicity.calibrated(spark.createDataFrame(rows, "doc_id long, lang string, score double"), spark.createDataFrame(labels, "doc_id long, toxic int"), net)
    assert set(got) == {None, "rare", "main"} and got["rare"] == 0.75 and got["main"] == 0.5


def test_threshold_is_chosen_at_the_share_of_the_classes():
    counts = np.zeros((2, 20))
    counts[0, 4], counts[0, 10], counts[1, 8], counts[1, 16] = 90, 10, 50, 50
    assert toxicity.best_threshold(counts, np.array([100, 100])) == 0.3
    assert toxicity.best_threshold(counts, np.array([10_000, 100])) == 0.55
    assert toxicity.best_threshold(counts / 25, np.array([100, 100])) == toxicity.THRESHOLD


def test_without_toxic_calibrates_a_rare_language(spark):
    rng = np.random.default_rng(9)
    rows, labels = [], []
    for i in range(1200):
        words = rng.choice([f"w{k}" for k in range(300)], 30).tolist()
        if i % 3 == 0:
            words[3] = f"nasty{rng.integers(50)}"
        rows.append((i, " ".join(words), "xx" if i % 30 < 2 else "en"))
        labels.append((i, int(i % 3 == 0)))
    docs, known = spark.createDataFrame(rows, "doc_id long, text string, lang string"), spark.createDataFrame(labels, "doc_id long, toxic int")
    net = toxicity.fit(docs, known, 60)
    scored = toxicity.score(docs, net)
    assert {"xx", "en", None} == set(toxicity.calibrated(scored, known, net))
    kept = {r[0] for r in toxicity.without_toxic(docs, known, 60).select("doc_id").collect()}
    levels = toxicity.calibrated(scored, known, net)
    assert kept == {r["doc_id"] for r in scored.collect() if r["score"] < levels[r["lang"]]}


def test_levels_of_a_long_chain(spark):
    calls = [("c", str(i), [str(i - 1), "0"] if i else []) for i in range(100)] + [("c", "x", ["y", "99"]), ("c", "y", ["x"]), ("d", "1", ["0"])]
    df = spark.createDataFrame(calls, "conv_id string, call_id string, after array<string>")
    got = {(r["conv_id"], r["call_id"]): r["level"] for r in toolcalls.levels(df).collect()}
    assert got == {**{("c", str(i)): 2 * i for i in range(100)}, ("c", "x"): None, ("c", "y"): None, ("d", "1"): 0}


def test_tool_calls(spark):
    calls = [("c", "1", 0, "f", '{"x": 2, "a": "\\u00e9"}', []), ("c", "2", 1, "f", '{"x": "no"}', ["1"]), ("c", "3", 2, "g", "not json", ["2", "gone"]), ("c", "4", 3, "f", "{}", ["5"]), ("c", "5", 4, "f", "{}", ["4"]), (None, None, None, None, None, None)]
    results = [("c", "1", 5, "ok"), ("c", "1", 6, "again"), ("c", "9", 7, "alone")]
    c = spark.createDataFrame([tuple(r[0:2]) + r[2:] for r in calls], "conv_id string, call_id string, turn int, name string, arguments string, after array<string>")
    r = spark.createDataFrame(results, "conv_id string, call_id string, turn int, content string")
    c, r = c.withColumn("conv_id", F.when(F.col("conv_id").isNotNull(), F.lit(1).cast("long"))), r.withColumn("conv_id", F.lit(1).cast("long"))
    rows = toolcalls.linked(c, r, {"f": {"type": "object", "required": ["x"], "properties": {"x": {"type": "integer"}}}}).collect()
    got = {(x["call_id"], x["status"]): (x["valid"], x["level"]) for x in rows}
    assert got == {("1", "linked"): (True, 0), ("1", "orphan"): (None, None), ("2", "open"): (False, 2), ("3", "open"): (False, 4), ("4", "open"): (False, None), ("5", "open"): (False, None), ("9", "orphan"): (None, None), (None, "open"): (False, 0)}
    assert next(x for x in rows if x["call_id"] == "1" and x["status"] == "linked")["json"] == '{"arguments":{"a":"é","x":2},"call_id":"1","content":"ok","name":"f","status":"linked","valid":true}'
