"""The stages of the corpus pipeline, and all of them together, against plain Python on small tables."""

import hashlib
from collections import Counter

import numpy as np
import pytest

pytest.importorskip("assaylake.llm.queries")
corpus_pipeline = pytest.importorskip("corpus_pipeline")
import public_tokenizers
from tokenizers import Tokenizer

from assaylake.llm import mixing, simhash, toxicity

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, fp string, `key` string, `score` double"
STAGES = dict(corpus_pipeline.STAGES)


def corpus():
    rng = np.random.default_rng(21)
    text = lambda n=40: " ".join(rng.choice([f"w{k}" for k in range(400)], n))
    rows, labels = [], []
    for i in range(300):
        body = text()
        toxic = i % 5 == 0
        if toxic:
            body += f" nasty{rng.integers(9)}"
        rows.append((i, body, "en" if i % 3 else None, f"s{i % 4}"))
        labels.append((i, int(toxic)))
    copies = text()
    rows += [(1000 + i, copies, "en", "hot") for i in range(40)] + [(2000, None, None, None), (2001, "", "xx", "s1"), (None, text(), "en", None), (None, text(), "en", None), (7, text(), "de", "s2"), (3000, text(30_000), "en", "s0"), (1000, copies, "en", "hot")]
    return [(i, t, lang, source, len(t or ""), "clash", "clash", 0.5) for i, t, lang, source in rows], labels


@pytest.fixture(scope="module")
def tables(spark, tmp_path_factory):
    folder = str(tmp_path_factory.mktemp("sf"))
    rows, labels = corpus()
    spark.createDataFrame(rows, SCHEMA).repartition(3).write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, toxic int").write.parquet(f"{folder}/labels.parquet")
    return folder


def test_toxicity_stage_drops_what_reaches_its_threshold(spark, tables):
    docs = spark.read.parquet(f"{tables}/documents.parquet")
    known = spark.read.parquet(f"{tables}/labels.parquet")
    got = STAGES["toxicity"](spark, docs, tables)
    assert got.columns == docs.columns
    net = toxicity.fit(docs, known)
    scores, levels = toxicity.Scorer(net), toxicity.calibrated(toxicity.score(docs, net), known, net)
    want = Counter((r["doc_id"], r["text"]) for r in docs.collect() if scores.scores([r["text"]])[0] < levels.get(r["lang"] or "", levels[None]))
    assert Counter((r["doc_id"], r["text"]) for r in got.collect()) == want
    kept = {i for i, _ in want if i is not None and i < 300}
    assert sum(i % 5 == 0 for i in kept) <= 12 and sum(i % 5 > 0 for i in kept) >= 228


def test_near_dedup_stage_keeps_one_of_each_group(spark, tables):
    docs = spark.read.parquet(f"{tables}/documents.parquet")
    got = STAGES["simhash near-dedup"](spark, docs, tables)
    assert got.columns == docs.columns
    rows = docs.collect()
    prints = [simhash.fingerprint(r["text"]) for r in rows]
    label = list(range(len(rows)))
    for a in range(len(rows)):
        for b in range(a):
            if (prints[a] ^ prints[b]).bit_count() <= 4:
                old, new = max(label[a], label[b]), min(label[a], label[b])
                label = [new if x == old else x for x in label]
    groups = {}
    for r, c in zip(rows, label, strict=True):
        groups.setdefault(c, []).append(r)
    lowest = Counter(min((r["doc_id"] for r in g if r["doc_id"] is not None), default=None) for g in groups.values())
    assert Counter(r["doc_id"] for r in got.collect()) == lowest


def test_mix_stage_takes_words_to_the_targets(spark, tables):
    docs = spark.read.parquet(f"{tables}/documents.parquet")
    got = STAGES["mix sources"](spark, docs, tables)
    assert got.columns == docs.columns
    words = Counter()
    for r in got.collect():
        words[r["source"]] += len(r["text"].split())
    want = {r["source"]: round(r["target"]) for r in mixing.targets(mixing.sizes(docs)).collect()}
    assert words == Counter({s: n for s, n in want.items() if n})


def test_encode_stage_equals_the_library(spark, tables):
    docs = spark.read.parquet(f"{tables}/documents.parquet")
    library = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    want = Counter()
    for r in docs.collect():
        ids = library.encode(r["text"] or "", add_special_tokens=False).ids
        want[r["doc_id"], len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256((r["text"] or "").encode()).hexdigest()] += 1
    assert Counter(map(tuple, STAGES["bpe"](spark, docs, tables).collect())) == want


def test_stages_follow_each_other(spark, tables):
    docs = spark.read.parquet(f"{tables}/documents.parquet")
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "simhash near-dedup", "mix sources", "bpe"]
    for name, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, tables)
        docs = mixing.written(docs, name.replace(" ", "-"))
    key = lambda rows: Counter(map(tuple, rows))
    first = key(corpus_pipeline.run(spark, tables).collect())
    assert first == key(docs.collect()) and first


def test_stages_of_an_empty_table(spark, tables):
    docs = spark.read.parquet(f"{tables}/documents.parquet").limit(0)
    for name, stage in corpus_pipeline.STAGES:
        got = stage(spark, docs, tables)
        assert got.count() == 0 and (name == "bpe" or got.columns == docs.columns)


def test_columns_with_the_names_of_helpers_stay(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet").where("doc_id < 60")
    names = ["__score", "__one", "__two", "__key", "__REP", "__words", "__parts", "key", "rep", "score", "first", "none"]
    docs = docs.selectExpr("*", *(f"doc_id * {n + 2} AS {c}" for n, c in enumerate(names)))
    labels = spark.read.parquet(f"{sf}/labels.parquet")
    for got in (toxicity.without_toxic(docs, labels), simhash.keep_first(docs), mixing.mixed_documents(docs)):
        assert got.columns == docs.columns
        found = got.collect()
        assert found and all(r[c] == r["doc_id"] * (n + 2) for r in found for n, c in enumerate(names))
