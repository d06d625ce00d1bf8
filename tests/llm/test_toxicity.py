"""The classifier against a plain convolution, and the cases its tables may hold."""

import math

import numpy as np
import pytest

pytest.importorskip("assaylake.llm.queries")
from assaylake.llm import toxicity


def plain_score(net, text):
    """The forward pass as it is written down: embed, slide each filter over the padded words, take the maximum, add up."""
    rows = [net.rows[list(toxicity.word_rows(w))].sum(0).astype(float) for w in toxicity.words(text)]
    length = max(1, len(rows))
    rows += [np.zeros(toxicity.SIZE)] * (length - len(rows) + max(toxicity.WIDTHS) - 1)
    hidden = []
    for width in toxicity.WIDTHS:
        for f in range(toxicity.FILTERS):
            values = [sum(rows[i + j] @ net.filters[width][j][:, f] for j in range(width)) for i in range(length)]
            hidden.append(max(0.0, max(values) + net.bias[width][f]))
    return 1 / (1 + math.exp(-(float(np.dot(hidden, net.out)) + net.shift)))


def test_scores_equal_a_plain_convolution():
    rng = np.random.default_rng(4)
    net = toxicity.Net.new(3)
    net.bias = {w: rng.normal(0, 0.1, toxicity.FILTERS).astype(np.float32) for w in toxicity.WIDTHS}
    net.shift = -0.2
    texts = [None, "", " ", "one", "one two", "a b c d e f g", "é ß Ω 日本語 ok", "same same same same", " ".join(rng.choice(["x", "yy", "zzz", "w w"], 300)), "1,2;3"]
    for most in (3, 200_000):  # texts are scored in batches of bounded size
        got = toxicity.Scorer(net, most).scores(texts)
        assert np.allclose(got, [plain_score(net, t) for t in texts], atol=1e-5)


def test_training_lowers_the_loss():
    rng = np.random.default_rng(2)
    texts, labels = [], []
    for i in range(120):
        words = rng.choice([f"w{k}" for k in range(50)], 12).tolist()
        if i % 2:
            words[i % 12] = "awful"
        texts.append(" ".join(words))
        labels.append(i % 2)
    got = toxicity.Scorer(toxicity.train(texts, labels, shown=3000)).scores(texts)
    assert ((got > 0.5) == np.array(labels)).mean() > 0.95


def test_tables_of_all_kinds(spark):
    rng = np.random.default_rng(6)
    rows, labels = [], []
    for i in range(400):
        words = rng.choice([f"w{k}" for k in range(200)], 30).tolist()
        if i % 2 == 0:
            words[3] = f"nasty{rng.integers(20)}"
        rows.append((i, " ".join(words), None if i % 7 == 0 else "en", 0.5))
        labels.append((i, int(i % 2 == 0)))
    long_text = "fine words " * 40_000 + "nasty3"  # the only bad word stands far behind what training reads
    rows += [(1000, long_text, "en", 0.5), (5, rows[5][1], "en", 0.5), (5, "another text of the same id", "en", 0.5), (None, "nasty1", None, 0.5), (None, None, None, None)]
    labels += [(1000, 1), (7, 0), (7, 1), (8, None), (9, 5), (None, 1)]  # one labelled both ways, labels that are none
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, score double")
    known = spark.createDataFrame(labels, "doc_id long, toxic int")
    got = toxicity.toxicity(docs, known)
    assert got.columns == ["doc_id", "held_out", "score", "predicted"]
    found = got.toPandas()
    assert len(found) == len(rows) and found.score.between(0, 1).all() and ((found.score >= 0.3) == (found.predicted == 1)).all()
    assert found[found.doc_id.isna()].held_out.eq(False).all()
    assert toxicity.toxicity(docs.limit(0), known).count() == 0
    assert toxicity.without_toxic(docs.limit(0), known).columns == docs.columns
    net = toxicity.fit(docs, known, 30, 50)
    assert len(net.taught) <= 60
    assert toxicity.fit(docs, known.where("toxic = 0")).taught == []


def test_copies_of_a_labelled_id_reach_the_driver_once(spark):
    docs = spark.createDataFrame([(i % 3, f"text {i} " + ("bad" if i % 3 else "good"), "en") for i in range(3000)], "doc_id long, text string, lang string")
    labels = spark.createDataFrame([(0, 0), (1, 1), (2, 1)], "doc_id long, toxic int")
    assert len(toxicity.fit(docs, labels, 10).taught) <= 3
