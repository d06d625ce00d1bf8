"""Document scores against the mixture written out in plain Python, over one chunk and over many."""

import math
import zlib
from collections import Counter

import numpy as np
import pytest

pytest.importorskip("assaylake.llm.queries")
import public_tokenizers

from assaylake.llm import lattice

PATH = public_tokenizers.path("piece_bpe_32k.model")


def corpus():
    rng = np.random.default_rng(12)
    words = [f"w{k}" for k in range(40)]
    rows = [(i, " ".join(["the", *rng.choice(words, int(rng.integers(0, 12)))]) if i % 9 else None, ["en", "de", None, "xx", "fr", "es", "it"][int(rng.integers(7)) if i % 3 else 0]) for i in range(150)]
    return [*rows, (None, "the w1 unseen", "en"), (10, "The\tW1  the", "de"), (10, "the", "de"), (200, "q" * 300 + " w2", "en"), (201, "", "zz")]


def brute(rows):
    """(held_out, n_tokens, n_known, train_tokens, base, score) of each row, from counts in dictionaries."""
    held = lambda i: i is None or zlib.crc32(str(i).encode()) % 10 == 0
    langs = Counter(r[2] for r in rows if r[2] is not None)
    frequent = sorted(langs, key=lambda x: (-langs[x], x))[: lattice.LANGUAGES]
    k = len(frequent) + 1
    group = lambda x: frequent.index(x) if x in frequent else k - 1
    counts, docs, tokens = [Counter() for _ in range(k)], np.zeros(k), np.zeros(k)
    for i, text, lang in rows:
        if not held(i):
            counts[group(lang)].update(found := lattice.words_of(text))
            docs[group(lang)] += 1
            tokens[group(lang)] += len(found)
    pieces = lattice.Pieces(open(PATH, "rb").read())
    known = sorted({w for c in counts for w in c})
    piece_counts = pieces.counts([w.decode() for w in known], np.array([[c[w] for w in known] for c in counts]))
    model = lattice.Lattice(pieces, piece_counts, tokens + docs)
    variety, n = np.array([len(c) for c in counts]) + 1.0, docs + tokens
    seen = Counter()
    for c in counts:
        seen.update(c)
    out = []
    for i, text, _ in rows:
        found = lattice.words_of(text)
        log = np.log((docs + 1e-9) / (docs.sum() + k * 1e-9))
        base = 0.0
        for w in [*found, None]:
            own = docs if w is None else np.array([c[w] for c in counts], float)
            spelled = model.log_chance(["" if w is None else w.decode()])[0]
            word = [math.log(o) + math.log1p(v / o * math.exp(x)) if o else math.log(v) + x for o, v, x in zip(own, variety, spelled, strict=True)]
            log = log + np.array(word) - np.log(n + variety)
            base += math.log10(((docs.sum() if w is None else seen[w]) + 0.1) / (n.sum() + 0.1 * (len(seen) + 2)))
        top = log.max()
        out.append((held(i), len(found) + 1, sum(seen[w] > 0 for w in found) + 1, int(n.sum()), base, (top + math.log(np.exp(log - top).sum())) / math.log(10)))
    return out


@pytest.mark.parametrize("docs_in_chunk", [4000, 7])
def test_scores_equal_the_mixture_written_out(spark, monkeypatch, docs_in_chunk):
    rows = corpus()
    df = spark.createDataFrame([(*r, "clash", 1) for r in rows], "doc_id long, text string, lang string, words string, chunk long").repartition(2)
    made = lattice._chunks
    monkeypatch.setattr(lattice, "_chunks", lambda docs, model, languages: made(docs, model, languages, docs_in_chunk))
    got = sorted((r["doc_id"] if r["doc_id"] is not None else -1, r["held_out"], r["n_tokens"], r["n_known"], r["train_tokens"], r["base_score"], r["score"]) for r in lattice.lattice_scores(df, PATH).collect())
    want = sorted((r[0] if r[0] is not None else -1, *b) for r, b in zip(rows, brute(rows), strict=True))
    assert len(got) == len(want)
    for g, w in zip(got, want, strict=True):
        assert g[:5] == w[:5] and math.isclose(g[5], w[5], rel_tol=1e-9) and math.isclose(g[6], w[6], rel_tol=1e-6)


def test_no_rows_and_no_training_rows(spark):
    schema = "doc_id long, text string"
    assert lattice.lattice_scores(spark.createDataFrame([], schema), PATH).count() == 0
    held = [i for i in range(200) if zlib.crc32(str(i).encode()) % 10 == 0][:3]
    got = lattice.lattice_scores(spark.createDataFrame([(i, "some words") for i in held], schema), PATH).collect()
    assert len(got) == 3 and all(r["train_tokens"] == 0 and r["n_known"] == 0 and math.isfinite(r["score"]) for r in got)


def test_no_row_holds_the_words_of_a_chunk(spark):
    """A reader of the chunks holds thousands of rows at a time."""
    text = " ".join(f"word{k % 3000}" for k in range(4000))
    df = spark.createDataFrame([(1, text, "en"), (2, "word7 other", "xx")], "doc_id long, text string, lang string").coalesce(1)
    got = lattice._chunks(df, spark.sparkContext.broadcast(open(PATH, "rb").read()), ["en"]).collect()
    words, texts = [r for r in got if r["word"] is not None], [r for r in got if r["word"] is None]
    assert len(words) == 3001 and [r["word"] for r in words] == sorted(r["word"] for r in words) and len(texts) == 1 and texts[0]["sizes"] == [4000, 2]
    assert {r["word"]: (r["c0"], r["c1"]) for r in words if r["word"] in ("word7", "word2999", "other")} == {"word7": (2, 1), "word2999": (1, 0), "other": (0, 1)}
    assert max(len(v) for r in got for v in r if isinstance(v, list)) < 10_000
