"""Token counts against the library: every text of the tables, random letters, runs, very long pre-tokens, and the cases of a table."""

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

pytest.importorskip("assaylake.llm.queries")
import public_tokenizers
import sentencepiece

from assaylake.llm import queries, tokencounts

PATH = public_tokenizers.path("piece_bpe_32k.model")
LIBRARY = sentencepiece.SentencePieceProcessor(model_file=PATH)
COUNTER = tokencounts.PieceCounter(open(PATH, "rb").read())


def want(texts):
    return [len(LIBRARY.encode(t or "")) for t in texts]


def test_registered_query_equals_the_library(spark, sf):
    got = {r["doc_id"]: tuple(r) for r in queries.op13_token_counts(spark, sf).collect()}
    rows = spark.read.parquet(f"{sf}/documents.parquet").collect()
    assert got == {r["doc_id"]: (r["doc_id"], len((r["text"] or "").encode()), n, n > 4096) for r, n in zip(rows, want([r["text"] for r in rows]), strict=True)}
    assert any(r[3] for r in got.values())


@settings(max_examples=300, deadline=None)
@given(st.lists(st.text(st.sampled_from("aabcdeest  \n\t▁<s>/0x0A>éüß漢字の😀\0ﬁ") | st.characters(codec="utf-8"), max_size=60), max_size=6))
def test_random_texts(texts):
    assert COUNTER.counts(texts) == want(texts)


def test_special_strings_runs_and_space():
    texts = ["", " ", "   ", "a  b   c", " x ", "<s>", "</s> <unk> <0x0A>", "▁", "▁▁a▁", "a\n\nb \n c\n", "\n", " \n ", "\ta\r\nb", "a\0b", "１２３", "é", " x y", None]
    texts += [c * n for c in "a =-_\n#é漢xo0." for n in (2, 3, 7, 16, 17, 33, 100, 1000)] + ["ab" * 500, "the" * 300, "hahaha" * 50, " " * 999 + "x" + " " * 77]
    assert COUNTER.counts(texts) == want(texts)


def test_long_sequences_and_their_queue(monkeypatch):
    rng = np.random.default_rng(13)
    runs = ["".join(rng.choice(list("abcdefghijklmnopqrstuvwxyzABCDEF0123456789+/"), n)) for n in (300, 5_000, 40_000)]
    texts = [*runs, "ing" * 9_000, " " * 5_000, "x" * 60_000, " ".join(runs)]
    assert COUNTER.counts(texts) == want(texts)
    for letters, rounds in ((50, 1 << 10), (1 << 16, 3)):
        monkeypatch.setattr(tokencounts, "QUEUE_LETTERS", letters)
        monkeypatch.setattr(tokencounts, "QUEUE_ROUNDS", rounds)
        assert tokencounts.PieceCounter(open(PATH, "rb").read()).counts(texts) == want(texts)


def test_kept_table_stays_bounded(monkeypatch):
    monkeypatch.setattr(tokencounts, "KEPT", 50)
    monkeypatch.setattr(tokencounts, "CHARS", 400)
    own = tokencounts.PieceCounter(open(PATH, "rb").read())
    texts = [f"word{n} other{n * 7} {'long' * n}" for n in range(200)]
    assert own.counts(texts) == want(texts)
    assert len(own.known) < 200 and max(map(len, own.known)) <= tokencounts.LONGEST


def test_cases_of_a_table(spark):
    rows = [(1, "some text"), (1, "some text"), (None, "no id"), (2, None), (3, ""), (4, "word " * 5_000)]
    df = spark.createDataFrame([(*r, 9, 9, "x") for r in rows], "doc_id long, text string, n_tokens int, n_bytes int, over_limit string")
    got = sorted(map(tuple, tokencounts.token_counts(df, PATH).collect()), key=repr)
    assert got == sorted([(i, len((t or "").encode()), n, n > 4096) for (i, t), n in zip(rows, want([t for _, t in rows]), strict=True)], key=repr)
    assert tokencounts.token_counts(df.limit(0), PATH).collect() == []


def test_other_models_are_refused():
    with pytest.raises(Exception):
        tokencounts.PieceCounter(b"no model")
