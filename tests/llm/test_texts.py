"""Very long texts, tables that forget, empty tables and clashing names for the text operators."""

import hashlib
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

pytest.importorskip("assaylake.llm.queries")
import public_tokenizers
from tokenizers import Tokenizer

from assaylake.llm import bpe, simhash, tokenfile

PATH = public_tokenizers.path("byte_bpe_50k.json")


def long_text(words=80_000):
    rng = np.random.default_rng(31)
    return " ".join(f"w{w}é" if i % 97 == 0 else f"w{w}" for i, w in enumerate(rng.integers(0, 50_000, words)))


def test_a_text_of_more_segments_than_a_part():
    text, library = long_text(), Tokenizer.from_file(PATH)
    ids = library.encode(text, add_special_tokens=False).ids
    enc = bpe.Encoder(bpe.tokenizer_file(PATH))
    assert len(enc.segments(text)) > 1 << 16
    want = (len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(text.encode()).hexdigest())
    assert enc.round_trip(text) == want == enc.round_trip(text, part=777)
    assert enc.round_trip("") == enc.round_trip(None) == (0, hashlib.sha256(b"").hexdigest(), hashlib.sha256(b"").hexdigest())


def test_tables_that_forget(monkeypatch):
    monkeypatch.setattr(bpe, "KEPT_BINARY", 50)
    text, library = long_text(3000), Tokenizer.from_file(PATH)
    enc = bpe.Encoder(bpe.tokenizer_file(PATH))
    enc.decimal = bpe.Kept(enc.decimal.make, 40)
    ids = library.encode(text, add_special_tokens=False).ids
    assert enc.round_trip(text)[:2] == (len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest())
    assert len(enc.decimal) + len(enc.decimal.old) <= 80
    for _ in range(2):
        assert enc.id_bytes([text, text[:500], None]) == [np.array(library.encode(t, add_special_tokens=False).ids, "<u4").tobytes() for t in (text, text[:500], "")]


def test_token_files_of_a_long_text(spark):
    text, library = long_text(), Tokenizer.from_file(PATH)
    df = spark.createDataFrame([(1, text, "clash"), (1, "short", "clash"), (None, None, "clash")], "doc_id long, text string, start string")
    got = {(r["n_tokens"], r["ids_crc32"]) for r in tokenfile.token_files(df, PATH).collect()}
    for t in (text, "short", ""):
        ids = np.array([*library.encode(t, add_special_tokens=False).ids, 2], "<u4")
        assert (len(ids), zlib.crc32(ids.tobytes())) in got


def test_simhash_of_long_texts_and_clashing_names(spark):
    text = long_text()
    rows = [(5, text), (3, text + " end"), (9, text.encode().upper().decode()), (1, None), (2, ""), (2, ""), (None, " \t")]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumns({c: F.lit("clash") for c in ("fp", "first", "component", "component_id", "fingerprint", "shard", "a")})
    got = sorted((r["doc_id"] or 0, r["component_id"]) for r in simhash.simhash_components(df).collect())
    assert got == [(0, 1), (1, 1), (2, 1), (2, 1), (3, 3), (5, 3), (9, 3)]
    kept = simhash.keep_first(df)
    assert kept.columns == df.columns and sorted(r["doc_id"] for r in kept.collect()) == [1, 3]
    assert simhash.simhash_components(df.limit(0)).count() == 0 and simhash.keep_first(df.limit(0)).count() == 0
    words = text.lower().encode().split()
    ones = np.zeros(64, int)
    import xxhash

    for i in range(len(words) - 3):
        h = xxhash.xxh64_intdigest(b" ".join(words[i : i + 4]), 42)
        ones += np.array([h >> b & 1 for b in range(64)])
    assert simhash.fingerprint(text) == sum(int(2 * o > len(words) - 3) << b for b, o in enumerate(ones))
