"""Archives and token files: roll-over, order, single-document access, long texts."""

import glob
import hashlib
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

pytest.importorskip("assaylake.llm.queries")
import public_tokenizers
import zstandard
from tokenizers import Tokenizer

from assaylake.llm import shared, tokenfile, warc, zframes

PATH = public_tokenizers.path("byte_bpe_50k.json")


def local(folder):
    return sorted(glob.glob(folder.removeprefix("file:") + "/part-*"))


@pytest.mark.parametrize(("file_rows", "file_bytes"), [(7, 1 << 28), (100, 2500)])
def test_archives_roll_over(spark, file_rows, file_bytes):
    rows = [(i, f"http://x/{i}", f"<p>{'ab ' * (i % 9)}{i}</p>" * 20) for i in range(60)] + [(60, None, "x" * 300_000)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string")
    folder = shared.new_folder(spark, "warc")
    warc.write_archives(df.repartition(2), folder, file_rows=file_rows, file_bytes=file_bytes)
    got = {r["page_id"]: (r["payload_bytes"], r["payload_digest"]) for r in warc.read_archives(spark, folder).collect()}
    assert got == {i: (len(h), hashlib.sha256(h.encode()).hexdigest()) for i, _, h in rows}
    files = local(folder)
    assert len(files) > 4
    for path in files:
        data = open(path, "rb").read()
        kinds = [m for m, start, end in zframes.frames(data) if not (m == zframes.SKIP and end - start == 8)]
        assert kinds[0] == zframes.DICTIONARY and set(kinds[1:]) == {zframes.FRAME}
        assert len(data) < 2500 + 70_000 or file_rows == 7
        first = next(i for i, (m, _, _) in enumerate(zframes.frames(data)) if m == zframes.FRAME)
        dictionary, (_, start, end) = next(data[s + 8 : e] for m, s, e in zframes.frames(data) if m == zframes.DICTIONARY), list(zframes.frames(data))[first]
        opened = zstandard.ZstdDecompressor(dict_data=zstandard.ZstdCompressionDict(dictionary)).decompress(data[start:end])
        assert b"WARC-Type: warcinfo" in opened and warc.parsed(opened) is None


@pytest.mark.parametrize(("file_rows", "file_bytes"), [(5, 1 << 28), (100, 3000)])
def test_token_files_roll_over(spark, file_rows, file_bytes):
    library = Tokenizer.from_file(PATH)
    texts = [f"text {i} " + "some words and more, " * (i % 13) for i in range(50)]
    texts[20] = "very long text with many different words: " + " ".join(f"w{i}" for i in range(40_000))
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    folder = shared.new_folder(spark, "tokens")
    tokenfile.write_token_files(df, PATH, folder, file_rows=file_rows, file_bytes=file_bytes)
    assert len(local(folder)) > 2
    got = {r[0]: tuple(r)[1:] for r in tokenfile.read_token_files(spark, folder).collect()}
    start, want = 0, {}
    for i, text in enumerate(texts):
        ids = np.array([*library.encode(text, add_special_tokens=False).ids, 2], "<u4")
        want[i] = (start, len(ids), zlib.crc32(ids.tobytes()))
        start += len(ids)
    assert got == want
    for path in local(folder):  # one document from the index and its own frame
        if content := open(path, "rb").read():
            file = tokenfile.TokenFile(content)
            last = len(file.index) - 1
            assert zlib.crc32(file.ids(last)) == want[int(file.index["doc_id"][last])][2]


def test_files_are_ordered_by_number(spark, monkeypatch):
    paths = ["part-00002-u-c000.txt", "part-00010-u-c000.txt", "part-100000-u-c000.txt", "part-100000-u-c001.txt", "part-100000-u-c1000.txt"]
    df = spark.createDataFrame([(f"file:/x/{p}", n, 0, 1, 0) for n, p in enumerate(paths)], "path string, doc_id long, start long, n_tokens long, ids_crc32 long")
    monkeypatch.setattr(tokenfile, "written", lambda *_: df)
    monkeypatch.setattr(tokenfile, "read_files", lambda *_: df.select("path", F.lit(b"").alias("content")))
    assert {r["doc_id"]: r["start"] for r in tokenfile.read_token_files(spark, "").collect()} == {n: n for n in range(5)}


@pytest.mark.parametrize("job", ["a1b2-c1d2-e3f4", "c001", "x-c7-c12", "part-9-c3"])
def test_a_job_name_is_no_file_number(spark, monkeypatch, job):
    paths = [f"file:/x/part-77-c5/part-{part:05d}-{job}-c{nth:03d}.txt" for part in range(3) for nth in (0, 1, 2, 10)]
    df = spark.createDataFrame([(p, n, 0, 1, 0) for n, p in enumerate(paths)], "path string, doc_id long, start long, n_tokens long, ids_crc32 long")
    monkeypatch.setattr(tokenfile, "written", lambda *_: df)
    monkeypatch.setattr(tokenfile, "read_files", lambda *_: df.select("path", F.lit(b"").alias("content")))
    assert {r["doc_id"]: r["start"] for r in tokenfile.read_token_files(spark, "").collect()} == {n: n for n in range(12)}


def test_an_empty_folder_gives_no_documents(spark):
    folder = shared.new_folder(spark, "tokens")
    tokenfile.write_token_files(spark.createDataFrame([], "doc_id long, text string"), PATH, folder)
    assert tokenfile.read_token_files(spark, folder).count() == 0


def test_a_sample_is_bounded_and_whole_where_small(spark):
    df = spark.range(50_000, numPartitions=16).select(F.repeat(F.lit("x"), 100).alias("t"))
    some, n, mean = zframes.sampled(df, F.col("t"), 100, 10, 1)
    assert len(some) == 100 and set(some) == {b"x" * 10} and n == 50_000 and mean == 100
    assert len(zframes.sampled(df.limit(30), F.col("t"), 100, 10, 1)[0]) == 30
    assert zframes.sampled(df.limit(0), F.col("t"), 100, 10, 1) == ([], 0, 0)
