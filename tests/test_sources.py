"""Files of any size: ranges, digests, and scans."""

import hashlib
from collections import Counter

import pyarrow as pa
import pytest
from pyspark import TaskContext
from pyspark.sql import functions as F

from assaylake.sources import io, ranges


def test_ranges_hold_every_byte_once(spark, tmp_path):
    data = {"a.bin": bytes(range(256)) * 40, "deep/b.bin": b"xyz" * 33, "empty.bin": b"", "c.txt": b"text", "odd name ü.bin": b"1234567890"}
    for name, content in data.items():
        (tmp_path / name).parent.mkdir(exist_ok=True)
        (tmp_path / name).write_bytes(content)
    got = ranges.read_ranges(spark, str(tmp_path), size=100, overlap=7).orderBy("path", "start").collect()
    whole, over = {}, {}
    for r in got:
        name = r["path"].removeprefix(f"{tmp_path}/")
        assert r["start"] == len(whole.get(name, b"")) and r["length"] <= 100
        whole[name] = whole.get(name, b"") + bytes(r["content"][: r["length"]])
        over[name] = bytes(r["content"][r["length"] :]) == data[name][r["start"] + r["length"] :][:7] and over.get(name, True)
    assert whole == {n: c for n, c in data.items() if c} and all(over.values())
    some = ranges.read_ranges(spark, f"file:{tmp_path}", size=1000, pattern=r"\.bin$")
    counts = some.select(F.explode(F.regexp_extract_all(F.hex("content"), F.lit("(..)"), F.lit(1))).alias("byte")).groupBy("byte").count().collect()
    want = {}
    for n, c in data.items():
        for b in c if n.endswith(".bin") else b"":
            want[f"{b:02X}"] = want.get(f"{b:02X}", 0) + 1
    assert {r["byte"]: r["count"] for r in counts} == want
    with pytest.raises(Exception, match="nothing-here"):
        ranges.read_ranges(spark, str(tmp_path / "nothing-here")).collect()
    with pytest.raises(Exception, match="2 GB"):
        ranges.read_ranges(spark, str(tmp_path), size=0).collect()


def test_scan_hashes_files_that_no_row_holds(spark, tmp_path, monkeypatch):
    size = 3 * (1 << 30) + 5
    with open(tmp_path / "huge.exe", "wb") as file:  # sparse
        file.write(b"begin")
        file.truncate(size)
    (tmp_path / "small file.exe").write_bytes(b"small")
    want = hashlib.sha256(b"begin")
    zeros, left = bytes(1 << 24), size - 5
    while left:
        want.update(zeros[: min(left, len(zeros))])
        left -= min(left, len(zeros))
    got = {r["path"].rsplit("/", 1)[1]: (r["size"], r["hash"], r["format"]) for r in io.scan_files(spark, str(tmp_path), formats={"exe": "PE32"}, scope=["PE"]).collect()}
    assert got["huge.exe"] == (size, want.hexdigest(), "PE32") and {v[1] for k, v in got.items() if k != "huge.exe"} == {hashlib.sha256(b"small").hexdigest()}
    listed = io.scan_files(spark, str(tmp_path), hashed=False).collect()
    assert len(listed) == 2 and {r["hash"] for r in listed} == {None}
    monkeypatch.setattr(io, "LARGEST", 2)
    assert {r["hash"] for r in io.scan_files(spark, str(tmp_path), glob="small*").collect()} == {hashlib.sha256(b"small").hexdigest()}


SIZES = (0, 1, 99, 100, 101, 640, 640, 1700, 1801)


def _files(folder):
    """Files of SIZES, and (path, size, hash) of each."""
    out = []
    for i, n in enumerate(SIZES):
        data = bytes((i + 7 * k * k) % 251 for k in range(n))
        (folder / f"{i}.bin").write_bytes(data)
        out.append((f"{folder}/{i}.bin", n, hashlib.sha256(data).hexdigest()))
    return out


def test_a_task_hashes_one_range_of_one_file(spark, tmp_path, monkeypatch):
    (folder := tmp_path / "files").mkdir()
    log, real = str(tmp_path), ranges._step

    def logged(algorithm, start, step):
        step_of = real(algorithm, start, step)

        def run(batches):
            for batch in batches:
                with open(f"{log}/read-{start}-{TaskContext.get().taskAttemptId()}", "a") as out:
                    out.writelines(f"{min(step, n - start)}\n" for n in batch["size"].to_pylist() if n is not None and n > start)
                yield from step_of(iter([batch]))

        return run

    monkeypatch.setattr(ranges, "_step", logged)
    files = _files(folder)
    got = ranges.digests(spark.createDataFrame([f[:2] for f in files] + [(None, None)], "path string, size long"), step=100).collect()
    assert sorted(tuple(r) for r in got if r["path"]) == sorted(files) and [r["hash"] for r in got if not r["path"]] == [None]
    reads = [[int(n) for n in one.read_text().split()] for one in tmp_path.glob("read-*")]
    assert max(map(len, reads)) == 1 and max(map(sum, reads)) == 100 and sum(map(sum, reads)) == sum(SIZES)
    other = ranges.digests(spark.createDataFrame([f[:2] for f in files], "path string, size long"), "md5", step=1000).collect()
    assert all(r["hash"] == hashlib.md5(open(r["path"], "rb").read()).hexdigest() for r in other)


@pytest.mark.parametrize("lacking", [(), range(19), (0,), (3,), (18,)])
def test_ranges_are_read_once_or_by_the_last_task_where_openssl_lacks(tmp_path, monkeypatch, lacking):
    library, reads, parts = ranges.openssl(), Counter(), ranges.parts

    def counted(path, start=0, length=None, size=ranges.PART):
        for part in parts(path, start, length, size):
            reads[path, r] += len(part)
            yield part

    monkeypatch.setattr(ranges, "parts", counted)
    monkeypatch.setattr(ranges, "openssl", lambda: None if r in lacking else library)
    files = _files(tmp_path)
    batch = pa.RecordBatch.from_arrays([pa.array([f[0] for f in files]), pa.array([f[1] for f in files]), pa.nulls(len(files), pa.string()), pa.nulls(len(files), pa.binary())], names=["path", "size", "hash", "__state"])
    for r in range(19):
        (batch,) = ranges._step("sha256", r * 100, 100)(iter([batch]))
    assert batch["hash"].to_pylist() == [f[2] for f in files] and batch["__state"].null_count == len(files)
    if not lacking:
        assert max(reads.values()) == 100 and sum(reads.values()) == sum(SIZES)


def test_a_file_that_becomes_shorter_is_an_error(tmp_path):
    (tmp_path / "a.bin").write_bytes(b"short")
    assert b"".join(ranges.whole(f"{tmp_path}/a.bin", 1, 4)) == b"hort"
    with pytest.raises(OSError, match="shorter"):
        list(ranges.whole(f"{tmp_path}/a.bin", 0, 6))


def test_scan_reads_whole_files_where_only_spark_reaches_the_store(spark, tmp_path, monkeypatch):
    files = _files(tmp_path)
    spark.sparkContext._jsc.hadoopConfiguration().set("fs.viewfs.mounttable.scans.link./in", f"file://{tmp_path}")
    monkeypatch.setattr(io, "LARGEST", 100)
    for folder in (str(tmp_path), "viewfs://scans/in"):
        got = {r["path"].rsplit("/", 1)[1]: (r["size"], r["hash"]) for r in io.scan_files(spark, folder, glob="*.bin").collect()}
        assert got == {path.rsplit("/", 1)[1]: (n, h) for path, n, h in files if n}  # Spark lists no empty files


def test_a_log_grows_and_takes_new_columns(spark, tmp_path):
    folder = str(tmp_path / "log")
    assert io.append_log(spark.createDataFrame([("a", 1.0)], "model string, f double"), folder).count() == 1
    io.append_log(spark.createDataFrame([("b", 2)], "model string, n int"), folder)
    got = io.append_log(spark.createDataFrame([], "model string, f double"), folder)
    assert sorted(map(tuple, got.select("model", "f", "n").collect())) == [("a", 1.0, None), ("b", None, 2)]
