"""Contents of any size, by byte ranges: a data source whose partitions are ranges of files, and digests of files that no row can hold.

Files are opened by the workers through pyarrow's file systems (local and mounted folders, HDFS, S3, GCS), a part at a time.
"""

from __future__ import annotations

import ctypes
import ctypes.util
import functools
import hashlib
import re
from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from assaylake.sources.scratch import cut

try:
    from _hashlib import __file__ as _HASHLIB
except ImportError:  # a Python without OpenSSL, or with it built in
    _HASHLIB = None

#: Bytes read at a time, of a range unless asked otherwise, and of a file that one task hashes.
PART, RANGE, STEP = 1 << 23, 1 << 26, 1 << 27


def place(path: str) -> tuple[fs.FileSystem, str]:
    """The file system of a path or URI, as Spark writes it (nothing is escaped), and the path in it."""
    if not (found := re.match(r"([A-Za-z][A-Za-z0-9+.-]*):(//[^/]*)?(/.*)", path)):
        return fs.LocalFileSystem(), path
    scheme, host, inner = found.groups()
    if scheme == "file":
        return fs.LocalFileSystem(), inner
    system, base = fs.FileSystem.from_uri(f"{scheme}:{host or '//'}/")
    return system, base.rstrip("/") + inner


def parts(path: str, start: int = 0, length: int | None = None, size: int = PART) -> Iterator[bytes]:
    """The bytes of a range of a file, some at a time; a range ends with the file at the latest."""
    system, inner = place(path)
    with system.open_input_file(inner) as file:
        file.seek(start)
        while length is None or length > 0:
            part = file.read(size if length is None else min(size, length))
            if not part:
                break
            length = None if length is None else length - len(part)
            yield part


class Sha256(ctypes.Structure):
    """SHA-256 between two updates, as OpenSSL's <openssl/sha.h> lays it out (SHA256_CTX); hashlib keeps its own to itself."""

    _fields_ = [("h", ctypes.c_uint32 * 8), ("low", ctypes.c_uint32), ("high", ctypes.c_uint32), ("data", ctypes.c_uint32 * 16), ("num", ctypes.c_uint), ("md_len", ctypes.c_uint)]


@functools.cache
def openssl() -> ctypes.CDLL | None:
    """The OpenSSL of this Python's hashlib, or of the machine, if it works on Sha256; None where there is none."""
    for name in filter(None, (_HASHLIB, ctypes.util.find_library("crypto"))):
        try:
            library = ctypes.CDLL(name)
            state = advanced(library, None, [b"a" * 70], False)
            if advanced(library, state, [b"b"], True) == hashlib.sha256(b"a" * 70 + b"b").digest():
                return library
        except (OSError, AttributeError):
            continue
    return None


def advanced(library: ctypes.CDLL, state: bytes | None, content: Iterable[bytes], last: bool) -> bytes:
    """The state of SHA-256 after content, from the state before it (None: the start); with last, the digest."""
    now = Sha256() if state is None else Sha256.from_buffer_copy(state)
    if state is None:
        library.SHA256_Init(ctypes.byref(now))
    for part in content:
        library.SHA256_Update(ctypes.byref(now), ctypes.c_char_p(part), ctypes.c_size_t(len(part)))
    if not last:
        return bytes(now)
    out = ctypes.create_string_buffer(32)
    library.SHA256_Final(out, ctypes.byref(now))
    return out.raw


def whole(path: str, start: int, length: int) -> Iterator[bytes]:
    """As parts(), but an error where the file ends before the range."""
    for part in parts(path, start, length):
        length -= len(part)
        yield part
    if length:
        raise OSError(f"{path} has become shorter while it was read")


def reachable(path: str) -> bool:
    """Whether pyarrow has a file system for the path, and finds the file there."""
    try:
        system, inner = place(path)
        return system.get_file_info(inner).is_file
    except (OSError, ValueError, NotImplementedError):
        return False


def digests(files: DataFrame, algorithm: str = "sha256", step: int = STEP) -> DataFrame:
    """files (path, size, any other columns) with the hash of their first `size` bytes, for files of any size. A null path gives a null hash.

    Each task reads at most `step` bytes of one file, PART at a time, and hands the state of SHA-256 on to the task of the next range, so that a file takes as
    many tasks as it has ranges, one after the other, and files go side by side. Where OpenSSL is not at hand, and for other algorithms, the last task
    reads a file from its start. The plan holds a shuffle for each range of the largest file; its lineage is cut every sixteen.
    """
    n = F.greatest(F.lit(1), F.ceil(F.coalesce("size", F.lit(0)) / step)).cast("int")
    counts = {r["n"]: r["count"] for r in files.groupBy(n.alias("n")).count().collect()}
    if not counts:
        return files.withColumn("hash", F.lit(None).cast("string"))
    # Files are numbered from the one with the most ranges on, so that those with more than r ranges have the first numbers.
    active = [sum(c for k, c in counts.items() if k > r) for r in range(max(counts))]
    before = F.create_map(*(F.lit(x) for k in counts for x in (k, active[k] if k < len(active) else 0)))
    number = before[n] + F.row_number().over(Window.partitionBy(n).orderBy("path")) - 1
    rows = files.select("*", F.lit(None).cast("string").alias("hash"), F.lit(None).cast("binary").alias("__state"), number.alias("__number"))
    for r, tasks in enumerate(active):
        rows = rows.repartitionById(tasks, F.pmod("__number", F.lit(tasks)).cast("int")).mapInArrow(_step(algorithm, r * step, step), rows.schema)
        if r % 16 == 15 and r + 1 < len(active):
            rows = cut(rows)
    return rows.drop("__state", "__number")


def _step(algorithm: str, start: int, step: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def one(path: str, size: int, state: bytes | None) -> tuple[bytes | None, str | None]:
        """(state, None), or (None, hash) once the file has ended."""
        last, library = size <= start + step, openssl() if algorithm == "sha256" else None
        if library and (state is not None or start == 0):
            got = advanced(library, state, whole(path, start, min(step, size - start)), last)
            return (None, got.hex()) if last else (got, None)
        if not last:
            return None, None
        digest = hashlib.new(algorithm)
        for part in whole(path, 0, size):
            digest.update(part)
        return None, digest.hexdigest()

    def ranged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = zip(*(batch[c].to_pylist() for c in ("path", "size", "__state", "hash")))
            got = [(state, done) if path is None or done is not None else one(path, size, state) for path, size, state, done in rows]
            new = {c: pa.array([x[i] for x in got], batch.schema.field(c).type) for i, c in enumerate(("__state", "hash"))}
            yield pa.RecordBatch.from_arrays([new.get(c, batch[c]) for c in batch.schema.names], schema=batch.schema)

    return ranged


class Range(InputPartition):
    def __init__(self, path: str, start: int, length: int):
        self.path, self.start, self.length = path, start, length


class RangeReader(DataSourceReader):
    def __init__(self, options: dict):
        self.path, self.size, self.overlap = options["path"], int(options.get("size", RANGE)), int(options.get("overlap", 0))
        self.pattern = re.compile(options.get("pattern", ""))
        if not 0 < self.size + self.overlap < 1 << 31 or self.overlap < 0:
            raise ValueError("a range and its overlap hold 1 byte to 2 GB")

    def files(self) -> Iterator[tuple[str, int]]:
        system, inner = place(self.path)
        head = self.path[: len(self.path) - len(inner)] if self.path.endswith(inner) else ""
        info = system.get_file_info(inner)
        if info.type == fs.FileType.NotFound:
            raise FileNotFoundError(self.path)
        found = [info] if info.is_file else system.get_file_info(fs.FileSelector(inner, recursive=True))
        for one in sorted(found, key=lambda f: f.path):
            if one.is_file and self.pattern.search(one.base_name):
                yield head + one.path, one.size

    def partitions(self) -> list[Range]:
        return [Range(path, start, min(self.size, size - start)) for path, size in self.files() for start in range(0, size, self.size)]

    def read(self, partition: Range) -> Iterator[tuple]:
        content = b"".join(parts(partition.path, partition.start, partition.length + self.overlap))
        yield partition.path, partition.start, partition.length, content


class ByteRanges(DataSource):
    """Format "byte_ranges": (path, start, length, content) for each range of each file below `path`.

    Options: size, the bytes of a range; overlap, bytes of the next range that content holds besides, for what may lie across a cut (length does not count them);
    pattern, which a file's name must match. An empty file has no ranges. One partition for each range.
    """

    @classmethod
    def name(cls) -> str:
        return "byte_ranges"

    def schema(self) -> str:
        return "path string, start long, length long, content binary"

    def reader(self, schema) -> RangeReader:
        return RangeReader(self.options)


def read_ranges(spark: SparkSession, path: str, **options) -> DataFrame:
    """The ranges of the files below path, see ByteRanges."""
    spark.dataSource.register(ByteRanges)
    return spark.read.format("byte_ranges").options(**options).load(path)
