"""Files of individually compressed Zstandard frames, written by Spark's own writer and read back as binary files.

A row's bytes go out as they are (a binary column read as string, by the text writer); the line separator is an empty
skippable frame, which any Zstandard reader passes over. So files are committed as any Spark output is: a
retried task or a lost executor leaves no half file, and any store that Spark writes to will do.
"""

from __future__ import annotations

import hashlib
import struct
from collections.abc import Iterator

import zstandard
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Fixed values of the Zstandard format: frame magic, skippable magics (the second marks a dictionary, the third an index here).
FRAME, SKIP, DICTIONARY, INDEX = 0xFD2FB528, 0x184D2A50, 0x184D2A5D, 0x184D2A5E
#: An empty skippable frame as text: magic 50 2A 4D 18, length 0.
SEPARATOR = "P*M\x18\0\0\0\0"
#: Rows of a file, and bytes from which the next row goes to a new file: a reader takes a file up whole.
FILE_ROWS, FILE_BYTES = 100_000, 1 << 28


def skippable(magic: int, payload: bytes) -> bytes:
    return struct.pack("<II", magic, len(payload)) + payload


def frames(data: bytes | memoryview) -> Iterator[tuple[int, int, int]]:
    """(magic, start, end) of each frame, from the block headers; nothing is decompressed."""
    at = 0
    while at < len(data):
        magic, size = struct.unpack_from("<II", data, at)
        start = at
        if magic & 0xFFFFFFF0 == SKIP:
            at += 8 + size
        elif magic == FRAME:
            descriptor = data[at + 4]
            at += zstandard.frame_header_size(bytes(data[at : at + 18]))
            last = False
            while not last:
                block = int.from_bytes(data[at : at + 3], "little")
                last = bool(block & 1)
                at += 3 + (1 if block >> 1 & 3 == 1 else block >> 3)
            at += 4 * (descriptor >> 2 & 1)
        else:
            raise ValueError(f"no frame at byte {at}")
        yield magic, start, at


def trained(samples: list[bytes], size: int = 65_536) -> bytes:
    """A dictionary of at most size bytes, or b'' where the samples are too few or too alike to train one."""
    samples = [s for s in samples if len(s) >= 8]
    size = min(size, max(1024, sum(map(len, samples)) // 10))
    try:
        return zstandard.train_dictionary(size, samples).as_bytes() if len(samples) >= 8 else b""
    except zstandard.ZstdError:
        return b""


def compressor(dictionary: bytes, level: int = 3) -> zstandard.ZstdCompressor:
    return zstandard.ZstdCompressor(level=level, dict_data=zstandard.ZstdCompressionDict(dictionary) if dictionary else None)


def decompressor(dictionary: bytes) -> zstandard.ZstdDecompressor:
    return zstandard.ZstdDecompressor(dict_data=zstandard.ZstdCompressionDict(dictionary) if dictionary else None)


def digest(dictionary: bytes) -> str:
    return hashlib.sha256(dictionary).hexdigest()


class Layout:
    """Deals a task's rows out to files of exactly `rows` rows each but the last, so that Spark's writer begins a new file there.

    A file that comes to `size` bytes first is filled up with empty rows, which are separators alone. `closing` rows are kept
    free at the end of each file.
    """

    def __init__(self, rows: int, size: int, closing: int = 0):
        self.rows, self.size, self.closing, self.place, self.at = rows, size, closing, 0, 0

    def full(self, length: int) -> bool:
        """True if a file has been begun and a row of that length should go to the next one."""
        return self.place > 0 and (self.place + 1 + self.closing > self.rows or self.at + length > self.size)

    def add(self, frame: bytes) -> int:
        """Takes a row up; where in the file it begins."""
        start = self.at
        self.place += 1
        self.at += len(frame) + len(SEPARATOR)
        return start

    def rest(self) -> list[bytes]:
        """The rows that fill the file up to its closing rows; the next row begins a new file."""
        left = self.rows - self.closing - self.place
        self.place = self.at = 0
        return [b""] * left


def sampled(rows: DataFrame, value: Column, count: int, size: int, seed: int) -> tuple[list[bytes], int, float]:
    """(the first size bytes of about count values, number of rows, their mean length in bytes as the sample has it).

    Each row is drawn with the same chance, so that about 2 * count values of at most size bytes reach the driver from a table of any size;
    of those drawn, count are returned.
    """
    n = rows.count()
    raw = value.cast("binary")
    drawn = rows.where(F.rand(seed) < min(1.0, 2 * count / max(n, 1))).select(F.substring(raw, 1, size).alias("v"), F.octet_length(raw).alias("n")).collect()
    some = [bytes(r["v"]) for r in drawn if r["v"]]
    return sorted(some, key=lambda v: hashlib.md5(v).digest())[:count], n, sum(r["n"] or 0 for r in drawn) / max(1, len(drawn))


def write_frames(rows: DataFrame, folder: str, file_rows: int = FILE_ROWS) -> None:
    """Writes the binary column frame of rows to files, those of a partition holding file_rows rows but for the last."""
    rows.select(F.col("frame").cast("string").alias("value")).write.option("lineSep", SEPARATOR).option("maxRecordsPerFile", file_rows).text(folder)


def read_files(spark: SparkSession, folder: str) -> DataFrame:
    """(path, content) of each file of the folder."""
    return spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(folder).select("path", "content")
