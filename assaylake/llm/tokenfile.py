"""Token-id files: each document's ids compressed by itself with one shared dictionary, and an offset index.

A file is a row of Zstandard frames: a skippable frame with a JSON header (dictionary hash, number type, end id) and the
dictionary; a frame for each document in ascending order of id; a skippable frame with the index (id,
first id within the file, ids, byte offset and length of the frame for each document) and its length, so that one
document is read from the end of the file and its own frame. Files hold ascending ranges of ids; a task begins a new one
before a file grows past a bound, as a reader takes a file up whole.
"""

from __future__ import annotations

import json
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from assaylake.llm.bpe import encoder, tokenizer_file
from assaylake.llm.shared import blocks_for, new_folder, written
from assaylake.llm.zframes import DICTIONARY, FILE_BYTES, FILE_ROWS, INDEX, SEPARATOR, Layout, compressor, decompressor, digest, read_files, sampled, skippable, trained, write_frames

#: One entry of the index; a null id is written as the smallest long.
ENTRY = np.dtype([("doc_id", "<i8"), ("start", "<u8"), ("n_tokens", "<u8"), ("offset", "<u8"), ("length", "<u8")])
NULL_ID = -(1 << 63)
#: A file's name: its range's place, the job's name, and the number of the file within the range, which comes last: the job's name may hold "-c1" too.
FILE_NAME = r"(?:^|/)part-(\d+)-[^/]*-c(\d+)(?:\.[^/]*)?$"
#: Documents and bytes of each that the dictionary is trained on.
SAMPLE, SAMPLE_BYTES = 400, 4096
#: Bytes of text that a range may hold at most, on average; where that takes more ranges than shuffle partitions, their number is set by it.
RANGE_BYTES = 1 << 28


def write_token_files(docs: DataFrame, path: str, folder: str, end_id: int = 2, id_col: str = "doc_id", text_col: str = "text", file_rows: int = FILE_ROWS, file_bytes: int = FILE_BYTES) -> str:
    """Encodes every row's whole text (null: empty), appends end_id and writes the files; returns the dictionary's hash.

    One shuffle deals the texts out by ranges of (id, hash of the text); equal ids keep an order by that hash, so reruns agree. Only the
    dictionary's sample, about twice SAMPLE documents of at most SAMPLE_BYTES each, comes to the driver: the results do not depend on it.
    A file ends before it would pass file_bytes or file_rows rows.
    """
    spark = docs.sparkSession
    spec = tokenizer_file(path)
    enc = encoder(spec)
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    texts, count, mean = sampled(rows, F.col("text"), SAMPLE, SAMPLE_BYTES, 8)
    dictionary = trained(enc.id_bytes([t.decode("utf-8", "replace") for t in texts]))
    sent = spark.sparkContext.broadcast((spec, dictionary))
    end = struct.pack("<I", end_id)

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc, squeeze, layout = encoder(sent.value[0]), compressor(sent.value[1]), Layout(file_rows, file_bytes, closing=1)
        header = json.dumps({"dictionary_sha256": digest(sent.value[1]), "type": "uint32le", "end_id": end_id}).encode()
        head = skippable(DICTIONARY, struct.pack("<I", len(header)) + header + sent.value[1])
        index, start = [], 0

        def closed() -> bytes:
            return skippable(INDEX, np.array(index, ENTRY).tobytes() + struct.pack("<Q", len(index)))

        for batch in batches:
            out = []
            for doc_id, ids in zip(batch.column(0).to_pylist(), enc.id_bytes(batch.column(1).to_pylist()), strict=True):
                ids += end
                frame = squeeze.compress(ids)
                if layout.full(len(frame)):
                    out += [*layout.rest(), closed()]
                    index, start = [], 0
                if not layout.place:
                    layout.add(head)
                    out.append(head)
                index.append((NULL_ID if doc_id is None else doc_id, start, len(ids) // 4, layout.add(frame), len(frame)))
                out.append(frame)
                start += len(ids) // 4
            yield pa.RecordBatch.from_pydict({"frame": pa.array(out, pa.binary())})
        if index:
            yield pa.RecordBatch.from_pydict({"frame": pa.array([closed()], pa.binary())})

    ranges, keys = blocks_for(int(count * mean), RANGE_BYTES), ("doc_id", "tie")
    few = ranges <= int(spark.conf.get("spark.sql.shuffle.partitions"))
    rows = rows.withColumn("tie", F.xxhash64("text"))
    ranged = (rows.repartitionByRange(*keys) if few else rows.repartitionByRange(ranges, *keys)).sortWithinPartitions(*keys)
    write_frames(ranged.select("doc_id", "text").mapInArrow(write, "frame binary"), folder, file_rows)
    return digest(dictionary)


class TokenFile:
    """One file's bytes: its header, index, and the ids of any document."""

    def __init__(self, content: bytes):
        self.content = memoryview(content)
        magic, size = struct.unpack_from("<II", content)
        if magic != DICTIONARY:
            raise ValueError("not a token file")
        length = struct.unpack_from("<I", content, 8)[0]
        self.header = json.loads(content[12 : 12 + length])
        dictionary = bytes(content[12 + length : 8 + size])
        if digest(dictionary) != self.header["dictionary_sha256"]:
            raise ValueError("the dictionary is damaged")
        self.open = decompressor(dictionary)
        end = len(content) - len(SEPARATOR)
        count = struct.unpack_from("<Q", content, end - 8)[0]
        self.index = np.frombuffer(content, ENTRY, count, end - 8 - count * ENTRY.itemsize)

    def ids(self, place: int) -> np.ndarray:
        """The ids of the document at that place of the index, from its own frame alone."""
        entry = self.index[place]
        ids = np.frombuffer(self.open.decompress(self.content[int(entry["offset"]) : int(entry["offset"] + entry["length"])]), "<u4")
        if len(ids) != entry["n_tokens"]:
            raise ValueError("the index does not fit the frame")
        return ids


def read_token_files(spark: SparkSession, folder: str) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) of each document in the files; start counts the ids of all documents before it.

    A folder without such files gives no rows; a missing folder is Spark's PATH_NOT_FOUND error.
    """

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, content in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                if len(raw := content.as_py()) == 0:
                    continue
                file = TokenFile(raw)
                crc = [zlib.crc32(file.ids(i)) for i in range(len(file.index))]
                n = len(crc)
                ids = pa.array(file.index["doc_id"].astype("i8"), mask=file.index["doc_id"] == NULL_ID)
                yield pa.RecordBatch.from_pydict({"path": pa.array([path] * n), "doc_id": ids, "start": pa.array(file.index["start"].astype("i8")), "n_tokens": pa.array(file.index["n_tokens"].astype("i8")), "ids_crc32": pa.array(crc, pa.int64())})

    found = written(read_files(spark, folder).mapInArrow(each, "path string, doc_id long, start long, n_tokens long, ids_crc32 long"), "token-rows")
    # A part's number is its range's place, and the number at the end tells its files apart; the totals are one row for each file.
    number = lambda group: F.regexp_extract("path", FILE_NAME, group).cast("long")
    file = F.struct(number(1).alias("part"), number(2).alias("nth"))
    totals = found.groupBy(file.alias("file")).agg(F.sum("n_tokens").alias("total"))
    before = totals.select("file", (F.sum("total").over(Window.orderBy("file")) - F.col("total")).alias("before"))
    return found.withColumn("file", file).join(before, "file").select("doc_id", (F.col("start") + F.col("before")).alias("start"), "n_tokens", "ids_crc32")


def token_files(docs: DataFrame, path: str, end_id: int = 2) -> DataFrame:
    """Writes docs as token files in the shared folder and reads them back: (doc_id, start, n_tokens, ids_crc32).

    Null ids come first; a null text is the end id alone; repeated rows are documents of their own; other columns,
    whatever their names, are not read; an empty table gives an empty result.
    """
    folder = new_folder(docs.sparkSession, "tokens")
    write_token_files(docs, path, folder, end_id)
    return read_token_files(docs.sparkSession, folder)
