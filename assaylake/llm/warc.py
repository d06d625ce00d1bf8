"""WARC archives with a shared Zstandard dictionary, one frame for each record.

The dictionary is built from records of the table, stands in a leading skippable frame of each file, and each record is
compressed by itself, so that a reader can begin at any record. Each file opens with a warcinfo record. Of records with equal
payloads one is a response and the others revisit it.
"""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Iterator
from urllib.parse import quote

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from assaylake.llm.shared import new_folder
from assaylake.llm.zframes import DICTIONARY, FILE_BYTES, FILE_ROWS, FRAME, Layout, compressor, decompressor, frames, read_files, sampled, skippable, trained, write_frames

#: Payloads of fewer bytes are always responses.
LEAST = 100
#: Records and bytes of each that the dictionary is trained on.
SAMPLE, SAMPLE_BYTES = 300, 8192
#: Fixed value of WARC 1.1: the profile of a revisit by payload digest.
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
NO_ID = "none"


def _name(page_id: int | None) -> str:
    return f"<urn:page:{NO_ID if page_id is None else page_id}>"


def _page(name: str) -> int | None:
    value = name.rpartition(":")[2].rstrip(">")
    return None if value == NO_ID else int(value)


def record(page_id: int | None, url: str | None, payload: bytes | None, size: int, digest: str, refers_to: int | None, date: str = "1970-01-01T00:00:00Z") -> bytes:
    """A response record (payload given) or a revisit record (payload None), uncompressed."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {size}\r\n\r\n".encode()
    block = http + (payload or b"")
    lines = [
        "WARC/1.1",
        f"WARC-Type: {'revisit' if payload is None else 'response'}",
        f"WARC-Record-ID: {_name(page_id)}",
        f"WARC-Date: {date}",
        f"WARC-Target-URI: {quote(url, safe=':/?#[]@!$&()*+,;=%~-._') if url else _name(page_id)[1:-1]}",
        f"WARC-Payload-Digest: sha256:{digest}",
        "Content-Type: application/http; msgtype=response",
        f"Content-Length: {len(block)}",
    ]
    if payload is None:
        lines[4:4] = [f"WARC-Profile: {PROFILE}", f"WARC-Refers-To: {_name(refers_to)}"]
    return "\r\n".join(lines).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def information(name: str, date: str = "1970-01-01T00:00:00Z") -> bytes:
    """The warcinfo record of a file, uncompressed; name tells its record from others."""
    block = b"format: WARC File Format 1.1\r\nconformsTo: http://iipc.github.io/warc-specifications/specifications/warc-format/warc-1.1/\r\n"
    lines = ["WARC/1.1", "WARC-Type: warcinfo", f"WARC-Record-ID: <urn:uuid:{uuid.uuid5(uuid.NAMESPACE_OID, name)}>", f"WARC-Date: {date}", "Content-Type: application/warc-fields", f"Content-Length: {len(block)}"]
    return "\r\n".join(lines).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def parsed(data: bytes) -> dict | None:
    """The fields of one record, None for a warcinfo; a response's size and digest are those of the payload itself, and must fit its headers."""
    head, _, rest = data.partition(b"\r\n\r\n")
    fields = dict(line.split(": ", 1) for line in head.decode().split("\r\n")[1:])
    block = rest[: int(fields["Content-Length"])]
    if len(block) != int(fields["Content-Length"]) or rest[len(block) :] != b"\r\n\r\n":
        raise ValueError("the record's length does not fit")
    if fields["WARC-Type"] == "warcinfo":
        return None
    http, _, payload = block.partition(b"\r\n\r\n")
    size = int(dict(line.split(": ", 1) for line in http.decode().split("\r\n")[1:])["Content-Length"])
    digest = fields["WARC-Payload-Digest"].removeprefix("sha256:")
    if fields["WARC-Type"] == "response" and (len(payload) != size or hashlib.sha256(payload).hexdigest() != digest):
        raise ValueError("the payload does not fit its digest")
    refers = fields.get("WARC-Refers-To")
    return {"page_id": _page(fields["WARC-Record-ID"]), "payload_bytes": size, "payload_digest": digest, "record_type": fields["WARC-Type"], "refers_to": refers and _page(refers), "url": fields["WARC-Target-URI"], "payload": payload}


def planned(pages: DataFrame, least: int = LEAST) -> DataFrame:
    """pages' rows (page_id, url, payload) with payload_bytes, payload_digest and refers_to (null: a response).

    Groups of equal payloads are pre-aggregated by digest; only digests that occur twice join back, and AQE splits the join where one digest is very frequent.
    """
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), "url", F.coalesce(F.col("html").cast("binary"), F.lit(b"")).alias("payload"))
    rows = rows.withColumns({"payload_bytes": F.octet_length("payload").cast("long"), "payload_digest": F.sha2("payload", 256)})
    groups = rows.where(F.col("payload_bytes") >= least).groupBy("payload_digest").agg(F.min("page_id").alias("first"), F.count("*").alias("n")).where("n > 1 and first is not null").select("payload_digest", "first")
    return rows.join(groups, "payload_digest", "left").withColumn("refers_to", F.when(~F.col("page_id").eqNullSafe(F.col("first")), F.col("first"))).drop("first")


def write_archives(pages: DataFrame, folder: str, least: int = LEAST, file_rows: int = FILE_ROWS, file_bytes: int = FILE_BYTES) -> None:
    """Writes a record for each row of pages (page_id, url, html) to archives in folder, one or more for each partition.

    An archive ends before it would pass file_bytes or file_rows rows. Only the dictionary's sample, about twice SAMPLE records of at most
    SAMPLE_BYTES each, comes to the driver; no result depends on it.
    """
    sample, _, _ = sampled(pages, F.col("html"), SAMPLE, SAMPLE_BYTES, 7)
    sent = pages.sparkSession.sparkContext.broadcast(trained([record(i, None, s, len(s), hashlib.sha256(s).hexdigest(), None) for i, s in enumerate(sample)]))

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        squeeze, layout, files = compressor(sent.value), Layout(file_rows, file_bytes), 0
        opening = [skippable(DICTIONARY, sent.value)] if sent.value else []
        for batch in batches:
            rows, out = batch.to_pydict(), []
            for page_id, url, payload, size, digest, refers in zip(*(rows[c] for c in ("page_id", "url", "payload", "payload_bytes", "payload_digest", "refers_to")), strict=True):
                frame = squeeze.compress(record(page_id, url, payload if refers is None else None, size, digest, refers))
                if layout.full(len(frame)):
                    out += layout.rest()
                if not layout.place:
                    head = [*opening, squeeze.compress(information(f"{folder} {TaskContext.get().partitionId()} {files}"))]
                    files += 1
                    out += head
                    for h in head:
                        layout.add(h)
                layout.add(frame)
                out.append(frame)
            yield pa.RecordBatch.from_pydict({"frame": pa.array(out, pa.binary())})

    rows = planned(pages, least).withColumn("payload", F.when(F.col("refers_to").isNull(), F.col("payload")))
    write_frames(rows.select("page_id", "url", "payload", "payload_bytes", "payload_digest", "refers_to").mapInArrow(write, "frame binary"), folder, file_rows)


def records(content: bytes) -> Iterator[dict]:
    """The records of one archive."""
    reader = decompressor(b"")
    view = memoryview(content)
    for magic, start, end in frames(view):
        if magic == DICTIONARY:
            reader = decompressor(bytes(view[start + 8 : end]))
        elif magic == FRAME:
            if (found := parsed(reader.decompress(view[start:end]))) is not None:
                yield found


def read_archives(spark: SparkSession, folder: str, payload: bool = False) -> DataFrame:
    """(page_id, payload_bytes, payload_digest, record_type, refers_to) of each record in folder; payload=True adds url and payload."""
    kinds = {"page_id": pa.int64(), "payload_bytes": pa.int64(), "payload_digest": pa.string(), "record_type": pa.string(), "refers_to": pa.int64()} | ({"url": pa.string(), "payload": pa.binary()} if payload else {})

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for content in batch.column(0):
                held: list[dict] = []
                for row in records(content.as_py()):
                    held.append({k: row[k] for k in kinds})
                    if len(held) == 1000:
                        yield pa.RecordBatch.from_pylist(held, pa.schema(list(kinds.items())))
                        held = []
                yield pa.RecordBatch.from_pylist(held, pa.schema(list(kinds.items())))

    schema = "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long" + ", url string, payload binary" * payload
    return read_files(spark, folder).select("content").mapInArrow(each, schema)


def archived(pages: DataFrame, least: int = LEAST) -> DataFrame:
    """Writes pages as archives in the shared folder and reads them back: one row for each row of pages.

    Of rows with equal payloads of at least `least` bytes, those with the smallest page_id are responses and the others revisit it. A
    null html is an empty payload; a row with a null page_id revisits where its payload has a row with an id, and is
    a response otherwise; a null url is replaced by the record's name. Repeated rows are records of their own, and rows of one page_id share a record id. Other columns,
    whatever their names, are not read. An empty table gives an empty result.
    """
    folder = new_folder(pages.sparkSession, "warc")
    write_archives(pages, folder, least)
    return read_archives(pages.sparkSession, folder)
