"""Byte-level BPE by forced-boundary splitting, and decoding.

A pair of bytes that stands in no vocabulary token can be inside no token of an encoding either, so a cut between
the two is certain. A text is cut where white space follows other text (the splitting pattern never spans that),
each segment is split by the pattern, each of those at the certain cuts, and the fragments are encoded
independently by the vocabulary's merges; the ids are concatenated. Segments repeat, so each worker keeps a
bounded table of those it met.
"""

from __future__ import annotations

import codecs
import hashlib
import json
import re
from collections.abc import Callable, Iterator
from pathlib import Path

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from tokenizers import Tokenizer

#: Fixed value: the pattern of byte-level BPE in the tokenizers library.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Fixed value: what \s of that pattern matches (Unicode White_Space).
SPACE = "\\t-\\r \\x85\\xa0\\u1680\\u2000-\\u200a\\u2028\\u2029\\u202f\\u205f\\u3000"
SEGMENT = re.compile(f"[{SPACE}]*[^{SPACE}]+|[{SPACE}]+")
BLANK = re.compile(f"[{SPACE}]").match
#: White space before a space: no certain cut there.
UNSURE_ASCII = [c + " " for c in "\t\n\x0b\x0c\r "]
UNSURE = [c + " " for c in map(chr, [*range(9, 14), 32, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000])]
STOPS = ".,"
#: Segments a worker keeps, twice over at most.
KEPT = 200_000
#: Parts a worker keeps with their ids in bytes, some 200 bytes each.
KEPT_BINARY = 1_600_000


def byte_letters() -> list[str]:
    """The letter that stands for each byte: itself where it is printable, else the next from U+0100 on."""
    plain = {*range(33, 127), *range(161, 173), *range(174, 256)}
    others = iter(range(256, 512))
    return [chr(b) if b in plain else chr(next(others)) for b in range(256)]


class Kept(dict):
    """A table of segment -> value that forgets what was not asked for lately; it holds 2 * most entries at most."""

    def __init__(self, make: Callable[[str], object], most: int = KEPT):
        super().__init__()
        self.make, self.most, self.old = make, most, {}

    def __missing__(self, key: str):
        value = self.old.get(key)
        if value is None:
            value = self.make(key)
        if len(self) >= self.most:
            self.old = dict(self)
            self.clear()
        self[key] = value
        return value


class Encoder:
    """Encodes and decodes as the tokenizers library does with the given file (byte-level BPE, no normaliser)."""

    def __init__(self, spec: str):
        described = json.loads(spec)
        front = described["pre_tokenizer"]
        if described.get("normalizer") or front.get("type") != "ByteLevel" or front.get("add_prefix_space") or described["model"]["type"] != "BPE":
            raise ValueError("only plain byte-level BPE files are read")
        self.library = Tokenizer.from_str(spec)
        self.library.no_truncation()
        self.library.no_padding()
        self.model = self.library.model
        letters = byte_letters()
        self.letters = dict(enumerate(letters))
        self.byte_of = {c: b for b, c in enumerate(letters)}
        vocabulary = described["model"]["vocab"]
        self.inside = {a + b for token in vocabulary for a, b in zip(token, token[1:], strict=False)}
        self.added = {t["content"]: t["id"] for t in described["added_tokens"]}
        self.split_added = re.compile("|".join(map(re.escape, sorted(self.added, key=len, reverse=True)))) if self.added else None
        self.pattern = regex.compile(PATTERN)
        self.bytes_of = {i: self._bytes(t) for t, i in [*vocabulary.items(), *self.added.items()]}
        self.decimal = Kept(lambda s: ",".join(map(str, self.segment_ids(s))))
        self.binary: dict[str, bytes] = {}
        self.width = np.zeros(max(self.bytes_of) + 1, np.int64)
        self.width[list(self.bytes_of)] = [len(b) for b in self.bytes_of.values()]
        self.bytes_of_decimal = {str(i): b for i, b in self.bytes_of.items()}

    def _bytes(self, token: str) -> bytes:
        return bytes(self.byte_of[c] for c in token) if all(c in self.byte_of for c in token) else token.encode()

    def fragments(self, piece: str) -> list[str]:
        """piece, in byte letters, cut between the pairs of bytes that no token holds."""
        cuts = [i + 1 for i, (a, b) in enumerate(zip(piece, piece[1:], strict=False)) if a + b not in self.inside]
        return [piece[i:j] for i, j in zip([0, *cuts], [*cuts, len(piece)], strict=True)] if cuts else [piece]

    def segment_ids(self, segment: str) -> list[int]:
        if segment in self.added:
            return [self.added[segment]]
        pieces = (p.encode().decode("latin-1").translate(self.letters) for p in self.pattern.findall(segment))
        return [t.id for p in pieces for f in self.fragments(p) for t in self.model.tokenize(f)]

    def segments(self, text: str | None) -> list[str]:
        """Parts of text whose encodings do not depend on each other."""
        text = text or ""
        if self.split_added is None or not (found := list(self.split_added.finditer(text))):
            return SEGMENT.findall(text)
        out, at = [], 0
        for m in found:
            out += [*SEGMENT.findall(text[at : m.start()]), m[0]]
            at = m.end()
        return out + SEGMENT.findall(text[at:])

    def ids(self, text: str | None) -> list[int]:
        return [i for s in self.segments(text) for i in self.segment_ids(s)]

    def spaced(self, text: str) -> list[str] | None:
        """text cut at its spaces, or None where some cut is not certain (white space or an added token before a space)."""
        if "\0" in text or any(s in text for s in (UNSURE_ASCII if text.isascii() else UNSURE)) or any(a in text for a in self.added):
            return None
        return text.split(" ")

    def id_bytes(self, texts: list[str | None], most: int = 400) -> list[bytes]:
        """The ids of each text as little-endian unsigned 32-bit integers, by the library itself.

        A part keeps the space before it. Parts not met before go to the library together: where one ends with no white
        space the cut before the next one's space is certain, and the ids are dealt back by their bytes.
        """
        if len(texts) > most:  # the parts of a few hundred texts at a time
            return [b for i in range(0, len(texts), most) for b in self.id_bytes(texts[i : i + most])]
        if len(self.binary) > KEPT_BINARY:
            self.binary = {}
        known, new, found = self.binary, set(), []
        for text in texts:
            parts = self.spaced(text or "")  # "\0" marks a part that has no space before it
            parts = ["\0" + s for s in self.segments(text)] if parts is None else ["\0" + parts[0], *parts[1:]]
            values = list(map(known.get, parts))  # one look-up for each part; only those not met before take another
            gaps = [(i, parts[i]) for i, v in enumerate(values) if v is None] if None in values else []
            new.update(p for _, p in gaps)
            found.append((values, gaps))
        self._learn(new)
        for values, gaps in found:
            for i, p in gaps:
                values[i] = known[p]
        return [b"".join(values) for values, _ in found]

    def _learn(self, parts: set[str], most: int = 2_000) -> None:
        def ids(texts: list[str]) -> list[np.ndarray]:
            return [np.array(e.ids, "<u4") for e in self.library.encode_batch_fast(texts, add_special_tokens=False)]

        # A stop or comma after a letter is a piece of its own, so the part is its word and the sign.
        ended = [p for p in parts if len(p) > 1 and p[-1] in STOPS and p[-2].isalpha() and p[0] != "\0"]
        parts = parts.difference(ended).union(w for p in ended if (w := p[:-1]) not in self.binary)
        apart = [p for p in parts if p[:1] == "\0" or not p or BLANK(p[-1])]
        for start in range(0, len(apart), most):
            some = apart[start : start + most]
            self.binary.update((p, i.tobytes()) for p, i in zip(some, ids([p[1:] if p[:1] == "\0" else " " + p for p in some]), strict=True))
        joined = list(parts.difference(apart))
        for start in range(0, len(joined), most):
            some = joined[start : start + most]
            found = ids([" " + " ".join(some)])[0]
            ends = np.searchsorted(np.cumsum(self.width[found]), np.cumsum([len(p.encode()) + 1 for p in some])) + 1
            raw = found.tobytes()
            self.binary.update((p, raw[4 * a : 4 * b]) for p, a, b in zip(some, [0, *ends[:-1].tolist()], ends.tolist(), strict=True))
        if ended:
            sign = {s: ids([s])[0].tobytes() for s in STOPS}
            self.binary.update([(p, self.binary[p[:-1]] + sign[p[-1]]) for p in ended])

    def decode(self, ids: list[int]) -> str:
        """The text of ids; bytes that are no UTF-8 become U+FFFD, and special tokens are kept."""
        return b"".join(map(self.bytes_of.__getitem__, ids)).decode("utf-8", "replace")

    def round_trip(self, text: str | None, part: int = 1 << 16) -> tuple[int, str, str]:
        """(number of ids, SHA-256 of the ids in decimal joined by commas, SHA-256 of the text decoded from them)."""
        segments, count = self.segments(text), 0
        ids_hash, text_hash, decoder = hashlib.sha256(), hashlib.sha256(), codecs.getincrementaldecoder("utf-8")("replace")
        for start in range(0, len(segments), part):
            listed = ",".join(map(self.decimal.__getitem__, segments[start : start + part]))
            ids = listed.split(",")
            ids_hash.update(("," + listed if count else listed).encode())
            count += len(ids)
            text_hash.update(decoder.decode(b"".join(map(self.bytes_of_decimal.__getitem__, ids))).encode())
        text_hash.update(decoder.decode(b"", True).encode())
        return count, ids_hash.hexdigest(), text_hash.hexdigest()


_READY: dict[int, Encoder] = {}


def encoder(spec: str) -> Encoder:
    """The worker's encoder for the text of a tokenizer file; made once."""
    if (key := hash(spec)) not in _READY:
        _READY[key] = Encoder(spec)
    return _READY[key]


def tokenizer_file(path: str) -> str:
    return Path(path).read_text(encoding="utf-8")


def _mapped(docs: DataFrame, path: str, id_col: str, text_col: str, make: Callable[[Encoder, list], dict], schema: str) -> DataFrame:
    spec = docs.sparkSession.sparkContext.broadcast(tokenizer_file(path))  # 2 MB, whatever the table

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(spec.value)
        for batch in batches:
            yield pa.RecordBatch.from_pydict({"doc_id": batch.column(0)} | make(enc, batch.column(1).to_pylist()))

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(each, schema)


def encode(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, ids array<int>) for each row; a null text encodes as the empty one, to no ids. Other columns are not read."""
    return _mapped(docs, path, id_col, text_col, lambda enc, texts: {"ids": pa.array([enc.ids(t) for t in texts], pa.list_(pa.int32()))}, "doc_id long, ids array<int>")


def decode(encoded: DataFrame, path: str, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """(doc_id, text) for each row of ids; null ids decode to the empty text."""
    return _mapped(encoded, path, id_col, ids_col, lambda enc, rows: {"text": pa.array([enc.decode(ids or []) for ids in rows], pa.string())}, "doc_id long, text string")


def round_trip(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256) for each row of docs, its text encoded whole and decoded again.

    A null text counts as empty: no ids, and the hashes of nothing. Null ids, repeated rows and very long texts are rows like any
    other; other columns, whatever their names, are not read; an empty table gives an empty one. No shuffle.
    """

    def make(enc: Encoder, texts: list) -> dict:
        found = [enc.round_trip(t) for t in texts]
        return {"n_tokens": pa.array([f[0] for f in found], pa.int64()), "ids_sha256": pa.array([f[1] for f in found], pa.string()), "decoded_sha256": pa.array([f[2] for f in found], pa.string())}

    return _mapped(docs, path, id_col, text_col, make, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")
