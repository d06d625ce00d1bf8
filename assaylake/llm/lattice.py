"""Language-model scoring by the likelihood of a subword lattice.

A word's lattice has an edge for each piece of an existing vocabulary that fits at a place, and bytes where a character has no
piece; the forward recursion sums the probabilities of all segmentations. Piece probabilities come from counts over all training
words. A word seen in training has one more path, the word as a whole: with counts c of the word, n of all tokens and v of
distinct ones, P(word) = (c + v * P_lattice(word)) / (n + v). The model is a mixture over languages, each with its own counts, and
a document's probability is the sum over them: its language is not given to the model, it is summed out.

Plan: (1) one pass over the texts makes chunks: a row for each distinct word with its counts, and a row with the texts as word
numbers and the piece counts; a reader holds thousands of rows at a time, so words are no arrays; (2) counts are added up by word over all chunks; (3) the totals join back to the chunks, where a word of very many chunks
may be split as any skewed join key is; (4) each chunk scores its documents. Texts are read once and not shuffled; a chunk holds about a million tokens at any table size.
"""

from __future__ import annotations

import math
import secrets
from collections.abc import Iterator
from itertools import chain
from pathlib import Path

import numpy as np
import pyarrow as pa
import sentencepiece
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from assaylake.llm.shared import blocks_for, new_folder, written

#: Tokens and documents of a chunk, languages with counts of their own, added count of each piece.
TOKENS, DOCS, LANGUAGES, ADDED = 1_000_000, 4000, 4, 0.01
#: Chunks that a task scores; words of a chunk that are sent at a time.
TOGETHER, SENT = 4, 1 << 14
#: Words of more characters, or of a smaller chance, are summed in logs; words and characters of a step there.
LINEAR, SMALL, SIDE, SPAN = 96, 1e-290, 256, 256
_SPACE = "▁"


def words_of(text: str | None) -> list[bytes]:
    """A-Z in lower case, cut at ASCII white space."""
    return (text or "").encode().lower().split()


class Pieces:
    """The vocabulary of a sentencepiece file: piece strings, byte pieces, and the library's own segmentation for counting."""

    def __init__(self, model: bytes):
        self.reader = sentencepiece.SentencePieceProcessor(model_proto=model)
        size = self.reader.get_piece_size()
        self.names = [self.reader.id_to_piece(i) for i in range(size)]
        self.plain = [not (self.reader.is_byte(i) or self.reader.is_control(i) or self.reader.is_unknown(i)) for i in range(size)]
        self.byte_id = {int(self.names[i][3:5], 16): i for i in range(size) if self.reader.is_byte(i)}

    def counts(self, words: list[str], weights: np.ndarray) -> np.ndarray:
        """(languages, pieces): how often each piece stands in words, each word weighted by its counts (languages, words)."""
        ids = self.reader.encode(words, num_threads=1)
        length = np.fromiter(map(len, ids), np.int64, len(ids))
        flat = np.fromiter(chain.from_iterable(ids), np.int64, int(length.sum()))
        return np.stack([np.bincount(flat, np.repeat(w, length), len(self.names)) for w in weights])


class Lattice:
    """Marginal log probabilities of words under piece probabilities of several languages.

    counts: (languages, pieces); ends: words counted in each language. A word is the letter U+2581 and its characters; pieces
    are drawn until an end is drawn. A character without a piece of its own is spelled by its byte pieces.
    """

    def __init__(self, pieces: Pieces, counts: np.ndarray, ends: np.ndarray):
        total = counts.sum(1) + ADDED * counts.shape[1] + ends + 1
        chance = (counts + ADDED) / total[:, None]
        self.end = (ends + 1) / total
        self.byte = np.stack([chance[:, pieces.byte_id[b]] if b in pieces.byte_id else np.full(len(chance), ADDED) / total for b in range(256)])
        used = [i for i, name in enumerate(pieces.names) if pieces.plain[i] and (len(name) == 1 or counts[:, i].any())]
        self.longest = max((len(pieces.names[i]) for i in used), default=1)
        self.chance = np.vstack([np.zeros(len(chance)), chance[:, used].T])
        self._tables([pieces.names[i] for i in used])
        self.single = {pieces.names[i] for i in used if len(pieces.names[i]) == 1}
        self.logs = np.zeros((0, len(self.end)))
        self.spelled: dict[str, int] = {}  # characters without a piece get an edge of their own when met

    def _tables(self, names: list[str]) -> None:
        """Two hash tables of code-point hashes to edges, large enough that no name is left without a place."""
        keys = []
        for name in names:
            h = 0
            for c in name:
                h = (h * 0x9E3779B97F4A7C15 + ord(c) + 1) & 0xFFFFFFFFFFFFFFFF
            keys.append(h)
        bits, done = 18, False
        while not done:
            place = [np.zeros(1 << bits, np.int32), np.zeros(1 << bits, np.int32)]
            done = True
            for edge, h in enumerate(keys, 1):
                for table, mult in zip(place, (0xD6E8FEB86659FD93, 0xA0761D6478BD642F), strict=True):
                    slot = (h * mult & 0xFFFFFFFFFFFFFFFF) >> (64 - bits)
                    if not table[slot]:
                        table[slot] = edge
                        break
                else:
                    done = False
                    break
            bits += 2
        self.bits, self.place, self.keys = bits - 2, place, np.array([0, *keys], np.uint64)

    def _edges(self, hashes: np.ndarray) -> np.ndarray:
        shift = np.uint64(64 - self.bits)
        found = self.place[0][(hashes * np.uint64(0xD6E8FEB86659FD93)) >> shift]
        wrong = np.flatnonzero((found != 0) & (self.keys[found] != hashes))
        if len(wrong):
            other = self.place[1][(hashes[wrong] * np.uint64(0xA0761D6478BD642F)) >> shift]
            found[wrong] = np.where(self.keys[other] == hashes[wrong], other, 0)
        return found

    def _spell(self, code: int) -> int:
        """The edge of a character without a piece: the product of its bytes' probabilities."""
        char = chr(code)
        if char not in self.spelled:
            self.spelled[char] = len(self.chance)
            self.chance = np.vstack([self.chance, np.prod([self.byte[b] for b in char.encode("utf-8", "replace")], axis=0)])
        return self.spelled[char]

    def log_chance(self, words: list[str]) -> np.ndarray:
        """(words, languages): natural log of each word's marginal probability; the empty word is an end alone."""
        out = np.tile(np.log(self.end), (len(words), 1))
        texts = [_SPACE + word if word else "" for word in words]
        length = np.fromiter(map(len, texts), np.int64, len(texts))
        order = np.argsort(length, kind="stable")
        order = order[(length[order] > 0) & (length[order] <= LINEAR)]
        low = [np.flatnonzero(length > LINEAR)]
        cuts = np.flatnonzero(np.diff(length[order])) + 1
        for same in np.split(order, cuts) if len(order) else []:
            n = int(length[same[0]])
            step = max(1, 400_000 // n)
            for start in range(0, len(same), step):
                chosen = same[start : start + step]
                codes = np.frombuffer("".join([texts[i] for i in chosen]).encode("utf-32-le"), np.uint32).reshape(len(chosen), n)
                sums = self._forward(codes)
                good = (sums >= SMALL).all(1)
                out[chosen[good]] += np.log(sums[good])
                low.append(chosen[~good])
        rest = np.concatenate(low)
        rest = rest[np.argsort(-length[rest], kind="stable")]
        for start in range(0, len(rest), SIDE):
            chosen = rest[start : start + SIDE]
            out[chosen] += self._forward_logs([texts[i] for i in chosen])
        return out

    def _edges_by_length(self, codes: np.ndarray) -> list[np.ndarray]:
        """For each length from 1 to that of the longest piece: the edges that start at each place, 0 where there is none."""
        m, n = codes.shape
        wide = codes.astype(np.uint64) + np.uint64(1)
        hashes, edges = np.zeros((m, n + 1), np.uint64), []
        for length in range(1, min(n, self.longest) + 1):
            hashes = hashes[:, : n - length + 1] * np.uint64(0x9E3779B97F4A7C15) + wide[:, length - 1 :]
            edges.append(self._edges(hashes.ravel()).reshape(hashes.shape))
        missing = np.argwhere(edges[0] == 0)
        for i, j in missing:
            edges[0][i, j] = self._spell(int(codes[i, j]))
        return edges

    def _forward(self, codes: np.ndarray) -> np.ndarray:
        """The forward recursion over words of one length, summed as it is.

        What follows a state has a chance of at most 1, so that sums below the smallest float change a result by no more than
        themselves: a result of SMALL or more is right.
        """
        m, n = codes.shape
        edges = self._edges_by_length(codes)
        sums = np.zeros((n + 1, m, len(self.end)))
        sums[0] = 1
        for j in range(1, n + 1):
            for length in range(1, min(j, self.longest) + 1):
                edge = edges[length - 1][:, j - length]
                there = np.flatnonzero(edge)
                if len(there):
                    sums[j, there] += sums[j - length, there] * self.chance[edge[there]]
        return sums[n]

    def _forward_logs(self, texts: list[str]) -> np.ndarray:
        """The forward recursion in logs over texts of any length, the longest first; SPAN characters at a time, the last states carried on."""
        most = self.longest
        size = np.fromiter(map(len, texts), np.int64, len(texts))
        out = np.empty((len(texts), len(self.end)))
        carried = np.full((len(texts), most, len(self.end)), -np.inf)
        carried[:, -1] = 0
        for at in range(0, int(size[0]), SPAN):
            m = int((size > at).sum())
            width = min(SPAN, int(size[0]) - at)
            # What stands before a text has no state, and what stands after it is not read.
            before = [t[max(0, at - most + 1) : at].rjust(most - 1, _SPACE) + t[at : at + width].ljust(width, _SPACE) for t in texts[:m]]
            codes = np.frombuffer("".join(before).encode("utf-32-le"), np.uint32).reshape(m, most - 1 + width)
            edges = self._edges_by_length(codes)
            ending = np.zeros((m, width, most), np.int64)  # at each character, the edges that end there, the longest first
            for length, edge in enumerate(edges, 1):
                ending[:, :, most - length] = edge[:, most - length : most - length + width]
            if len(self.logs) != len(self.chance):
                with np.errstate(divide="ignore"):
                    self.logs = np.log(self.chance)
            states = np.concatenate([carried[:m], np.empty((m, width, len(self.end)))], axis=1)
            for i in range(width):
                terms = states[:, i : i + most] + self.logs[ending[:, i]]
                top = terms.max(1)
                states[:, most + i] = top + np.log(np.exp(terms - top[:, None]).sum(1))
            carried = states[:, -most:]
            done = np.flatnonzero(size[:m] <= at + width)
            out[done] = states[done, most - 1 + size[done] - at]
        return out


_READY: dict[int, object] = {}


def _once(key, make):
    if key not in _READY:
        if len(_READY) > 4:
            _READY.clear()
        _READY[key] = make()
    return _READY[key]


_TEXTS = pa.schema([("doc_ids", pa.list_(pa.int64())), ("held", pa.list_(pa.bool_())), ("sizes", pa.list_(pa.int64())), ("groups", pa.list_(pa.int32())), ("tokens", pa.binary()), ("pieces", pa.list_(pa.int32())), ("piece_counts", pa.list_(pa.float64()))])
_TEXT_TYPES = "doc_ids array<long>, held array<boolean>, sizes array<long>, groups array<int>, tokens binary, pieces array<int>, piece_counts array<double>"


def _chunk_types(k: int) -> str:
    return ", ".join(["chunk long, word string", *(f"c{g} int" for g in range(k)), _TEXT_TYPES])


def _chunks(docs: DataFrame, model, languages: list[str], most: int = DOCS) -> DataFrame:
    """For each chunk of documents a row for each of its words (word and counts c0, c1, ...) and one with its texts (word null), where a word's number is its place among the sorted words. The chunk's number is drawn at random and committed with all that names it."""
    group = {lang: n for n, lang in enumerate(languages)}
    k = len(languages) + 1
    schema = pa.schema([("chunk", pa.int64()), ("word", pa.string()), *((f"c{g}", pa.int32()) for g in range(k)), *_TEXTS])

    def batch(n: int, **columns) -> pa.RecordBatch:
        """n rows of the schema; columns that are not given are null."""
        return pa.RecordBatch.from_arrays([pa.array(columns[f.name], f.type) if f.name in columns else pa.nulls(n, f.type) for f in schema], schema=schema)

    def chunk(rows: list[tuple]) -> Iterator[pa.RecordBatch]:
        pieces = _once("pieces", lambda: Pieces(model.value))
        known: dict[bytes, int] = {}
        coded = [[known.setdefault(w, len(known)) for w in words_of(text)] for _, text, _, _ in rows]
        sizes = np.fromiter(map(len, coded), np.int64, len(coded))
        tokens = np.fromiter(chain.from_iterable(coded), np.uint32, int(sizes.sum()))
        words = sorted(known)
        place = np.empty(len(words), np.uint32)
        place[np.fromiter(map(known.__getitem__, words), np.int64, len(words))] = np.arange(len(words))
        tokens = place[tokens]
        groups = np.array([group.get(lang, k - 1) for _, _, lang, _ in rows])
        held = np.array([h for *_, h in rows], bool)
        owner = np.repeat(np.where(held, k, groups), sizes)
        counts = np.stack([np.bincount(tokens[owner == g], minlength=len(known)) for g in range(k)])
        words = [w.decode() for w in words]
        taught = np.flatnonzero(counts.any(0))
        found = pieces.counts([words[i] for i in taught], counts[:, taught]).ravel() if len(taught) else np.zeros(1)
        some = np.flatnonzero(found)
        number = secrets.randbits(62)
        for at in range(0, len(words), SENT):
            part = words[at : at + SENT]
            yield batch(len(part), chunk=np.full(len(part), number), word=part, **{f"c{g}": counts[g, at : at + SENT].astype(np.int32) for g in range(k)})
        texts = {"doc_ids": [r[0] for r in rows], "held": held, "sizes": sizes, "groups": groups.astype(np.int32), "tokens": zstandard.compress(tokens.tobytes(), 1), "pieces": some.astype(np.int32), "piece_counts": found[some]}
        yield batch(1, chunk=[number], **{c: [v] for c, v in texts.items()})

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows, size = [], 0
        for batch in batches:
            for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                rows.append(row)
                size += len(row[1] or "") // 6
                if size >= TOKENS or len(rows) >= most:
                    yield from chunk(rows)
                    rows, size = [], 0
        if rows:
            yield from chunk(rows)

    held = F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 10 == 0, F.lit(True))
    lang = F.col("lang").cast("string") if "lang" in docs.columns else F.lit(None).cast("string")
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", lang.alias("lang"), held.alias("held")).mapInArrow(each, _chunk_types(k))


def lattice_scores(docs: DataFrame, path: str, languages: int = LANGUAGES) -> DataFrame:
    """(doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score) for each row of docs; scores are log10 probabilities.

    Learned from rows whose crc32(doc_id as text) mod 10 is not 0 (a null doc_id: held_out is true, not learned from). A null text is empty: one token, the end. n_tokens:
    words and the end; n_known: those seen in training; train_tokens: all tokens in training; base_score: the unigram score with 0.1
    added to each count; score: the lattice's. path: a sentencepiece file. The `languages` most frequent values of lang have
    counts of their own, all others and null share theirs; without a column lang all do. Repeated rows stay, each counted; other
    columns, whatever their names, are not read. An empty table gives an empty one; without training rows all counts are zero.
    """
    spark = docs.sparkSession
    model = spark.sparkContext.broadcast(Path(path).read_bytes())  # half a MB, whatever the table
    frequent = [r["lang"] for r in docs.where("lang is not null").groupBy(F.col("lang").cast("string").alias("lang")).count().orderBy(F.col("count").desc(), "lang").limit(languages).collect()] if "lang" in docs.columns else []
    k = len(frequent) + 1
    _chunks(docs, model, frequent).write.option("compression", "zstd").parquet(folder := new_folder(spark, "lm-chunks"))
    chunks, spread, again = (spark.read.schema(_chunk_types(k)).parquet(folder).where(f"word IS {some}") for some in ("NULL", "NOT NULL", "NOT NULL"))  # tables of their own, to be joined
    # What training holds as a whole: documents and tokens of each language, piece counts (a number for each piece and language).
    taught = chunks.select(F.explode(F.arrays_zip("held", "sizes", "groups")).alias("d")).select("d.*").where("not held").groupBy("groups").agg(F.count("*").alias("docs"), F.sum("sizes").alias("words")).collect()
    trained = np.zeros((2, k))
    for r in taught:
        trained[:, r["groups"]] = r["docs"], r["words"]
    counted = chunks.select(F.explode(F.arrays_zip("pieces", "piece_counts")).alias("p")).groupBy("p.pieces").agg(F.sum("p.piece_counts").alias("n")).toPandas()
    size = len(Pieces(model.value).names)
    piece_counts = np.zeros(k * size)
    piece_counts[counted["pieces"].to_numpy("i8")] = counted["n"].to_numpy("f8")
    # Words: counts over all chunks. A word has one row for each chunk that holds it, and one in the totals.
    totals = written(spread.groupBy("word").agg(*(F.sum(f"c{g}").alias(f"t{g}") for g in range(k))), "lm-totals")
    distinct = totals.agg(F.count(F.when(sum(F.col(f"t{g}") for g in range(k)) > 0, 1)).alias("v"), *(F.count(F.when(F.col(f"t{g}") > 0, 1)).alias(f"v{g}") for g in range(k))).collect()[0]
    # A merge join, which AQE splits at a word of very many chunks.
    placed = again.select("chunk", "word")
    shared = placed.hint("merge").join(totals.hint("merge"), "word")
    known = int(distinct["v"]) + int(trained[0].sum() > 0)  # and the end
    train_tokens = int(trained.sum())
    facts = spark.sparkContext.broadcast((piece_counts.reshape(k, size), trained, np.array([distinct[f"v{g}"] for g in range(k)], float) + 1))  # a number for each piece and language
    name = new_folder(spark, "lattice")

    def scored(chunk: pa.Table, words: pa.Table) -> pa.Table:
        pieces, (docs_in, words_in), variety = facts.value[0], facts.value[1], facts.value[2]
        lattice = _once(name, lambda: Lattice(Pieces(model.value), pieces, words_in + docs_in))
        out = []
        for row in chunk.to_pylist():
            words = words.sort_by("word")  # by bytes, as they are numbered
            spelled = words["word"].to_pylist()
            count = np.zeros((len(spelled) + 1, k))  # the last row is the end
            for g in range(k):
                count[:-1, g] = words[f"t{g}"].to_numpy()
            count[-1] = docs_in
            marginal = lattice.log_chance([*spelled, ""])
            tokens = docs_in + words_in
            with np.errstate(divide="ignore"):
                ln = np.logaddexp(np.log(count), np.log(variety) + marginal) - np.log(tokens + variety)
            c = count.sum(1)
            base = np.log10((c + 0.1) / (train_tokens + 0.1 * (known + 1)))
            ids = np.frombuffer(zstandard.decompress(row["tokens"]), np.uint32).astype(np.int64)
            sizes = np.array(row["sizes"], np.int64)
            cuts = np.cumsum(sizes)
            whole = np.empty((len(ids) + len(sizes), ), np.int64)  # each document's words, then the end
            ends = cuts + np.arange(len(sizes))
            whole[ends] = len(spelled)
            inside = np.ones(len(whole), bool)
            inside[ends] = False
            whole[inside] = ids
            starts = np.r_[0, ends[:-1] + 1]
            share = np.log((docs_in + 1e-9) / (docs_in.sum() + k * 1e-9))
            each = np.stack([np.add.reduceat(ln[whole, g], starts) for g in range(k)], axis=1) + share
            top = each.max(1)
            score = (top + np.log(np.exp(each - top[:, None]).sum(1))) / math.log(10)
            out.append(pa.table({"doc_id": pa.array(row["doc_ids"], pa.int64()), "held_out": pa.array(row["held"], pa.bool_()), "n_tokens": pa.array(sizes + 1), "n_known": pa.array(np.add.reduceat((c[whole] > 0).astype(np.int64), starts)), "base_score": pa.array(np.add.reduceat(base[whole], starts)), "score": pa.array(score)}))
        return pa.concat_tables(out) if out else pa.table({c: pa.array([], t) for c, t in (("doc_id", pa.int64()), ("held_out", pa.bool_()), ("n_tokens", pa.int64()), ("n_known", pa.int64()), ("base_score", pa.float64()), ("score", pa.float64()))})

    parts = blocks_for(chunks.count(), TOGETHER)
    sides = chunks.select("chunk", "doc_ids", "held", "sizes", "tokens").repartition(parts, "chunk"), shared.repartition(parts, "chunk")
    found = sides[0].groupBy("chunk").cogroup(sides[1].groupBy("chunk")).applyInArrow(scored, "doc_id long, held_out boolean, n_tokens long, n_known long, base_score double, score double")
    return found.select("doc_id", "held_out", "n_tokens", "n_known", F.lit(train_tokens).cast("long").alias("train_tokens"), "base_score", "score")
