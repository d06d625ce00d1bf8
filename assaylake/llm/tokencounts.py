"""Token counts of a sentencepiece BPE vocabulary by rank-synchronous merging of ragged arrays.

A pre-token is a run of spaces with what follows it up to the next space; where two letters stand side by side in no piece, no
token spans them and the pre-token is cut there too. Pre-tokens not met before are laid side by side in flat numpy arrays: a symbol for each letter,
the rank of each neighbouring pair, and where a sequence begins. In each round every sequence applies its own lowest-rank
pair, all sequences at once: sequences without a pair are done, and their surviving symbols are counted. Where the pair
stands in a sequence several times all of them are applied, unless a pair made by one of them ranks before (or with) it: then only the
first is, as the library would go on there.
"""

from __future__ import annotations

import heapq
import re
from collections.abc import Iterator
from itertools import chain
from pathlib import Path

import numpy as np
import pyarrow as pa
import sentencepiece
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: The letter that stands for a space; the rank of no pair; letters are below POINTS.
SPACE, NONE, POINTS = "▁", np.int64(1 << 40), 0x110000
#: Letters laid side by side at a time; characters of the texts whose pre-tokens are held at a time.
TOGETHER, CHARS = 1 << 18, 1 << 22
#: Pre-tokens whose counts a worker keeps, and the longest of them.
KEPT, LONGEST = 400_000, 64
#: Letters of a sequence, or rounds in which it applied its first pair alone, from which its merges are taken from a queue.
QUEUE_LETTERS, QUEUE_ROUNDS = 1 << 16, 1 << 10


class PieceCounter:
    """Counts tokens as sentencepiece does with a BPE model that falls back to bytes and leaves the text as it is but for a space in front."""

    def __init__(self, model: bytes):
        reader = sentencepiece.SentencePieceProcessor(model_proto=model)
        probe = " ﬁ  A\tb "
        if reader.normalize(probe) != (" " + probe).replace(" ", SPACE) or not any(map(reader.is_byte, range(reader.get_piece_size()))):
            raise ValueError("only models without normalising, with a space put in front and with byte pieces are read")
        plain = [i for i in range(reader.get_piece_size()) if not (reader.is_byte(i) or reader.is_control(i) or reader.is_unknown(i))]
        pieces = [reader.id_to_piece(i) for i in plain]
        symbol = {p: n for n, p in enumerate(pieces)}
        letters = sorted({c for p in pieces for c in p})
        for c in letters:
            symbol.setdefault(c, len(symbol))
        #: Tokens that a symbol counts as: one, or the bytes of a letter without a piece.
        self.tokens = np.ones(len(symbol), np.int64)
        self.tokens[len(pieces) :] = [len(c.encode()) for c in list(symbol)[len(pieces) :]]
        self.symbol_of = np.full(POINTS, -1, np.int32)
        self.symbol_of[[ord(c) for c in letters]] = [symbol[c] for c in letters]
        rank = np.unique([-reader.get_score(i) for i in plain], return_inverse=True)[1]
        self.size = len(symbol)
        made = [(symbol[p[:k]] * self.size + symbol[p[k:]], rank[n], n) for n, p in enumerate(pieces) for k in range(1, len(p)) if p[:k] in symbol and p[k:] in symbol]
        keys, ranks, results = (np.array(x, np.int64) for x in zip(*sorted(made), strict=True))
        self.keys, self.ranks, self.results = keys, np.r_[ranks, NONE], np.r_[results, -1]
        inside = {a + b for p in pieces for a, b in zip(p, p[1:], strict=False)}
        self.inside = np.array(sorted(ord(a) * POINTS + ord(b) for a, b in inside), np.int64)
        self.by_spaces = not any(p[1] == SPACE != p[0] for p in inside)
        self.by_lines = "\n" not in letters
        self.known: dict[str, int] = {}

    def _pairs(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Where in ranks and results the pairs of symbols are; the last place stands for no pair."""
        asked = left.astype(np.int64) * self.size + right
        at = np.searchsorted(self.keys, asked)
        at[at == len(self.keys)] = 0
        return np.where(self.keys[at] == asked, at, len(self.keys))

    def merged(self, letters: str, sizes: np.ndarray) -> np.ndarray:
        """The number of tokens of each sequence; letters holds them one after another, each of the given size."""
        code = np.frombuffer(letters.encode("utf-32-le", "surrogatepass"), "<u4").astype(np.int64)
        part = np.repeat(np.arange(len(sizes)), sizes)
        symbol = self.symbol_of[code]
        found = np.zeros(len(sizes), np.int64)
        alone = symbol < 0  # in no piece: spelled by bytes
        np.add.at(found, part[alone], 1 + (code[alone] >= 0x80) + (code[alone] >= 0x800) + (code[alone] >= 0x10000))
        pair = code[:-1] * POINTS + code[1:]
        at = np.searchsorted(self.inside, pair)
        at[at == len(self.inside)] = 0
        tied = (self.inside[at] == pair) & (part[:-1] == part[1:])
        row = np.r_[0, np.cumsum(~tied)]  # a sequence for each run of tied letters
        known = ~alone
        symbol, row, part = symbol[known], row[known], part[known]
        if not len(symbol):
            return found
        first = np.flatnonzero(np.r_[True, row[1:] != row[:-1]])
        length = np.diff(np.r_[first, len(row)])
        owner = part[first]
        for n in np.flatnonzero(length > QUEUE_LETTERS):
            found[owner[n]] += self._queued(symbol[first[n] : first[n] + length[n]].tolist())
        keep = np.repeat(length <= QUEUE_LETTERS, length)
        few = length <= QUEUE_LETTERS
        return found + self._rounds(symbol[keep].astype(np.int64), length[few], owner[few], len(sizes))

    def _rounds(self, symbol: np.ndarray, length: np.ndarray, owner: np.ndarray, size: int) -> np.ndarray:
        """Merges all sequences, lengths and owners as given, round by round; (size,) counts by owner."""
        found = np.zeros(size, np.int64)
        at = np.full(len(symbol), len(self.keys))
        ends = np.cumsum(length) - 1
        inner = np.ones(len(symbol), bool)
        inner[ends] = False
        here = np.flatnonzero(inner)
        at[here] = self._pairs(symbol[here], symbol[here + 1])
        slow = np.zeros(len(length), np.int64)
        while len(symbol):
            first = np.cumsum(length) - length
            rank = self.ranks[at]
            low = np.minimum.reduceat(rank, first)
            over = (low == NONE) | (slow >= QUEUE_ROUNDS)
            if over.any():  # sequences that are done
                gone = np.repeat(over, length)
                row = np.repeat(np.arange(len(length)), length)
                done = np.repeat(low == NONE, length)
                np.add.at(found, owner[row[done]], self.tokens[symbol[done]])
                for n in np.flatnonzero(over & (low < NONE)):
                    found[owner[n]] += self._queued(symbol[first[n] : first[n] + length[n]].tolist())
                symbol, at, rank = symbol[~gone], at[~gone], rank[~gone]
                length, owner, low, slow = length[~over], owner[~over], low[~over], slow[~over]
                if not len(symbol):
                    break
            row = np.repeat(np.arange(len(length)), length)
            hit = np.flatnonzero(rank == low[row])
            # Of hits side by side every other one is applied, from the left.
            lead = np.r_[True, (hit[1:] != hit[:-1] + 1) | (row[hit[1:]] != row[hit[:-1]])]
            run = hit[np.flatnonzero(lead)[np.cumsum(lead) - 1]]
            hit = hit[(hit - run) % 2 == 0]
            piece = self.results[at[hit]]
            # What the library meets just after each merge: the pair to the left, as merged before, and that to the right, not merged yet.
            before = np.flatnonzero((hit > 0) & (row[hit - 1] == row[hit]))
            left = symbol[hit[before] - 1]
            joined = (before > 0) & (hit[before - 1] == hit[before] - 2)
            left[joined] = piece[before[joined] - 1]
            after = np.flatnonzero(hit + 2 < len(symbol))
            after = after[row[hit[after] + 2] == row[hit[after]]]
            early = np.zeros(len(length), bool)
            for which, new in ((before, self._pairs(left, piece[before])), (after, self._pairs(piece[after], symbol[hit[after] + 2]))):
                rows = row[hit[which]]
                early[rows[self.ranks[new] <= low[rows]]] = True
            if early.any():  # there only the first place is applied
                slow += early
                head = np.r_[True, row[hit[1:]] != row[hit[:-1]]]
                chosen = head | ~early[row[hit]]
                hit, piece = hit[chosen], piece[chosen]
            symbol[hit] = piece
            keep = np.ones(len(symbol), bool)
            keep[hit + 1] = False
            new = np.cumsum(keep)[hit] - 1  # where the merged symbols are from now on
            length = length - np.bincount(row[hit], minlength=len(length))
            symbol, at, row = symbol[keep], at[keep], row[keep]
            place = np.r_[new, new[new > 0] - 1]
            inner = place[~np.r_[row[1:] != row[:-1], True][place]]
            at[place] = len(self.keys)
            at[inner] = self._pairs(symbol[inner], symbol[inner + 1])
        return found

    def _queued(self, symbol: list[int]) -> int:
        """The same for one sequence, its pairs taken from a queue: rounds over a very long one would cost its length each."""
        left, right = [*range(-1, len(symbol) - 1)], [*range(1, len(symbol)), -1]
        at = self._pairs(np.array(symbol[:-1], np.int64), np.array(symbol[1:], np.int64))
        queue = [(int(r), n, symbol[n], symbol[n + 1], int(p)) for n, (r, p) in enumerate(zip(self.ranks[at], self.results[at], strict=True)) if r < NONE]
        heapq.heapify(queue)
        table: dict[tuple[int, int], tuple[int, int]] = {}
        while queue:
            _, n, a, b, piece = heapq.heappop(queue)
            if symbol[n] != a or right[n] < 0 or symbol[right[n]] != b:
                continue
            gone = right[n]
            symbol[n], symbol[gone], right[n] = piece, -1, right[gone]
            if right[n] >= 0:
                left[right[n]] = n
            for m in (left[n], n):
                if m >= 0 and right[m] >= 0:
                    pair = symbol[m], symbol[right[m]]
                    if pair not in table:
                        k = self._pairs(np.array(pair[:1], np.int64), np.array(pair[1:], np.int64))[0]
                        table[pair] = int(self.ranks[k]), int(self.results[k])
                    rank, made = table[pair]
                    if rank < NONE:
                        heapq.heappush(queue, (rank, m, *pair, made))
        return int(self.tokens[[s for s in symbol if s >= 0]].sum())

    def parts(self, text: str) -> list[str]:
        """Pre-tokens of a text; one that does not begin with a line feed stands for itself with a space in front."""
        if not text:
            return []
        text = text.replace(SPACE, " ")
        if not self.by_spaces:
            return [text]
        marked = text.replace("\n", " \n") if self.by_lines else text
        if "  " in marked or marked[0] == " " or marked[-1] == " ":
            cut = re.findall(r" *[^ \n]+|\n[^ \n]*| +" if self.by_lines else r" *[^ ]+| +", " " + text)
            return [p[1:] if p[0] == " " else p for p in cut]
        return marked.split(" ")

    def counts(self, texts: list[str | None]) -> list[int]:
        """The number of tokens of each text; a null text is an empty one."""
        out: list[int] = []
        first, chars = 0, 0
        for n, text in enumerate(texts):
            chars += len(text or "")
            if chars >= CHARS or n == len(texts) - 1:  # the pre-tokens of some texts at a time
                out += self._counts(texts[first : n + 1])
                first, chars = n + 1, 0
        return out

    def _counts(self, texts: list[str | None]) -> list[int]:
        split = [self.parts(t or "") for t in texts]
        if len(self.known) > KEPT:
            self.known = {}
        known = self.known
        new = list(set(chain.from_iterable(split)).difference(known))
        found = dict(zip(new, self._learned(new), strict=True))
        known.update(found)
        out = [sum(map(known.__getitem__, s)) for s in split]
        for part in new:
            if len(part) > LONGEST:
                del known[part]
        return out

    def _learned(self, parts: list[str]) -> list[int]:
        out: list[int] = []
        some, size = [], 0
        for n, part in enumerate(parts):
            some.append(part if self.by_lines and part[:1] == "\n" else SPACE + part.replace(" ", SPACE))
            size += len(some[-1])
            if size >= TOGETHER or n == len(parts) - 1:
                out += self.merged("".join(some), np.fromiter(map(len, some), np.int64, len(some))).tolist()
                some, size = [], 0
        return out


_READY: dict[int, PieceCounter] = {}


def counter(model: bytes) -> PieceCounter:
    """The worker's counter for the bytes of a model; made once."""
    if (key := hash(model)) not in _READY:
        _READY.clear()
        _READY[key] = PieceCounter(model)
    return _READY[key]


def token_counts(docs: DataFrame, path: str, limit: int = 4096, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_bytes, n_tokens, over_limit) for each row of docs, its text read whole.

    n_bytes: of the text in UTF-8; over_limit: n_tokens > limit. A null text counts as empty: no bytes, no tokens. Special strings in a
    text are text. Null ids, repeated rows and very long texts are rows like any other; other columns, whatever their
    names, are not read; an empty table gives an empty one. No shuffle; a worker keeps a bounded table of short pre-tokens.
    """
    sent = docs.sparkSession.sparkContext.broadcast(Path(path).read_bytes())  # half a MB, whatever the table

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = counter(sent.value)
        for batch in batches:
            counts = pa.array(own.counts(batch.column(2).to_pylist()), pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), counts], ["doc_id", "n_bytes", "n_tokens"])

    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.octet_length(text).cast("long").alias("n_bytes"), text.alias("text"))
    return rows.mapInArrow(each, "doc_id long, n_bytes long, n_tokens long").withColumn("over_limit", F.col("n_tokens") > limit)
