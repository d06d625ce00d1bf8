"""Toxicity by a convolutional text classifier, trained in numpy and applied to whole texts.

A word's embedding is the sum of hashed rows for the word and for its first three, four and five letters. Filters of
several widths run over the words, each filter's maximum over the text is kept, and a logistic layer reads the maxima.
Training takes a bounded sample of labelled rows, as many of either class as the bound allows, and the score is then set
back to the class shares of all labelled rows. Thresholds for rejecting are calibrated by language on all labelled rows
that did not train the net; the language is no input of a score.
"""

from __future__ import annotations

import math
import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from assaylake.llm.shared import cut, unused, written

WORD = re.compile(r"\w+")
#: Hash rows, size of an embedding, filter widths, filters of each width.
ROWS, SIZE, WIDTHS, FILTERS = 1 << 16, 16, (1, 2, 3), 16
#: Labelled documents drawn of either class, and the characters of each that training reads at most (scores read whole texts).
SAMPLE, SAMPLE_CHARS = 3000, 65_536
#: The score from which a document counts as toxic where no threshold is calibrated, and the thresholds to choose from.
THRESHOLD, STEPS = 0.3, tuple(k / 20 for k in range(1, 20))
PARTS = 4


def word_rows(word: str) -> tuple[int, int, int, int]:
    """The hash rows of a word; row 0 is kept for padding."""
    crc = zlib.crc32
    return tuple(crc(part.encode()) % (ROWS - 1) + 1 for part in (f"w {word}", f"3 {word[:3]}", f"4 {word[:4]}", f"5 {word[:5]}"))


def words(text: str | None) -> list[str]:
    return WORD.findall((text or "").lower())


@dataclass
class Net:
    """The weights: embedding rows, filters[width][place] (SIZE x FILTERS), filter biases, and the logistic layer."""

    rows: np.ndarray
    filters: dict[int, np.ndarray]
    bias: dict[int, np.ndarray]
    out: np.ndarray
    shift: float
    taught: list[int] = field(default_factory=list)  # ids of the documents it learned from

    @classmethod
    def new(cls, seed: int) -> Net:
        rng = np.random.default_rng(seed)
        rows = rng.normal(0, 0.1, (ROWS, SIZE)).astype(np.float32)
        rows[0] = 0
        return cls(rows, {w: rng.normal(0, 0.3, (w, SIZE, FILTERS)).astype(np.float32) for w in WIDTHS}, {w: np.zeros(FILTERS, np.float32) for w in WIDTHS}, rng.normal(0, 0.2, len(WIDTHS) * FILTERS).astype(np.float32), 0.0)

    def projected(self) -> dict[int, np.ndarray]:
        """For each width and place, each hash row's part of the filters' values: (ROWS, FILTERS)."""
        return {w: np.stack([self.rows @ f for f in self.filters[w]]) for w in WIDTHS}


class Scorer:
    """Scores texts with a net; the hash rows are multiplied by the filters once, a text then costs look-ups and sums."""

    def __init__(self, net: Net, most: int = 100_000):
        self.net, self.most, self.table = net, most, net.projected()

    def scores(self, texts: list[str | None]) -> np.ndarray:
        out, held, count = [], [], 0
        for text in texts:
            held.append(words(text))
            count += len(held[-1])
            if count >= self.most:
                out.append(self._scores(held))
                held, count = [], 0
        if held:
            out.append(self._scores(held))
        return np.concatenate(out) if out else np.empty(0)

    def _scores(self, texts: list[list[str]]) -> np.ndarray:
        known: dict[str, int] = {}
        place = [known.setdefault(w, len(known) + 1) for text in texts for w in text]
        rows = np.zeros((len(known) + 1, PARTS), np.int64)
        if known:
            rows[1:] = [word_rows(w) for w in known]
        length = np.array([len(t) for t in texts])
        wide = np.maximum(length, 1) + max(WIDTHS) - 1  # each text is followed by padding, an empty one is padding alone
        start = np.r_[0, np.cumsum(wide)[:-1]]
        flat = np.zeros(int(wide.sum()) + max(WIDTHS), np.int64)
        flat[np.repeat(start, length) + np.arange(len(place)) - np.repeat(np.r_[0, np.cumsum(length)[:-1]], length)] = place
        cuts = np.stack([start, start + np.maximum(length, 1)], 1).ravel()
        features = []
        for w in WIDTHS:
            value = 0
            for j in range(w):
                part = self.table[w][j][rows].sum(1)
                part[0] = 0
                value = value + part[flat[j : len(flat) - w + 1 + j]]
            features.append(np.maximum(np.maximum.reduceat(value, cuts, axis=0)[::2] + self.net.bias[w], 0))
        logit = np.concatenate(features, 1).astype(np.float64) @ self.net.out + self.net.shift
        return 1 / (1 + np.exp(-np.clip(logit, -40, 40)))


def train(texts: list[str], labels: list[int], seed: int = 9, shown: int = 24_000, batch: int = 16, rate: float = 0.05, kept: float = 0.5) -> Net:
    """A net for the texts; about `shown` texts are shown in all. A word's own row is left out of a text with
    probability 1 - kept, so that its first letters must tell as well."""
    rng, net = np.random.default_rng(seed), Net.new(seed)
    coded = [np.array([word_rows(w) for w in (words(t) or [""])], np.int32) for t in texts]  # the driver's largest part
    y = np.asarray(labels, np.float64)
    squares = {"rows": np.full(ROWS, 1e-3, np.float32), "out": np.full(len(net.out), 1e-3, np.float32), "shift": 1e-3} | {w: np.full(net.filters[w].shape, 1e-3, np.float32) for w in WIDTHS} | {-w: np.full(FILTERS, 1e-3, np.float32) for w in WIDTHS}

    def step(name, value, slope):
        squares[name] = squares[name] + slope * slope
        return value - rate * slope / np.sqrt(squares[name])

    rounds = min(40, max(3, math.ceil(shown / max(1, len(coded)))))
    for _ in range(rounds):
        order = rng.permutation(len(coded))
        for first in range(0, len(order), batch):
            d_out, d_shift = np.zeros_like(net.out), 0.0
            d_filter, d_bias = {w: np.zeros_like(net.filters[w]) for w in WIDTHS}, {w: np.zeros(FILTERS, np.float32) for w in WIDTHS}
            touched, slopes = [], []
            chosen = order[first : first + batch]
            for n in chosen:
                rows = coded[n].copy()
                rows[rng.random(len(rows)) > kept, 0] = 0
                rows = np.concatenate([rows, np.zeros((max(WIDTHS) - 1, PARTS), np.int32)])
                x = net.rows[rows].sum(1)
                length, maxima, at = len(coded[n]), [], []
                for w in WIDTHS:
                    value = sum(x[j : j + length] @ net.filters[w][j] for j in range(w))
                    at.append(value.argmax(0))
                    maxima.append(value[at[-1], np.arange(FILTERS)] + net.bias[w])
                hidden = np.maximum(np.concatenate(maxima), 0)
                miss = 1 / (1 + math.exp(-max(-40.0, min(40.0, float(hidden @ net.out) + net.shift)))) - y[n]
                d_out += miss * hidden
                d_shift += miss
                back = (miss * net.out * (hidden > 0)).astype(np.float32)
                for k, w in enumerate(WIDTHS):
                    own = back[k * FILTERS : (k + 1) * FILTERS]
                    d_bias[w] += own
                    live = np.flatnonzero(own)
                    for j in range(w):
                        place = at[k][live] + j
                        d_filter[w][j][:, live] += (own[live, None] * x[place]).T
                        touched.append(rows[place].ravel())
                        slopes.append(np.repeat(own[live, None] * net.filters[w][j][:, live].T, PARTS, 0))
            size = len(chosen)
            net.out, net.shift = step("out", net.out, d_out / size), float(step("shift", net.shift, d_shift / size))
            for w in WIDTHS:
                net.filters[w], net.bias[w] = step(w, net.filters[w], d_filter[w] / size), step(-w, net.bias[w], d_bias[w] / size)
            names, where = np.unique(np.concatenate(touched), return_inverse=True)
            slope = np.zeros((len(names), SIZE), np.float32)
            np.add.at(slope, where, np.concatenate(slopes))
            slope[names == 0] = 0
            slope /= size
            squares["rows"][names] += (slope * slope).mean(1)
            net.rows[names] -= rate * slope / np.sqrt(squares["rows"][names])[:, None]
    return net


def best_threshold(counts: np.ndarray, shares: np.ndarray, fallback: float = THRESHOLD) -> float:
    """The threshold of STEPS of the best F score, nearest to fallback; fallback where either class has fewer than five rows.

    counts: (2, steps + 1), rows of either class by the number of steps their scores reach; shares: what either class counts for.
    """
    if counts.sum(1).min() < 5:
        return fallback
    steps = np.array(STEPS)
    reach = (counts * (shares / counts.sum(1))[:, None])[:, ::-1].cumsum(1)[:, ::-1][:, 1:]
    value = 2 * reach[1] / np.maximum(1e-300, reach.sum(0) + shares[1])
    good = steps[value >= value.max() - 1e-9]
    return float(good[np.abs(good - fallback).argmin()])


def calibrated(scored: DataFrame, labels: DataFrame, net: Net) -> dict[str | None, float]:
    """Thresholds by language (null as ""), and one under None for all others, from scored (doc_id, lang, score).

    Counted are all rows whose label the net could have learned from but did not (see fit()). Rows of a class stand for all rows
    of that class in the language, those learned from included, so that the shares of the classes are those of all labelled
    rows. A language with fewer than five rows of either class takes the threshold of all languages together.
    """
    if not net.taught:
        return {None: THRESHOLD}
    spark = scored.sparkSession
    taught = F.broadcast(spark.createDataFrame([(i,) for i in sorted(set(net.taught))], "doc_id long").withColumn("taught", F.lit(True)))  # twice the sample at most
    known = _known(labels).select(F.col("doc_id").cast("long").alias("doc_id"), "toxic").join(taught, "doc_id", "left")
    reached = sum((F.col("score") >= t).cast("int") for t in STEPS)
    rows = scored.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("lang", F.lit("")).alias("lang"), reached.alias("reached")).join(known, "doc_id")
    counted = cut(rows.groupBy("lang", "toxic", F.coalesce("taught", F.lit(False)).alias("taught"), "reached").count())

    def tables(key: str, of: DataFrame) -> dict:
        found: dict = {}
        for r in of.groupBy(key, "toxic", "taught", "reached").agg(F.sum("count").alias("n")).collect():
            counts, shares = found.setdefault(r[key], (np.zeros((2, len(STEPS) + 1)), np.zeros(2)))
            shares[r["toxic"]] += r["n"]
            if not r["taught"]:
                counts[r["toxic"], r["reached"]] += r["n"]
        return found

    fresh = lambda c: F.sum(F.when((F.col("toxic") == c) & ~F.col("taught"), F.col("count")).otherwise(0))
    enough = counted.groupBy("lang").agg(fresh(0).alias("clean"), fresh(1).alias("bad")).where("clean >= 5 and bad >= 5").select("lang")
    pooled = tables("every", counted.withColumn("every", F.lit(1)))
    out = {None: best_threshold(*pooled[1]) if pooled else THRESHOLD}
    return out | {lang: best_threshold(*found, out[None]) for lang, found in sorted(tables("lang", counted.join(enough, "lang", "left_semi")).items())}


def _remainder(id_col: str):
    return F.crc32(F.col(id_col).cast("string")) % 4


def _known(labels: DataFrame) -> DataFrame:
    """(doc_id, toxic) of the labelled rows that may be learned from."""
    return labels.where(F.col("toxic").isin(0, 1) & (_remainder("doc_id") != 2)).groupBy("doc_id").agg(F.max("toxic").alias("toxic"))


def fit(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE, chars: int = SAMPLE_CHARS) -> Net:
    """Learns from labels (doc_id, toxic 0 or 1) of rows whose crc32(doc_id as text) mod 4 is not 2.

    At most `sample` documents of either class, the first by a hash of the id, come to the driver, one text for each id (the least, where an
    id has several) and at most `chars` characters of it: these two parameters bound what is learned from. The class shares are counted over
    all labelled rows. A fifth of the sample is kept out for the thresholds (see calibrated()). Rows with another label, a null one or
    a null id teach nothing; a document labelled both ways counts as toxic. Without rows of both classes the score is
    the share of toxic ones, or 0.
    """
    known = _known(labels)
    shares = {r["toxic"]: r["count"] for r in known.groupBy("toxic").count().collect()}
    drawn = None
    for label in (0, 1):
        ids = known.where(F.col("toxic") == label).select(F.col("doc_id").cast("long").alias("doc_id"), "toxic").orderBy(F.xxhash64("doc_id", F.lit(9)), "doc_id").limit(sample)
        drawn = ids if drawn is None else drawn.unionByName(ids)
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.substring(F.coalesce("text", F.lit("")), 1, chars).alias("text")).join(F.broadcast(drawn), "doc_id")
    once = texts.groupBy("doc_id", "toxic").agg(F.min("text").alias("text"))  # copies of an id meet before they reach the driver
    got = sorted(once.collect(), key=lambda r: (zlib.crc32(f"s{r['doc_id']}".encode()), r["doc_id"]))  # 2 * sample rows at most
    y = np.array([r["toxic"] for r in got], int)
    prior = (shares.get(1, 0) + 0.5) / (sum(shares.values()) + 1)
    if len(set(y.tolist())) < 2:
        net = Net.new(9)
        net.out[:] = 0
        net.shift = math.log(prior / (1 - prior)) if shares else -40.0
        return net
    part = len(got) // 5
    net = train([r["text"] for r in got[part:]], y[part:].tolist())
    seen = y[part:].mean()
    net.shift += math.log(prior / (1 - prior)) - math.log(seen / (1 - seen))
    net.taught = [int(r["doc_id"]) for r in got[part:]]
    return net


_READY: dict[str, Scorer] = {}


def score(docs: DataFrame, net: Net) -> DataFrame:
    """(doc_id, lang, score) for each row of docs, its text read whole; a null text is an empty one. No shuffle."""
    sent = docs.sparkSession.sparkContext.broadcast(net)  # 4 MB, whatever the table
    name = f"{docs.sparkSession.sparkContext.applicationId} {sent._jbroadcast.id()}" if sent._jbroadcast is not None else str(id(sent))

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if name not in _READY:
            _READY.clear()
            _READY[name] = Scorer(sent.value)
        for batch in batches:
            yield pa.RecordBatch.from_pydict({"doc_id": batch.column(0), "lang": batch.column(2), "score": pa.array(_READY[name].scores(batch.column(1).to_pylist()), pa.float64())})

    lang = F.col("lang").cast("string") if "lang" in docs.columns else F.lit(None).cast("string").alias("lang")
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", lang).select("doc_id", "text", "lang").mapInArrow(each, "doc_id long, lang string, score double")


def toxicity(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE, chars: int = SAMPLE_CHARS) -> DataFrame:
    """(doc_id, held_out, score, predicted) for each row of docs.

    held_out: crc32(doc_id as text) mod 4 is 2 (a null id: false, and it is not learned from). score: 0 to 1, from the text alone; null and empty
    texts have a score like any other. predicted: 1 if score >= 0.3. Repeated rows stay; other columns, whatever their
    names, are not read; an empty table gives an empty one.
    """
    scored = score(docs, fit(docs, labels, sample, chars))
    return scored.select("doc_id", F.coalesce(_remainder("doc_id") == 2, F.lit(False)).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))


def without_toxic(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE, chars: int = SAMPLE_CHARS) -> DataFrame:
    """docs without the rows whose score reaches their language's threshold (see calibrated(); 0.3 where nothing is learned); columns as in docs.

    The rows are scored once and written with their scores: thresholds need the scores of all labelled rows first.
    """
    net = fit(docs, labels, sample, chars)
    columns = docs.columns
    sent = docs.sparkSession.sparkContext.broadcast(net)
    name = f"{docs.sparkSession.sparkContext.applicationId} {sent._jbroadcast.id()}"

    @F.pandas_udf("double")
    def scored(texts):
        import pandas as pd

        if name not in _READY:
            _READY.clear()
            _READY[name] = Scorer(sent.value)
        return pd.Series(_READY[name].scores(texts.tolist()))

    (own,) = unused(docs, "__score")
    rows = written(docs.withColumn(own, scored("text")), "toxicity")
    lang = F.coalesce(F.col("lang").cast("string"), F.lit("")) if "lang" in columns else F.lit("")
    levels = calibrated(rows.select("doc_id", lang.alias("lang"), F.col(own).alias("score")), labels, net)
    pooled = levels.pop(None)
    limit = F.coalesce(F.create_map(*(F.lit(x) for pair in levels.items() for x in pair))[lang], F.lit(pooled)) if levels else F.lit(pooled)
    return rows.where(F.col(own) < limit).select(*columns)
