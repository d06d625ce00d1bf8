"""SimHash near-dedup: fingerprints of word shingles, linked within a Hamming radius through BK-trees.

Plan: (1) fingerprints, one narrow pass over the texts; (2) equal fingerprints become one class; (3) every
class goes to the C(6, 2) shards that two of its six bit bands name: fingerprints that differ in at most four
bits agree on two bands at least, so each link is met in some shard; (4) a BK-tree is built of each shard and
each member follows only the edges within the radius; a task returns a spanning forest of the links it found, not
all pairs; (5) components of the forests; (6) back to the documents by fingerprint.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import MapType

from assaylake.llm.components import connected_components
from assaylake.llm.shared import unused, written

#: (first bit, bits) of the bands.
BANDS = ((0, 11), (11, 11), (22, 11), (33, 11), (44, 10), (54, 10))
#: Shards of more members than this are split, and their parts are met pair by pair.
PART = 4096


def fingerprint(text: str | None, width: int = 4) -> int:
    """64-bit SimHash, unsigned, of the shingles of width words (repeats count); no words: 0.

    A-Z are lower-cased and words are cut at ASCII white space. A bit is 1 if set in over half the XXH64
    (seed 42) hashes. A text of fewer words is one shingle. Null counts as empty.
    """
    words = (text or "").encode().lower().split()
    if not words:
        return 0
    shingles = [b" ".join(words)] if len(words) <= width else map(b" ".join, zip(*(words[i:] for i in range(width)), strict=False))
    digest = xxhash.xxh64_intdigest
    hashes = np.array([digest(s, 42) for s in shingles], dtype="<u8")
    ones = np.zeros(64, np.int64)
    for start in range(0, len(hashes), 65536):  # bounded memory for very long texts
        ones += np.unpackbits(hashes[start : start + 65536].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(hashes), bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 4, also: dict[str, Column] | None = None) -> DataFrame:
    """(doc_id, fp) and the longs of also, none of them null: fp is the fingerprint as a signed long. One row for each input row."""
    also = also or {}

    def each(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            fps = np.array([fingerprint(t, width) for t in batch["text"]], dtype="<u8").view("<i8")
            yield pd.DataFrame({"doc_id": batch["doc_id"], "fp": fps, **{name: batch[name] for name in names}})

    names = list(also)
    told = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"), *(c.alias(name) for name, c in also.items()))
    return told.mapInPandas(each, ", ".join(["doc_id long", "fp long", *(f"{name} long" for name in names)]))


class BKForest:
    """BK-trees over the groups of a sorted batch, in arrays: a child hangs on its parent by its integer distance.

    Level by level, the members that reach a node by the same distance form the next node (the first of them)
    and what hangs below it. Edges are kept sorted by (parent, distance), so that the children of a node within
    [distance - radius, distance + radius] are one slice.
    """

    def __init__(self, group: np.ndarray, value: np.ndarray):
        self.value = value
        self.roots, edges = {}, []
        order = np.argsort(group, kind="stable")
        held, place = order, group[order]  # what still needs a node, and the place it has reached
        parents = None
        while len(held):
            first = np.r_[True, place[1:] != place[:-1]]
            node = held[first][np.cumsum(first) - 1]  # the first member at each place becomes its node
            if parents is None:
                self.root_of_group = dict(zip(place[first].tolist(), held[first].tolist(), strict=True))
                self.root = np.empty(len(group), np.int64)
                self.root[held] = node
            else:
                edges.append(np.stack([place[first], held[first]]))
            rest = ~first
            held, node = held[rest], node[rest]
            distance = np.bitwise_count(value[held] ^ value[node]).astype(np.int64)
            place = node * 128 + distance
            order = np.argsort(place, kind="stable")
            held, place, parents = held[order], place[order], True
        found = np.concatenate(edges, axis=1) if edges else np.empty((2, 0), np.int64)
        order = np.argsort(found[0], kind="stable")
        self.key, self.child = found[0][order], found[1][order]

    def links(self, asked: np.ndarray, start: np.ndarray, radius: int, most: int = 1 << 20) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Pairs (member asked, node) within radius, from the node start on; the frontier is kept in parts of bounded size."""
        stack = [(asked, start)]
        while stack:
            query, node = stack.pop()
            if len(query) > most:
                stack.append((query[most:], node[most:]))
                query, node = query[:most], node[:most]
            distance = np.bitwise_count(self.value[query] ^ self.value[node]).astype(np.int64)
            near = (distance <= radius) & (query != node)
            if near.any():
                yield query[near], node[near]
            low = np.searchsorted(self.key, node * 128 + np.maximum(distance - radius, 0), "left")
            high = np.searchsorted(self.key, node * 128 + distance + radius, "right")
            count = high - low
            if count.any():
                at = np.repeat(low - np.r_[0, np.cumsum(count)[:-1]], count) + np.arange(count.sum())
                stack.append((np.repeat(query, count), self.child[at]))


def spanning(a: np.ndarray, b: np.ndarray, label: np.ndarray) -> None:
    """Merges the labels (in place) of members that the links a-b join; a label is a member of its own component."""
    while len(a):
        x, y = label[a], label[b]
        apart = x != y
        if not apart.any():
            break
        a, b, x, y = a[apart], b[apart], x[apart], y[apart]
        np.minimum.at(label, np.maximum(x, y), np.minimum(x, y))
        while not np.array_equal(short := label[label], label):
            label[:] = short


def _forests(batches: Iterator[pd.DataFrame], radius: int) -> Iterator[pd.DataFrame]:
    """Of rows sorted by (shard, left, right): a spanning forest of the links in each run of whole groups."""

    def solve(rows: pd.DataFrame) -> pd.DataFrame:
        fp = rows["fp"].to_numpy("int64").view(np.uint64)
        step = (rows[["shard", "left", "right"]].diff() != 0).any(axis=1).to_numpy()
        forest = BKForest(np.cumsum(step), fp)
        label = np.arange(len(fp))
        for a, b in forest.links(np.arange(len(fp)), forest.root, radius):
            spanning(a, b, label)
        joined = np.flatnonzero(label != np.arange(len(fp)))
        return pd.DataFrame({"a": fp[joined].view(np.int64), "b": fp[label[joined]].view(np.int64)})

    held: list[pd.DataFrame] = []
    count = 0
    for batch in batches:
        held.append(batch)
        count += len(batch)
        if count < 30_000:
            continue
        rows = pd.concat(held, ignore_index=True)
        last = rows[["shard", "left", "right"]].iloc[-1]
        whole = (rows[["shard", "left", "right"]] != last).any(axis=1).to_numpy()
        if whole.any():
            yield solve(rows[whole])
        held = [rows[~whole]]
        count = len(held[0])
    if count:
        yield solve(pd.concat(held, ignore_index=True))


def links_of(classes: DataFrame, radius: int = 4, part: int = PART) -> DataFrame:
    """Links (a, b) between distinct fingerprints (column fp) whose closure holds every pair within radius (at most 4).

    A shard of more than part members is split by a hash of the fingerprint and its parts are met pair by pair,
    so that a task holds two parts at most whatever the size of a shard.
    """
    if radius > 4:
        raise ValueError("six bands hold pairs of at most four differing bits")
    band = lambda k: F.shiftrightunsigned("fp", BANDS[k][0]).bitwiseAND(F.lit((1 << BANDS[k][1]) - 1))
    shards = [F.lit(n << 24) + F.shiftleft(band(i), 12) + band(j) for n, (i, j) in enumerate(combinations(range(len(BANDS)), 2))]
    routed = classes.select("fp", F.explode(F.array(*shards)).alias("shard"))
    sizes = routed.groupBy("shard").count().where("count > 1").select("shard", F.ceil(F.col("count") / part).cast("int").alias("parts"))
    own = F.pmod(F.xxhash64("fp"), "parts").cast("int")
    met = (
        routed.hint("merge").join(sizes.hint("merge"), "shard")  # Spark's size of routed is that before the explode
        .withColumn("own", own)
        .withColumn("other", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
        .select("shard", F.least("own", "other").cast("long").alias("left"), F.greatest("own", "other").cast("long").alias("right"), "fp")
    )
    return met.repartition("shard", "left", "right").sortWithinPartitions("shard", "left", "right").mapInPandas(lambda batches: _forests(batches, radius), "a long, b long")


def _rooted(classes: DataFrame, radius: int) -> DataFrame:
    """classes (fp, first) with component, the name of the component of each fp."""
    tied = connected_components(links_of(classes, radius))
    return classes.join(tied.withColumnRenamed("node", "fp"), "fp", "left").select("fp", "first", F.coalesce("component", "fp").alias("component"))


def simhash_components(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", radius: int = 4, width: int = 4) -> DataFrame:
    """(doc_id, fingerprint, component_id) for each row of docs.

    fingerprint: 16 lower-case hex digits. component_id: the smallest doc_id reachable through links (radius or
    fewer differing bits), the row's own included. Null and empty texts have fingerprint zero and link like any
    other. A null doc_id never becomes a component_id unless its whole component has none (then null). Repeated
    rows keep their number; other columns of docs, whatever their names, are not read. An empty table gives an
    empty one.
    """
    fps = written(fingerprints(docs, id_col, text_col, width), "fingerprints")
    classes = written(fps.groupBy("fp").agg(F.min("doc_id").alias("first")), "classes")
    rooted = _rooted(classes, radius)
    lowest = rooted.groupBy("component").agg(F.min("first").alias("component_id"))
    found = rooted.join(lowest, "component").select("fp", "component_id")
    return fps.join(found, "fp").select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def keep_first(docs: DataFrame, radius: int = 4) -> DataFrame:
    """The documents without near copies: one row of each component stays, that with the smallest doc_id.

    Ids need not be there nor be distinct: rows with a null id come last, and among equal ids a hash of the row decides, so
    that different texts stay whatever their ids. Of rows equal in all columns one stays.
    """
    told = [x for f in docs.schema.fields if not isinstance(f.dataType, MapType) for x in (F.col(f.name), F.col(f.name).isNull())]  # a null alone does not change a hash
    one, two = unused(docs, "__one", "__two")
    keys = {one: F.xxhash64(F.lit(1), *told), two: F.xxhash64(F.lit(2), *told)}
    own = F.col("doc_id").cast("long")
    also = {"none": own.isNull().cast("long"), "id": F.coalesce(own, F.lit(0)), **keys}
    fps = written(fingerprints(docs, also=also).drop("doc_id"), "fingerprints")
    classes = written(fps.groupBy("fp").agg(F.min(F.struct(*also)).alias("first")), "classes")
    kept = _rooted(classes, radius).groupBy("component").agg(F.min("first").alias("first")).select(*(F.col(f"first.{k}").alias(k) for k in keys))
    once = docs.withColumns(keys).join(kept.hint("merge"), list(keys), "left_semi")
    return once.dropDuplicates(list(keys)).select(*docs.columns)
