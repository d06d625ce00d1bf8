"""Hard-negative mining with Kronecker-packed products.

Components are whole numbers, floor(scale * x). The components of several candidates, biased to be at least zero, are laid into separated fields of one wide
integer; one multiplication by an anchor's component serves them all, and after the sum over components each field holds one candidate's inner product, from
which the bias is taken off. Where two fields or more fit into 53 bits the wide integer is kept in a double, which holds it exactly, so that
a matrix product multiplies; else it is one Python integer for all candidates of a shard.

Rows are dealt to shards of bounded size by a hash of their label, so that an anchor's positives are in few of them; a label of many rows has many
shards. Anchors go to the shards that may hold what they look for and stream past each, in groups of bounded size: a shard is sent once for each group.
Each shard hands on the best few for each anchor, and a window keeps the best of those.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from assaylake.llm.shared import blocks_for, written
from assaylake.llm.vectors import sound

#: Rows of a shard, about; anchors that share one sending of a shard; classes of labels; scores held at a time.
SHARD, GROUP, CLASSES, SCORES = 8192, 1 << 18, 32, 1 << 21
#: Bits of a whole number that a double holds; size of components from which rows have shards of their own.
BITS, WILD = 53, 4096.0
#: Of sort keys: room for a score times a shard's rows, and the anchors that one array of them holds.
ROOM, ANCHORS = 1 << 44, 1 << 14


class Packed:
    """The candidates of a shard: ids ascending, labels, and their components in fields of wide integers."""

    def __init__(self, ids: np.ndarray, labels: np.ndarray, rows: np.ndarray):
        order = np.argsort(ids, kind="stable")
        self.ids, self.labels, self.rows = ids[order], labels[order], rows[order]
        self.bias = -int(self.rows.min())
        self.top = int(self.rows.max()) + self.bias
        self.made: dict[int, np.ndarray | list[int]] = {}

    def bits(self, anchors: np.ndarray) -> np.ndarray:
        """Bits of a field for the products with each anchor: its sign and the largest sum that may come up."""
        most = [sum(abs(int(x)) for x in a) for a in anchors] if np.abs(anchors).max() >= 2.0**40 else np.abs(anchors).sum(1)
        return np.array([(int(m) * self.top).bit_length() + 1 for m in most])

    def _doubles(self, bits: int) -> np.ndarray:
        """(components, wide integers): field i of number j holds candidate i * (numbers) + j."""
        if bits not in self.made:
            fields = BITS // bits
            width = -(-len(self.ids) // fields)
            padded = np.zeros((fields * width, self.rows.shape[1]))
            padded[: len(self.ids)] = self.rows + self.bias
            shift = 2.0 ** (bits * np.arange(fields))
            self.made = {bits: np.ascontiguousarray((padded.reshape(fields, width, -1) * shift[:, None, None]).sum(0).T)}
        return self.made[bits]

    def scores(self, anchors: np.ndarray, bits: int) -> np.ndarray:
        """(anchors, candidates): inner products as int64; at least two fields of that many bits must fit into a double."""
        wide = self._doubles(bits)
        fields, width = BITS // bits, wide.shape[1]
        middle = 1 << (bits - 1)
        total = (anchors @ wide).astype(np.int64) + sum(middle << (bits * i) for i in range(fields))  # now each field is at least zero
        out = np.empty((len(anchors), fields * width), np.int64)
        for i in range(fields):
            np.bitwise_and(total >> (bits * i), (1 << bits) - 1, out=out[:, i * width : (i + 1) * width])
        out -= (middle + self.bias * anchors.sum(1).astype(np.int64))[:, None]
        return out[:, : len(self.ids)]

    def wide_scores(self, anchor: np.ndarray, bits: int) -> np.ndarray:
        """The inner products of one anchor, as Python integers, whatever their size."""
        size = -(-bits // 8)
        if -size not in self.made:
            biased = [[int(x) + self.bias for x in column] for column in self.rows.T]
            self.made = {-size: [int.from_bytes(b"".join(x.to_bytes(size, "little") for x in column), "little") for column in biased]}
        middle, whole = 1 << (8 * size - 1), [int(x) for x in anchor]
        ground = int.from_bytes(middle.to_bytes(size, "little") * len(self.ids), "little")
        raw = (sum(x * w for x, w in zip(whole, self.made[-size], strict=True)) + ground).to_bytes(size * len(self.ids), "little")
        off = middle + self.bias * sum(whole)
        return np.array([int.from_bytes(raw[i : i + size], "little") - off for i in range(0, len(raw), size)], object)

    def parts(self, anchors: np.ndarray) -> Iterator[tuple[np.ndarray, int]]:
        """(places of some anchors, bits of their fields): those of about the same bits together, as many as SCORES allows."""
        bits = self.bits(anchors)
        quick = bits <= BITS // 2
        step = min(ANCHORS, max(1, SCORES // len(self.ids)))
        if quick.any():
            some = np.flatnonzero(quick)
            for at in range(0, len(some), step):
                yield some[at : at + step], int(bits[some].max())
        for n in np.flatnonzero(~quick):
            yield np.array([n]), int(bits[n])


def positives(shard: Packed, ids: np.ndarray, labels: np.ndarray, anchors: np.ndarray, k: int) -> Iterator[tuple[int, int, int]]:
    """(place of the anchor, candidate's id, score) of each anchor's k best candidates of its label and of another id."""
    size = len(shard.ids)
    for some, bits in shard.parts(anchors):
        able = (shard.labels == labels[some, None]) & (shard.ids != ids[some, None])
        if bits > BITS // 2:
            score = shard.wide_scores(anchors[some[0]], bits)
            for i in heapq.nlargest(k, np.flatnonzero(able[0]).tolist(), key=lambda i: (score[i], -i)):
                yield int(some[0]), int(shard.ids[i]), int(score[i])
            continue
        score = shard.scores(anchors[some], bits)
        key = np.where(able, score * size - np.arange(size), -ROOM * size)  # of one score the smaller id first
        best = np.argpartition(key, size - k, axis=1)[:, -k:] if size > k else np.broadcast_to(np.arange(size), key.shape)
        row = np.repeat(np.arange(len(some)), best.shape[1])
        best = best.ravel()
        keep = able[row, best]
        yield from zip(some[row[keep]].tolist(), shard.ids[best[keep]].tolist(), score[row[keep], best[keep]].tolist(), strict=True)


def negatives(shard: Packed, labels: np.ndarray, anchors: np.ndarray, goals: np.ndarray, k: int, share: tuple[int, int]) -> Iterator[tuple[int, int, int, int]]:
    """(place of the anchor, number of the positive, candidate's id, score) of the k best candidates of another label that score from share of the positive's score up to it.

    goals: (anchors, positives) scores, -1 where there is none: a score below zero leaves no room for any.
    """
    size, (part, of) = len(shard.ids), share
    floors = -((-part * goals) // of)
    for some, bits in shard.parts(anchors):
        able = shard.labels != labels[some, None]
        if bits > BITS // 2:
            score = shard.wide_scores(anchors[some[0]], bits)
            for p, (high, low) in enumerate(zip(goals[some[0]], floors[some[0]], strict=True)):
                fit = np.flatnonzero(able[0] & (score <= high) & (score >= low)).tolist() if high >= 0 else []
                for i in heapq.nlargest(k, fit, key=lambda i: (score[i], -i)):
                    yield int(some[0]), p, int(shard.ids[i]), int(score[i])
            continue
        score = shard.scores(anchors[some], bits)
        goal = np.minimum(goals[some], 1 << BITS // 2).astype(np.int64)  # no score here is above that
        floor = np.minimum(floors[some], 1 << BITS // 2).astype(np.int64)
        has = goal >= 0
        low = np.where(has, floor, 1 << 60).min(1, initial=1 << 60)
        row, place = np.nonzero(able & (score >= low[:, None]) & (score <= goal.max(1, initial=-1)[:, None]))
        # One number for each that is left: by anchor, then the higher score, then the smaller id.
        key = np.sort(row * ROOM + ROOM // 2 - score[row, place] * size + place)
        anchor, number = np.nonzero(has)
        start = np.searchsorted(key, anchor * ROOM + ROOM // 2 - goal[anchor, number] * size)
        for step in range(k):
            inside = np.flatnonzero(start + step < len(key))
            found = key[start[inside] + step]
            told = found % ROOM - ROOM // 2
            place = told % size
            value = (place - told) // size
            good = (found // ROOM == anchor[inside]) & (value >= floor[anchor[inside], number[inside]])
            at = inside[good]
            yield from zip(some[anchor[at]].tolist(), number[at].tolist(), shard.ids[place[good]].tolist(), value[good].tolist(), strict=True)


class Streams:
    """Of rows sorted by (unit, kind): the shards, then the anchors that pass them."""

    def __init__(self, scale: int):
        self.scale, self.unit, self.held, self.shards = scale, None, [], None

    def vectors(self, batch: pa.RecordBatch) -> list[np.ndarray]:
        flat = batch.column("vector").flatten().to_numpy(zero_copy_only=False).astype(np.float64)
        ends = np.cumsum(batch.column("size").to_numpy())
        return np.split(np.floor(self.scale * flat), ends[:-1])

    def opened(self) -> dict[int, Packed]:
        """The shard by size of vector; labels are numbered, as names has them."""
        if self.shards is None:
            ids, labels, rows = (list(x) for x in zip(*self.held, strict=True)) if self.held else ([], [], [])
            self.names = {label: n for n, label in enumerate(sorted(set(labels)))}
            size = np.array([len(r) for r in rows], int)
            number = np.array([self.names[x] for x in labels], np.int64)
            self.shards = {int(s): Packed(np.array(ids, np.int64)[at], number[at], np.stack([rows[i] for i in at])) for s in np.unique(size) for at in [np.flatnonzero(size == s)]}
            self.held = []
        return self.shards

    def met(self, batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray, Packed, np.ndarray]]:
        """(batch, places in it, label numbers, shard, vectors) of the anchors of each batch with what they pass."""
        for batch in batches:
            unit, kind = batch.column("unit").to_numpy(), batch.column("kind").to_numpy()
            size, rows = batch.column("size").to_numpy(), self.vectors(batch)
            ids, labels = batch.column("id").to_numpy(), batch.column("label").to_pylist()
            step = np.flatnonzero(np.r_[True, (unit[1:] != unit[:-1]) | (kind[1:] != kind[:-1])]) if len(unit) else []
            for first, end in zip(step, [*step[1:], len(unit)], strict=True):
                if unit[first] != self.unit:
                    self.unit, self.held, self.shards = unit[first], [], None
                if kind[first] == 0:
                    self.held += [(ids[n], labels[n], rows[n]) for n in range(first, end)]
                    continue
                shards = self.opened()
                for s, shard in shards.items():
                    at = first + np.flatnonzero(size[first:end] == s)
                    if len(at):
                        yield batch, at, np.array([self.names.get(labels[n], -1) for n in at], np.int64), shard, np.stack([rows[n] for n in at])


def _long(score: int) -> int:
    if not -(1 << 63) <= score < 1 << 63:
        raise OverflowError(f"a score is beyond a long: {score}")
    return score


def _find_positives(k: int, scale: int):
    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, at, labels, shard, rows in Streams(scale).met(batches):
            ids, row = batch.column("id").to_numpy()[at], batch.column("row").to_numpy()[at]
            found = [(row[n], i, _long(s)) for n, i, s in positives(shard, ids, labels, rows, k)]
            columns = list(zip(*found, strict=True)) or [[], [], []]
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], ["row", "positive_id", "positive_score"])

    return find


def _find_negatives(k: int, scale: int, share: tuple[int, int]):
    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, at, labels, shard, rows in Streams(scale).met(batches):
            ids, row, told = batch.column("id").to_numpy()[at], batch.column("row").to_numpy()[at], batch.column("goals").take(pa.array(at)).to_pylist()
            goals = np.full((len(at), max(map(len, told))), -1, object)
            for n, some in enumerate(told):
                goals[n, : len(some)] = [g["positive_score"] for g in some]
            found = [(row[n], ids[n], p + 1, told[n][p]["positive_id"], told[n][p]["positive_score"], i, _long(s)) for n, p, i, s in negatives(shard, labels, rows, goals, k, share)]
            columns = list(zip(*found, strict=True)) or [[]] * 7
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], ["row", "anchor_id", "nth", "positive_id", "positive_score", "negative_id", "negative_score"])

    return find


def mine(rows: DataFrame, anchors: Column, k: int = 5, scale: int = 256, share: tuple[int, int] = (80, 100), id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label", shard: int = SHARD) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score): each anchor's hard negatives beside each of its positives.

    A score is the inner product with the anchor of floor(scale * x), an integer; higher ones come first, ties by the smaller id. anchors: a condition on the rows
    that tells which are anchors. An anchor's positives are its first k rows of the same label and of another id. For each, the first k rows of another label
    with share[0] * positive_score <= share[1] * negative_score <= share[1] * positive_score are returned; rank counts them from 1.

    Rows with a null id, label or vector, an empty vector, or a component that is null or no finite number take no part; vectors of
    different sizes do not meet. Repeated rows are anchors, positives and negatives of their own. A positive of a score below zero has no
    negatives. Other columns, whatever their names, are not read (but by the condition). Empty tables, and those without anchors or with one label, give an empty one. Components may be of
    any size; a score of a result that a long does not hold is an error.
    """
    if not 1 <= shard <= 1 << 15:
        raise ValueError("a shard has 1 to 32768 rows")
    spark = rows.sparkSession
    named = rows.select(F.col(id_col).cast("long").alias("id"), F.col(label_col).cast("string").alias("label"), F.col(vector_col).alias("vector"), F.coalesce(anchors, F.lit(False)).alias("anchor"))
    able = named.where(F.col("id").isNotNull() & F.col("label").isNotNull() & sound(F.col("vector"))).withColumn("size", F.size("vector"))
    wild = F.exists("vector", lambda x: F.abs(x.cast("double")) >= WILD).cast("int")
    # Written with their numbers, so that a lost executor does not number them anew.
    table = written(able.withColumns({"row": F.monotonically_increasing_id(), "class": F.pmod(F.xxhash64("label", "size"), F.lit(CLASSES)).cast("int") * 2 + wild}), "labelled-vectors")
    classes = table.groupBy("class").agg(F.count("*").alias("n"), F.min("label").alias("low"), F.max("label").alias("high")).orderBy("class").collect()  # 2 * CLASSES rows at most
    base, total = {}, 0
    for r in classes:
        base[r["class"]] = (total, blocks_for(r["n"], shard))
        total += base[r["class"]][1]
    chosen = table.where("anchor")
    groups = blocks_for(chosen.count(), GROUP)
    schema = "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long"
    if not total:
        return spark.createDataFrame([], schema)
    spread = max(int(spark.conf.get("spark.sql.shuffle.partitions")), blocks_for(total * groups, 4))
    pick = lambda part: F.create_map(*(F.lit(x) for c, found in base.items() for x in (c, found[part])))[F.col("class")]
    number = (pick(0) + F.pmod(F.xxhash64("row"), pick(1))).cast("long")
    sides = ["unit", "kind", "row", "id", "label", "size", "vector"]
    no_goals = F.lit(None).cast("array<struct<nth:int,positive_id:bigint,positive_score:bigint>>")
    copies = table.withColumn("group", F.explode(F.sequence(F.lit(0), F.lit(groups - 1))))  # one for each group of anchors
    shards = copies.withColumns({"unit": number * groups + F.col("group"), "kind": F.lit(0)}).select(*sides, no_goals.alias("goals"))

    def streamed(asked: DataFrame, wanted) -> DataFrame:
        """Shards and the anchors (with goals) that pass them, each unit's rows together; wanted(class, low, high) tells which anchors a class concerns."""
        none = F.array().cast("array<int>")
        lists = [F.when(wanted(r["class"], r["low"], r["high"]), F.sequence(F.lit(base[r["class"]][0]), F.lit(sum(base[r["class"]]) - 1))).otherwise(none) for r in classes]
        visits = asked.withColumn("shard", F.explode(F.flatten(F.array(*lists)))).withColumns({"unit": F.col("shard").cast("long") * groups + F.pmod(F.xxhash64("row"), F.lit(groups)), "kind": F.lit(1)})
        both = shards.unionByName(visits.select(*sides, "goals"))
        return both.repartition(spread, "unit").sortWithinPartitions("unit", "kind")

    own = streamed(chosen.withColumn("goals", no_goals), lambda c, low, high: F.floor(F.col("class") / 2) == c // 2)
    met = own.mapInArrow(_find_positives(k, scale), "row long, positive_id long, positive_score long")
    order = Window.partitionBy("row").orderBy(F.col("positive_score").desc(), "positive_id")
    best = met.withColumn("nth", F.row_number().over(order)).where(F.col("nth") <= k)
    goals = written(best.groupBy("row").agg(F.array_sort(F.collect_list(F.struct("nth", "positive_id", "positive_score"))).alias("goals")), "positives")  # k of each
    others = streamed(chosen.join(goals, "row"), lambda c, low, high: ~((F.lit(low) == F.lit(high)) & (F.col("label") == F.lit(low))))
    found = others.mapInArrow(_find_negatives(k, scale, share), "row long, anchor_id long, nth long, positive_id long, positive_score long, negative_id long, negative_score long")
    order = Window.partitionBy("row", "nth").orderBy(F.col("negative_score").desc(), "negative_id")
    ranked = found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    return ranked.select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")
