"""Exact top-k inner-product search with M-trees.

With one more component, sqrt(M^2 - |x|^2) for the rows and 0 for a query, the largest inner products are the smallest
Euclidean distances: d^2 = |q|^2 + M^2 - 2 <q, x>. Rows are dealt into shards of bounded size; each shard is an M-tree of
pages: an entry holds a routing row, the covering radius of what lies below, and its distance to the routing row of its
own page. A search takes the page with the smallest lower bound first; the stored distances rule out entries by the
triangle inequality before their inner product is computed. Scores are exact integers; ties go to the smaller id.

Shards are compact: rows near one pivot, in one ring about it (vectors.deal). No row x of a ring of greatest distance r about c scores more
than <q, c> + |q| r, so a query goes first to the shard that promises most, and then, with the k-th score found there as a floor, to those shards alone
whose bound reaches it.
"""

from __future__ import annotations

import heapq
import math
import pickle
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from assaylake.llm.shared import blocks_for, written
from assaylake.llm.vectors import Groups, deal, matrix, packed, sound

#: Rows in a shard, queries in a block, entries of an inner page and of a leaf, blocks of queries that share one sending of a tree.
SHARD, QUERIES, PAGE, LEAF, TOGETHER = 8192, 4096, 16, 512, 16
#: Components below which a tree is searched, and the sum of products up to which float64 is exact.
MODEST, EXACT = float(1 << 40), float(1 << 53)
#: Stands for scores that are too low for a long.
LEAST = -(1 << 63)


class MTree:
    """An M-tree over integer rows. pages: (routing row, leaf?, entries, parent distances, radii, child pages)."""

    def __init__(self, ids: np.ndarray, rows: np.ndarray, page: int = PAGE, leaf: int = LEAF, seed: int = 3):
        order = np.argsort(ids, kind="stable")
        self.ids, self.rows = ids[order], rows[order].astype(np.float64)
        self.largest = float(np.abs(self.rows).max())
        if self.largest >= MODEST:  # distances would be lost in rounding
            return
        self.norm2 = np.einsum("ij,ij->i", self.rows, self.rows)
        self.top2 = self.norm2.max()
        self.lift = np.sqrt(self.top2 - self.norm2)
        self.page, self.leaf, self.rng = page, leaf, np.random.default_rng(seed)
        self.pages: list[tuple] = []
        everything = np.arange(len(ids))
        self.root_row = 0
        self.root, self.root_radius = self._grow(everything, 0, self.distance(0, everything))
        self._lay_out()

    def distance(self, row: int, rows: np.ndarray) -> np.ndarray:
        """Metric distances between rows of the tree."""
        inner = self.rows[rows] @ self.rows[row] + self.lift[rows] * self.lift[row]
        return np.sqrt(np.maximum(2 * (self.top2 - inner), 0.0))

    def _grow(self, rows: np.ndarray, routing: int, away: np.ndarray) -> tuple[int, float]:
        """Adds the page for rows (away: their distances to the routing row) and all below; (page, covering radius)."""
        number = len(self.pages)
        self.pages.append(())
        if len(rows) <= self.leaf:
            self.pages[number] = (routing, True, rows, away, np.zeros(len(rows)), None)
            return number, float(away.max())
        width = min(self.page, -(-len(rows) // self.leaf))  # no more entries than leaves are needed
        routes = self.rng.choice(rows, width, replace=False)
        to = np.stack([self.distance(r, rows) for r in routes])
        nearest = to.argmin(0)
        if np.bincount(nearest, minlength=width).max() > 0.9 * len(rows):  # many equal rows: deal them out evenly
            nearest = np.arange(len(rows)) * width // len(rows)
        entries, parent, radii, children = [], [], [], []
        for k, route in enumerate(routes):
            below = np.flatnonzero(nearest == k)
            if len(below):
                child, radius = self._grow(rows[below], route, to[k, below])
                entries.append(route)
                parent.append(self.distance(routing, np.array([route]))[0])
                radii.append(radius)
                children.append(child)
        self.pages[number] = (routing, False, np.array(entries), np.array(parent), np.array(radii), children)
        return number, float(away.max())

    def _lay_out(self) -> None:
        """Puts the rows of each leaf side by side, so that a leaf is one slice of the rows."""
        order = np.concatenate([p[2] for p in self.pages if p[1]])
        place = np.empty(len(order), np.int64)
        place[order] = np.arange(len(order))
        self.ids, self.rows, self.norm2, self.lift = self.ids[order], self.rows[order], self.norm2[order], self.lift[order]
        self.root_row = int(place[self.root_row])
        self.pages = [(place[routing], leaf, place[entries], *rest) for routing, leaf, entries, *rest in self.pages]

    def search(self, query: np.ndarray, own: int, k: int, floor: float = -np.inf) -> tuple[list[tuple[int, int]], int]:
        """([(score, id)] of the k best rows but those whose id is own, best first; inner products computed). Scores below floor may be left out."""
        large = float(np.abs(query).max())
        if max(self.largest, large) >= MODEST or len(query) * self.largest * large > EXACT:
            return self._scan(query, own, k)
        base = float(query @ query) + self.top2
        slack = 1e-6 * (1 + np.sqrt(base))
        best: list[tuple[int, int]] = []  # (score, -id): the smallest is the worst
        limit, computed = np.inf if floor == -np.inf else np.sqrt(max(base - 2 * floor, 0.0)), 1
        start = np.sqrt(max(base - 2 * float(self.rows[self.root_row] @ query), 0.0))
        heap = [(max(start - self.root_radius, 0.0), self.root, start)]
        while heap:
            bound, number, to_routing = heapq.heappop(heap)
            if bound > limit + slack:
                break
            _, is_leaf, entries, parent, radii, children = self.pages[number]
            open_ = np.flatnonzero(np.abs(to_routing - parent) - radii <= limit + slack)
            if not len(open_):
                continue
            rows = entries[open_]
            whole = is_leaf and len(open_) == len(entries)
            inner = (self.rows[entries[0] : entries[0] + len(entries)] if whole else self.rows[rows]) @ query
            computed += len(rows)
            if is_leaf and inner.max() < (best[0][0] if len(best) == k else floor):
                continue
            if not is_leaf:
                to = np.sqrt(np.maximum(base - 2 * inner, 0.0))
                low = np.maximum(to - radii[open_], 0.0)
                for n in np.flatnonzero(low <= limit + slack):
                    heapq.heappush(heap, (low[n], children[open_[n]], to[n]))
                continue
            able = self.ids[rows] != own
            inner, names = inner[able], self.ids[rows[able]]
            good = inner >= (best[0][0] if len(best) == k else floor)
            inner, names = inner[good], names[good]
            for n in np.lexsort((names, -inner))[:k]:
                item = (int(inner[n]), -int(names[n]))
                if len(best) < k:
                    heapq.heappush(best, item)
                elif item > best[0]:
                    heapq.heapreplace(best, item)
            if len(best) == k:
                limit = np.sqrt(max(base - 2 * best[0][0], 0.0))
        return [(s, -i) for s, i in sorted(best, reverse=True)], computed


    def _scan(self, query: np.ndarray, own: int, k: int) -> tuple[list[tuple[int, int]], int]:
        """As search, where float64 does not hold the scores: whole numbers for the rows that its bounds do not rule out."""
        able = np.flatnonzero(self.ids != own)
        with np.errstate(over="ignore", invalid="ignore"):
            inner = self.rows[able] @ query
            # A sum of n rounded products is off by less than n + 1 units of rounding of the sum of their sizes.
            off = (len(query) + 2) * 2.0**-52 * (np.abs(self.rows[able]) @ np.abs(query))
            low, high = inner - off, inner + off
        sane = np.isfinite(low) & np.isfinite(high)
        least = np.sort(low[sane])[-k] if sane.sum() >= k else -np.inf
        able = able[~sane | (high >= least)]
        whole = [int(x) for x in query]
        best = heapq.nlargest(k, ((sum(int(x) * y for x, y in zip(self.rows[n], whole, strict=True)), -int(self.ids[n])) for n in able))
        return [(s, -i) for s, i in best], len(self.ids)


def _tree(part: pd.DataFrame) -> dict:
    return {"tree": MTree(part["vec_id"].to_numpy("i8"), np.floor(256 * matrix(part["vector"], "f8")))}


def _queries(part: pd.DataFrame) -> dict:
    return {"ids": part["vec_id"].to_numpy("i8"), "rows": np.floor(256 * matrix(part["vector"], "f8"))}


def bounds(rows: np.ndarray, groups: Groups, size: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(groups, blocks in each, upper bounds of the scores of queries' rows with the rows of each group)."""
    found = groups.of(size)
    reach = np.where(found["cell"] < 0, np.inf, 256.0 * found["high"] + math.sqrt(size))  # floor(256 * x) is off by less than 1 in each component
    with np.errstate(over="ignore", invalid="ignore"):
        at = 256.0 * (rows @ groups.centres(found, size).T)
        most = at + np.linalg.norm(rows, axis=1)[:, None] * reach
        most += 1e-9 * (np.abs(at) + np.abs(most))  # rounding
    return found["group"].to_numpy(), found["blocks"].to_numpy(), np.where(np.isnan(most), np.inf, most)


def _first(n: int, most: np.ndarray, blocks: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The group that promises each of n queries most, and the block of it: any will do, so they are taken in turn."""
    home = most.argmax(1)
    return home, np.arange(n) % blocks[home]


def _routed(groups: Groups, second: bool):
    """Of a block of queries: rows for each group that some of them visit, at first or (with floors) after that.

    A row's parts are the queries' numbers, ids and rows, their floors, and the shard of the group that each has seen (or -1).
    """

    def route(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for asked in batches:
            for row in asked.itertuples(index=False):
                held = pickle.loads(row.blob)
                names, blocks, most = bounds(held["rows"], groups, row.size)
                n = len(held["rows"])
                if not len(names):
                    continue
                home, own = _first(n, most, blocks)
                floor = np.full(n, -np.inf)
                if second and row.floors is not None:
                    for f in row.floors:
                        floor[f["query"]] = f["floor"]
                    floor[np.abs(floor) >= EXACT] = -np.inf  # float64 does not hold them
                for g in range(len(names)) if second else np.unique(home):
                    here = home == g
                    some = np.flatnonzero(most[:, g] >= floor if second else here)
                    if len(some):
                        part = {"n": some, "ids": held["ids"][some], "rows": held["rows"][some], "floor": floor[some], "shard": np.where(here, own, -1)[some]}
                        yield pd.DataFrame([(row.size, int(names[g]), row.block, int(blocks[g]), pickle.dumps(part, 5))], columns=["size", "group", "block", "shards", "blob"])

    return route


_ROUTED = "size int, group int, block int, shards int, blob binary"


def _searched(k: int, second: bool):
    def search(unit: pd.DataFrame) -> pd.DataFrame:
        out: dict[str, list] = {"block": [], "query": [], "query_id": [], "vec_id": [], "score": []}
        shard, is_tree = int(unit["shard"].iloc[0]), unit["kind"] == "tree"
        if is_tree.any():  # a shard's number may name no rows
            tree = pickle.loads(unit["blob"][is_tree].iloc[0])["tree"]
            for block, blob in unit.loc[~is_tree, ["block", "blob"]].itertuples(index=False):
                asked = pickle.loads(blob)
                for n in np.flatnonzero((asked["shard"] == shard) != second):
                    own = int(asked["ids"][n])
                    for score, vec_id in tree.search(asked["rows"][n], own, k, float(asked["floor"][n]))[0]:
                        if score >= 1 << 63:
                            raise OverflowError(f"the score of {own} and {vec_id} is beyond a long: {score}")
                        score = max(score, LEAST)  # an error only where no better ones are found
                        for name, value in zip(out, (int(block), int(asked["n"][n]), own, vec_id, score), strict=True):
                            out[name].append(value)
        frame = pd.DataFrame(out).astype("int64")
        frame.insert(0, "size", int(unit["size"].iloc[0]))
        return frame

    return search


def _visited(trees: DataFrame, routed: DataFrame, k: int, second: bool) -> DataFrame:
    """What queries find in the trees of the shards that they are routed to. A tree is sent once for TOGETHER blocks of queries that visit it."""
    unit = ["size", "group", "shard", "part"]
    visits = routed.select("size", "group", F.explode(F.sequence(F.lit(0), F.col("shards") - 1)).alias("shard"), F.floor(F.col("block") / TOGETHER).alias("part"), "block", F.lit("queries").alias("kind"), "blob")
    units = visits.select(*unit).distinct()
    met = trees.join(units, ["size", "group", "shard"]).select(*unit, F.lit(None).cast("int").alias("block"), F.lit("tree").alias("kind"), "blob")
    return met.unionByName(visits).groupBy(*unit).applyInPandas(_searched(k, second), "size long, block long, query long, query_id long, vec_id long, score long")


def top_k(rows: DataFrame, queries: DataFrame, k: int = 5, id_col: str = "vec_id", vector_col: str = "embedding", shard: int = SHARD) -> DataFrame:
    """(query_id, rank, vec_id, score): each query's k highest scores among rows, ties to the smaller vec_id.

    A score is the inner product of the vectors' floor(256 * x), an integer. Rows with a query's own id are no candidates for
    it. Vectors that are null, empty, or hold components that are null or no finite numbers, and rows with a null id,
    take no part; components may be of any size, and a score that a long does not hold is an error. Vectors of different sizes do not meet. Repeated rows are candidates, or queries, of their own.
    Other columns, whatever their names, are not read. Empty tables give an empty one. Queries go in blocks against
    shards of bounded size; neither side is held whole anywhere.
    """
    able = lambda df: df.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vector_col).alias("vector")).where(F.col("vec_id").isNotNull() & sound(F.col("vector"))).withColumn("size", F.size("vector"))
    rows, queries = able(rows), able(queries)
    away = lambda points, pivots: np.sqrt(np.maximum((points**2).sum(1)[:, None] + (pivots**2).sum(1) - 2 * points @ pivots.T, 0)) * (1 + 1e-9) + 1e-6 * (1 + np.abs(points).max(1, initial=0))[:, None]
    dealt, groups = deal(rows, "vec_id", lambda x: x, away, shard, "m-tree-rows")
    trees = packed(dealt.withColumnRenamed("block", "shard"), ["size", "group", "shard"], _tree)
    trees = written(trees, "m-trees")
    blocks = blocks_for(queries.count(), QUERIES)
    asked = written(packed(queries.withColumn("block", F.pmod(F.xxhash64("vec_id", F.lit(1)), F.lit(blocks)).cast("int")), ["size", "block"], _queries), "m-tree-queries")
    routed = written(asked.groupBy("size", "block").applyInPandas(_routed(groups, False), _ROUTED), "m-tree-visits")
    found = written(_visited(trees, routed, k, False), "m-tree-first")
    full = found.groupBy("size", "block", "query").agg(F.count("*").alias("n"), F.min("score").alias("floor")).where(F.col("n") >= k)
    floors = full.groupBy(F.col("size").cast("int").alias("size"), F.col("block").cast("int").alias("block")).agg(F.collect_list(F.struct("query", "floor")).alias("floors"))  # one for each query of a block
    again = asked.join(floors, ["size", "block"], "left").groupBy("size", "block").applyInPandas(_routed(groups, True), _ROUTED)
    more = _visited(trees, written(again, "m-tree-visits"), k, True)
    order = Window.partitionBy("size", "block", "query", "query_id").orderBy(F.col("score").desc(), "vec_id")
    best = found.unionByName(more).withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    return best.select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", F.when(F.col("score") > LEAST, F.col("score")).otherwise(F.raise_error(F.lit("a score is beyond a long"))).alias("score"))
