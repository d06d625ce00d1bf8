"""Embedding near-dedup by randomised-rotation binary codes.

Each vector, at length one and turned by a random rotation, is coded by the signs of its components; the code and its
correction factor a = <code, vector> are kept. For another vector q with b = <code, q>, b / a estimates <vector, q>
without bias, and <vector, q> lies within a * b +- sqrt(1 - a^2) * sqrt(1 - b^2) with certainty, since what the code
leaves of either vector has that length. Pairs whose upper bound is below the threshold are done with, those whose lower bound is
above it are links, and only those between are recomputed exactly, so no link is lost.

Equal vectors are one class first. Classes are dealt to rings about pivots by their angle (vectors.deal) and rings cut into blocks of bounded size.
Two rings meet only where the angles between their pivots and in them leave room for a link; their blocks then meet pair by pair, and a
pair of blocks gives link counts and a spanning forest of its links, never all pairs.
"""

from __future__ import annotations

import math
import pickle

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from assaylake.llm.components import connected_components
from assaylake.llm.shared import written
from assaylake.llm.simhash import spanning
from assaylake.llm.vectors import Groups, deal, matrix, packed, sound

#: Vectors in a block; partners of a block that share one sending of it; seed of the rotation; float32 rounding that the bounds allow for, and float64 rounding of angles.
BLOCK, TOGETHER, SEED, SLACK, ANGLE = 4096, 16, 4, 1e-4, 1e-6


def unit(vectors: np.ndarray) -> np.ndarray:
    """Vectors at length one, in double precision. Components are first scaled by a power of two, which is exact, so that squares of very large or small ones stay finite."""
    vectors = np.ldexp(vectors, -np.frexp(np.abs(vectors).max(1))[1][:, None])
    return vectors / np.sqrt(np.einsum("ij,ij->i", vectors, vectors))[:, None]


def rotation(size: int, seed: int = SEED) -> np.ndarray:
    """A random orthogonal matrix, the same for a size and seed."""
    q, r = np.linalg.qr(np.random.default_rng(seed).standard_normal((size, size)))
    return q * np.sign(np.diag(r))


def coded(unit: np.ndarray, turn: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(packed sign bits, correction factors, turned vectors as float32) of vectors of length one."""
    turned = unit @ turn.T
    bits = turned >= 0
    factor = np.abs(turned).sum(1) / math.sqrt(unit.shape[1])
    return np.packbits(bits, axis=1), factor, turned.astype(np.float32)


def estimate(bits: np.ndarray, factor: np.ndarray, turned: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(estimate, lower, upper) of the inner products of coded vectors with turned ones, all at length one."""
    size = turned.shape[1]
    code = (np.unpackbits(bits, axis=1, count=size).astype(np.float32) * 2 - 1) / np.float32(math.sqrt(size))
    b = np.clip(code.astype(np.float64) @ turned.T.astype(np.float64), -1, 1)
    a = np.clip(factor, 0, 1)[:, None]
    spread = np.sqrt(1 - a**2) * np.sqrt(1 - b**2)
    return b / a, a * b - spread, a * b + spread


def undecided(b: np.ndarray, factor: np.ndarray, threshold: float) -> tuple[np.ndarray, np.ndarray]:
    """(links for certain, pairs to recompute) of pairs with b = <code, q> and the code's correction factor; see estimate()."""
    a, b = np.clip(factor, 0, 1).astype(np.float64), np.clip(b.astype(np.float64), -1, 1)
    spread = np.sqrt(1 - a**2) * np.sqrt(1 - b**2) + SLACK
    sure = a * b - spread >= threshold
    return sure, ~sure & (a * b + spread >= threshold)


def near_pairs(one: dict, two: dict, threshold: float, same: bool, rows: int = 256, tally: dict | None = None):
    """Parts (i, j) of the pairs with cosine >= threshold, i in block one, j in block two; same: one is two and i < j.

    tally, where given, counts pairs and those recomputed exactly.
    """
    size = one["vector"].shape[1]
    code = (np.unpackbits(one["bits"], axis=1, count=size).astype(np.float32) * 2 - 1) / np.float32(math.sqrt(size))
    # The upper bound reaches the threshold exactly where the angle of (code, q) is at most that of (code, vector) plus that of the threshold:
    # one comparison for each pair, and only what passes it is looked at more closely.
    angle = np.arccos(np.clip(one["factor"], -1, 1)) + math.acos(threshold)
    least = (np.where(angle >= math.pi, -2.0, np.cos(np.minimum(angle, math.pi))) - SLACK).astype(np.float32)
    turned = np.ascontiguousarray(two["turned"].T)
    for start in range(0, len(code), rows):
        inner = code[start : start + rows] @ turned
        reach = np.flatnonzero((inner >= least[start : start + rows, None]).ravel())
        for part in range(0, len(reach), 200_000):
            some = reach[part : part + 200_000]
            i, j = np.divmod(some, turned.shape[1])
            b, i = inner.ravel()[some], i + start
            if same:
                b, i, j = b[i < j], i[i < j], j[i < j]
            near, open_ = undecided(b, one["factor"][i], threshold)
            again = np.flatnonzero(open_)
            near[again] = cosine(one, i[again], two, j[again]) >= threshold
            if tally is not None:
                tally["pairs"] = tally.get("pairs", 0) + (len(one["cid"]) * (len(one["cid"]) - 1) // 2 if same else len(one["cid"]) * len(two["cid"])) * (start == part == 0)
                tally["exact"] = tally.get("exact", 0) + len(again)
            if near.any():
                yield i[near], j[near]


def cosine(one: dict, i: np.ndarray, two: dict, j: np.ndarray) -> np.ndarray:
    """Cosines in double precision of pairs of vectors, scaled as in unit()."""
    a, b = one["vector"][i].astype(np.float64), two["vector"][j].astype(np.float64)
    return np.einsum("ij,ij->i", a, b) / (one["norm"][i] * two["norm"][j])


def _block(part: pd.DataFrame) -> dict:
    given = matrix(part["vector"], "f8")
    vector = np.ldexp(given, -np.frexp(np.abs(given).max(1))[1][:, None])
    if part["vector"].iloc[0].dtype == np.float32:
        vector = vector.astype(np.float32)  # exact, as the scale is a power of two
    norm = np.sqrt(np.einsum("ij,ij->i", vector.astype(np.float64), vector.astype(np.float64)))
    bits, factor, _ = coded(vector.astype(np.float64) / norm[:, None], rotation(vector.shape[1]))
    return {"cid": part["cid"].to_numpy("i8"), "n": part["n"].to_numpy("i8"), "vector": vector, "norm": norm, "bits": bits, "factor": factor}


def _opened(blob: bytes, turn: np.ndarray | None = None) -> tuple[dict, np.ndarray]:
    """(a block with its turned vectors, the rotation): they are not sent, as turning a block costs little beside a meeting of two."""
    block = pickle.loads(blob)
    turn = rotation(block["vector"].shape[1]) if turn is None else turn
    return block | {"turned": ((block["vector"].astype(np.float64) / block["norm"][:, None]) @ turn.T).astype(np.float32)}, turn


def _meet(threshold: float):
    """Of a unit, one block and its partners: link counts and a spanning forest of the links of each pair of blocks."""

    def meet(unit: pd.DataFrame) -> pd.DataFrame:
        none = pd.DataFrame({"count": [], "a": [], "b": []}, dtype="int64")
        own = unit["q"].isna()
        if not own.any():  # a block's number may name no rows
            return none
        one, turn = _opened(unit["blob"][own].iloc[0])
        out = [none]
        if unit["alone"].any():
            out.append(_links(one, one, threshold))
        for blob in unit["blob"][~own]:
            out.append(_links(one, _opened(blob, turn)[0], threshold))
        return pd.concat(out, ignore_index=True)

    return meet


def _links(one: dict, two: dict, threshold: float) -> pd.DataFrame:
    same = one is two
    first, second = len(one["cid"]), 0 if same else len(two["cid"])
    count, label = np.zeros(first + second, np.int64), np.arange(first + second)
    for i, j in near_pairs(one, two, threshold, same):
        np.add.at(count, i, two["n"][j])
        other = j if same else j + first
        np.add.at(count, other, one["n"][i])
        spanning(i, other, label)
    cid = one["cid"] if same else np.concatenate([one["cid"], two["cid"]])
    counted, joined = np.flatnonzero(count), np.flatnonzero(label != np.arange(len(label)))
    return pd.DataFrame({"count": np.r_[count[counted], np.zeros(len(joined), np.int64)], "a": np.r_[cid[counted], cid[joined]], "b": np.r_[cid[counted], cid[label[joined]]]})


def meeting(groups: Groups, threshold: float) -> list[tuple[int, int, int, int]]:
    """(group, its blocks, another or the same group, its blocks) of the groups that may hold a link, each pair once.

    By the triangle inequality on angles: with pivots at an angle t, and angles of at most s and at least r to the pivots, the angle between members
    is at least t - s1 - s2, r1 - (t + s2) and r2 - (t + s1). There are GROUPS at most, and some for vector lengths without pivots.
    """
    out, most = [], math.acos(threshold) + ANGLE
    for size in sorted(set(groups.table["size"])):
        found = groups.of(size)
        points, low, high = groups.centres(found, size), found["low"].to_numpy(), found["high"].to_numpy()
        between = np.arccos(np.clip(points @ points.T, -1, 1))
        least = np.maximum(np.maximum(between - high[:, None] - high, low[:, None] - between - high), low - between - high[:, None])
        alone = (found["cell"] < 0).to_numpy()
        near = (least <= most) | alone[:, None] | alone
        name, blocks = found["group"].tolist(), found["blocks"].tolist()
        out += [(name[i], blocks[i], name[j], blocks[j]) for i, j in np.argwhere(np.triu(near)).tolist()]
    return out


def near_duplicates(rows: DataFrame, threshold: float = 0.95, id_col: str = "vec_id", vector_col: str = "embedding", block: int = BLOCK) -> DataFrame:
    """(vec_id, n_links, component_id, kept) for each row: links join vectors with cosine >= threshold (over 0), in double precision.

    n_links: other rows linked directly; component_id: the smallest vec_id reachable, the row's own included; kept: vec_id
    is component_id. Vectors that are null, empty, of length zero, or hold null or non-finite components link with nothing (own
    component); so do rows with a null vec_id (component null, kept false). Vectors of different sizes never link. Repeated
    rows link with each other, and rows that share a vec_id have each their own links. Other columns, whatever their names, are not read. An empty table gives an empty one.
    """
    if not 0 < threshold <= 1:
        raise ValueError("threshold must be over 0 and at most 1")
    spark = rows.sparkSession
    named = rows.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vector_col).alias("vector"))
    able = F.col("vec_id").isNotNull() & sound(F.col("vector")) & F.exists("vector", lambda x: x != 0)
    classes = named.where(able).groupBy("vector").agg(F.min("vec_id").alias("rep"), F.count("*").alias("n"))
    classes = written(classes.withColumns({"size": F.size("vector"), "cid": F.monotonically_increasing_id()}), "vector-classes")
    away = lambda points, pivots: np.arccos(np.clip(points @ pivots.T, -1, 1))
    dealt, groups = deal(classes.drop("rep"), "cid", unit, away, block, "vector-groups")
    blobs = written(packed(dealt, ["group", "block"], _block), "vector-blocks")
    up = lambda n: F.sequence(F.lit(0), F.col(n) - 1)
    pairs = spark.createDataFrame(meeting(groups, threshold), "g int, ps int, h int, qs int").select("g", "h", F.explode(up("ps")).alias("p"), "qs").select("g", "h", "p", F.explode(up("qs")).alias("q")).where("g <> h or p <= q")
    # A block is sent once for TOGETHER of its partners, and each of those to it; which of two blocks is the partner is told by a hash, so that no block has them all.
    turned = F.xxhash64("g", "p", "h", "q") % 2 == 0
    swapped = lambda x, y: F.when(turned, F.col(y)).otherwise(F.col(x)).alias(x)
    pairs = pairs.select(swapped("g", "h"), swapped("p", "q"), swapped("h", "g"), swapped("q", "p"))
    number = F.row_number().over(Window.partitionBy("g", "p").orderBy("h", "q")) - 1  # of blocks, not of rows
    pairs = written(pairs.withColumn("part", F.floor(number / TOGETHER)), "vector-pairs")
    mine, others = blobs.withColumnsRenamed({"group": "g", "block": "p"}), blobs.withColumnsRenamed({"group": "h", "block": "q"})
    itself = (F.col("g") == F.col("h")) & (F.col("p") == F.col("q"))
    units = pairs.groupBy("g", "p", "part").agg(F.bool_or(itself).alias("alone"))
    own = units.join(mine, ["g", "p"]).select("g", "p", "part", "alone", F.lit(None).cast("int").alias("q"), "blob")
    met = pairs.where(~itself).join(others, ["h", "q"]).select("g", "p", "part", F.lit(False).alias("alone"), "q", "blob")
    found = written(own.unionByName(met).groupBy("g", "p", "part").applyInPandas(_meet(threshold), "count long, a long, b long"), "vector-links")
    linked = found.where("count > 0").groupBy(F.col("a").alias("cid")).agg(F.sum("count").alias("links"))
    tied = connected_components(found.where("count = 0").select("a", "b")).withColumnRenamed("node", "cid")
    known = classes.join(linked, "cid", "left").join(tied, "cid", "left").withColumn("component", F.coalesce("component", "cid"))
    lowest = known.groupBy("component").agg(F.min("rep").alias("component_id"))
    known = known.join(lowest, "component").select("vector", (F.col("n") - 1 + F.coalesce("links", F.lit(0))).alias("n_links"), "component_id")
    joined = named.where(able).join(known, "vector").select("vec_id", "n_links", "component_id")
    alone = named.where(~able).select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    return joined.unionByName(alone).withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(False)))
