"""What the vector operators share: which vectors take part, how they are dealt into compact blocks, and blocks as single rows.

Rows go to the nearest of a few pivots and, where a pivot has many, to rings about it by their distance from it. A group, one ring of one
pivot, is described by its pivot and the least and greatest distance in it, so that whole groups can be ruled out by the triangle inequality.
Groups are cut into blocks of bounded size. Pivots grow with the table, up to PIVOTS, and where they are many their rings are fewer. The groups are few at any
table size: GROUPS at most, and one for each vector length without a pivot.
"""

from __future__ import annotations

import pickle
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from assaylake.llm.shared import blocks_for, written

#: Pivots, drawn from all rows by chance, rings about each, and groups in all: bounds of the sample and of the table of groups.
PIVOTS, RINGS, GROUPS = 512, 16, 1024
#: Components from which a row is dealt to no pivot: distances would be lost in rounding.
WILD = float(1 << 40)


def sound(vector: Column) -> Column:
    """True for a vector with at least one component, all of them finite numbers."""
    bad = lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))
    return F.coalesce((F.size(vector) > 0) & ~F.exists(vector, bad), F.lit(False))


def packed(rows: DataFrame, by: list[str], make: Callable[[pd.DataFrame], dict]) -> DataFrame:
    """One row (by..., blob) for each block: make's arrays, pickled. Blocks are bounded by the caller's numbering."""
    fields = ", ".join(f"{c} {rows.schema[c].dataType.simpleString()}" for c in by)

    def block(part: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame([[*part[by].iloc[0], pickle.dumps(make(part), 5)]], columns=[*by, "blob"])

    return rows.groupBy(*by).applyInPandas(block, f"{fields}, blob binary")


def matrix(column: pd.Series, kind: str) -> np.ndarray:
    return np.stack(column.to_numpy()).astype(kind)


class Groups:
    """The groups that rows are dealt to, by number: vector length, pivot (or None), least and greatest distance from it, blocks."""

    def __init__(self, pivots: dict[int, np.ndarray], table: pd.DataFrame):
        self.pivots, self.table = pivots, table.sort_values("group", ignore_index=True)

    def of(self, size: int) -> pd.DataFrame:
        return self.table[self.table["size"] == size]

    def centres(self, groups: pd.DataFrame, size: int) -> np.ndarray:
        """(groups, size): their pivots; zeros for a group without one."""
        pivots = self.pivots.get(size, np.zeros((0, size)))
        return np.vstack([pivots, np.zeros((1, size))])[groups["cell"].to_numpy()]  # cell -1 is the row of zeros


def deal(rows: DataFrame, key: str, prepare: Callable[[np.ndarray], np.ndarray], away: Callable[[np.ndarray, np.ndarray], np.ndarray], per: int, name: str) -> tuple[DataFrame, Groups]:
    """(rows with group and block, the groups) for rows with columns vector and size; a block holds about `per` rows at most.

    prepare turns a matrix of vectors into points, away gives the distances (points, pivots). Pivots are some of the rows; nothing but
    speed depends on which.
    """
    spark = rows.sparkSession
    n = rows.count()
    wanted = min(PIVOTS, blocks_for(n, per))
    drawn = rows.where(F.rand(5) < min(1.0, 2 * wanted / max(n, 1))).select("vector").collect() if wanted > 1 else []  # about 2 * PIVOTS vectors
    pivots: dict[int, list] = {}
    for r in drawn[:: max(1, len(drawn) // wanted)][:wanted]:
        point = prepare(np.array([r["vector"]], float))[0]
        if np.abs(point).max() < WILD:
            pivots.setdefault(len(point), []).append(point)
    most = max(1, min(RINGS, GROUPS // max(1, sum(map(len, pivots.values())))))
    fixed = {size: np.unique(np.stack(points), axis=0) for size, points in pivots.items()}
    sent = spark.sparkContext.broadcast(fixed)  # PIVOTS vectors at most

    def placed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            cell, far = np.full(len(batch), -1), np.zeros(len(batch))
            for size, points in sent.value.items():
                mine = np.flatnonzero(batch["size"] == size)
                if len(mine):
                    point = prepare(matrix(batch["vector"].iloc[mine], "f8"))
                    tame = np.abs(point).max(1) < WILD
                    to = away(point[tame], points)
                    cell[mine[tame]], far[mine[tame]] = to.argmin(1), to.min(1)
            yield batch.assign(cell=cell, away=far)

    fields = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in rows.schema.fields)
    if fixed:
        rows = rows.mapInPandas(placed, f"{fields}, cell int, away double")
    else:
        rows = rows.withColumns({"cell": F.lit(-1), "away": F.lit(0.0)})
    rows = written(rows, name)
    cuts = [i / RINGS for i in range(1, RINGS)]
    cells = rows.groupBy("size", "cell").agg(F.count("*").alias("n"), F.percentile_approx("away", cuts, 1000).alias("cuts")).toPandas()
    listed, base = [], 0
    for size, cell, count, found in cells[["size", "cell", "n", "cuts"]].itertuples(index=False):
        rings = min(most, blocks_for(int(count), per)) if cell >= 0 else 1
        bounds = sorted({float(found[i * RINGS // rings - 1]) for i in range(1, rings)})
        listed.append((int(size), int(cell), base, bounds))
        base += len(bounds) + 1
    where = spark.createDataFrame(listed, "g_size int, g_cell int, base int, bounds array<double>")
    ring = F.size(F.filter("bounds", lambda b: b <= F.col("away")))
    rows = rows.join(F.broadcast(where), (F.col("size") == F.col("g_size")) & (F.col("cell") == F.col("g_cell"))).withColumn("group", F.col("base") + ring).drop("g_size", "g_cell", "base", "bounds")
    table = rows.groupBy("group", "size", "cell").agg(F.count("*").alias("n"), F.min("away").alias("low"), F.max("away").alias("high")).toPandas()
    table["blocks"] = [blocks_for(int(x), per) for x in table["n"]]
    told = spark.createDataFrame(list(zip(table["group"].tolist(), table["blocks"].tolist(), strict=True)), "group int, blocks int")
    rows = rows.join(F.broadcast(told), "group").withColumn("block", F.pmod(F.xxhash64(key), "blocks").cast("int"))
    return rows.drop("cell", "away", "blocks"), Groups(fixed, table)
