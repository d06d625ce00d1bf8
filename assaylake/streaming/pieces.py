"""A table that micro-batches add to: one piece for each batch, and larger pieces merged from FANOUT smaller ones."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

FANOUT = 8


class Pieces:
    """Pieces of a table in a folder, named by the first and the last batch that they hold.

    Batch n is written as a piece of its own; where n + 1 is a multiple of FANOUT, of its square and so on, the last pieces become one of that many batches. So
    each row is written again once for each power of FANOUT, and a reader meets at most FANOUT - 1 pieces of each width, whatever the number of
    batches. A piece counts once Spark's writer has marked it as whole: a batch run again writes its piece anew, and a job that dies leaves nothing that is read. Pieces that a larger one
    holds are removed FANOUT batches later, when no reader that began before can need them.

    merge takes rows of any pieces to rows of one; merging merged rows again must not change them.
    """

    def __init__(self, spark: SparkSession, folder: str, schema: str, merge: Callable[[DataFrame], DataFrame], fanout: int = FANOUT):
        self.spark, self.folder, self.schema, self.merge, self.fanout = spark, folder.rstrip("/"), schema, merge, fanout

    def _path(self, name: str):
        path = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.folder}/{name}")
        return path, path.getFileSystem(self.spark._jsc.hadoopConfiguration())

    def names(self) -> list[tuple[int, int]]:
        """(first, last batch) of the pieces that are whole."""
        pattern, files = self._path("*/_SUCCESS")
        found = [status.getPath().getParent().getName() for status in files.globStatus(pattern) or []]
        return sorted(tuple(map(int, name.split("-"))) for name in found)

    def cover(self, first: int | None = None, last: int | None = None, widest: int | None = None) -> list[tuple[int, int]]:
        """The fewest pieces that hold all batches (from first to last, no piece of widest batches or more)."""
        out: list[tuple[int, int]] = []
        for low, high in sorted(self.names(), key=lambda p: (p[0], -p[1])):
            inside = (first is None or low >= first) and (last is None or high <= last) and (widest is None or high - low + 1 < widest)
            if inside and (not out or low > out[-1][1]):
                out.append((low, high))
        return out

    def _rows(self, pieces: list[tuple[int, int]]) -> DataFrame:
        if not pieces:
            return self.spark.createDataFrame([], self.schema)
        return self.spark.read.schema(self.schema).parquet(*(f"{self.folder}/{low}-{high}" for low, high in pieces))

    def read(self) -> DataFrame:
        return self.merge(self._rows(self.cover()))

    def add(self, rows: DataFrame, number: int) -> None:
        """Writes the rows of a batch, and the larger pieces that it fills."""
        self.merge(rows).write.mode("overwrite").parquet(f"{self.folder}/{number}-{number}")
        width = self.fanout
        while (number + 1) % width == 0:
            low = number + 1 - width
            self.merge(self._rows(self.cover(low, number, width))).write.mode("overwrite").parquet(f"{self.folder}/{low}-{number}")
            width *= self.fanout
        whole = self.names()
        for low, high in whole:
            if any(a <= low and high <= b and (a, b) != (low, high) and b <= number - self.fanout for a, b in whole):
                path, files = self._path(f"{low}-{high}")
                files.delete(path, True)
