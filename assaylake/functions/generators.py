"""Generators as table functions for SQL: rows of a table argument in, several rows out of each."""

from __future__ import annotations

from collections import deque
from collections.abc import Iterator

from pyspark.sql import Row, SparkSession
from pyspark.sql.functions import udtf


@udtf(returnType="doc_id long, place int, fragment string")
class Fragments:
    """fragments(TABLE(t), n, size, header): n slices of size bytes of content after the header, as hex; t has doc_id and content.

    A slice beyond the content is empty, a null content has none: as content.fragments(), one row for each slice.
    """

    def eval(self, row: Row, n: int, size: int, header: int) -> Iterator[tuple]:
        data = row["content"]
        for place in range(n if data is not None else 0):
            at = header + place * size
            yield row["doc_id"], place, bytes(data[at : at + size]).hex().upper()


@udtf(returnType="hash long, gram string")
class TokenGrams:
    """token_grams(TABLE(t) PARTITION BY hash ORDER BY (...), n): the runs of n tokens of each hash, in that order; t has hash and token.

    Only the last n tokens are held. A null token stands for itself as an empty text.
    """

    def __init__(self):
        self.last: deque = deque()

    def eval(self, row: Row, n: int) -> Iterator[tuple]:
        self.last.append(row["token"] or "")
        if len(self.last) > n:
            self.last.popleft()
        if len(self.last) == n:
            yield row["hash"], " ".join(self.last)


def register(spark: SparkSession) -> None:
    """Makes the generators callable from the session's SQL, as fragments and token_grams."""
    spark.udtf.register("fragments", Fragments)
    spark.udtf.register("token_grams", TokenGrams)
