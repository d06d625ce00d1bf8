"""Joins and upserts between sample tables, by hash."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def contains(df: DataFrame, wanted: DataFrame) -> DataFrame:
    """Rows whose hash is in wanted."""
    return df.join(wanted.select("hash"), "hash", "left_semi")


def remove(df: DataFrame, query: str | None = None, unwanted: DataFrame | None = None) -> DataFrame:
    """Rows for which query does not hold (a null keeps the row) and whose hash is not in unwanted."""
    out = df if query is None else df.where(~F.coalesce(F.expr(query), F.lit(False)))
    return out if unwanted is None else out.join(unwanted.select("hash"), "hash", "left_anti")


def upsert(old: DataFrame, new: DataFrame, update: bool = False) -> DataFrame:
    """New hashes are inserted; a known one is replaced only where its label is null or update is set."""
    columns = [c for c in old.columns if c != "hash"]
    o = old.select("hash", F.struct(*columns).alias("o"))
    n = new.select("hash", F.struct(*columns).alias("n"))
    take = F.col("o").isNull() | (F.col("n").isNotNull() & (F.col("o.label").isNull() | F.lit(update)))
    return o.join(n, "hash", "full_outer").select("hash", F.when(take, F.col("n")).otherwise(F.col("o")).alias("r")).select("hash", *(F.col(f"r.{c}").alias(c) for c in columns))


def merge(*tables: DataFrame) -> DataFrame:
    """Union of sample tables: of rows with one hash the first table's stays, but one without a label yields to one with."""
    tagged = [t.withColumn("__source", F.lit(i)) for i, t in enumerate(tables)]
    union = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), tagged)
    order = Window.partitionBy("hash").orderBy(F.col("label").isNull(), "__source", *(c for c in union.columns if c not in ("hash", "__source", "label")))
    return union.withColumn("__n", F.row_number().over(order)).where("__n = 1").drop("__n", "__source")


def apply_labels(df: DataFrame, supplied: DataFrame, detected: DataFrame) -> DataFrame:
    """Label precedence: supplied, own unless '?', detected, '?'. Both tables: (hash, label), one row for each hash."""
    s, d = supplied.select("hash", F.col("label").alias("__s")), detected.select("hash", F.col("label").alias("__d"))
    label = F.coalesce("__s", F.nullif("label", F.lit("?")), F.nullif("__d", F.lit("?")), F.lit("?"))
    return df.join(s, "hash", "left").join(d, "hash", "left").withColumn("label", label).drop("__s", "__d")


def differing(a: DataFrame, b: DataFrame) -> DataFrame:
    """(only_left, only_right): rows, with their repeats, that one of two tables has more often; both 0 for equal tables."""
    left = a.exceptAll(b).agg(F.count("*").alias("only_left"))
    return left.join(b.exceptAll(a).agg(F.count("*").alias("only_right")))


def split(df: DataFrame, query: str) -> tuple[DataFrame, DataFrame]:
    """(rows for which query holds, all others)."""
    holds = F.coalesce(F.expr(query), F.lit(False))
    return df.where(holds), df.where(~holds)


def section_lists(sections: DataFrame, standard: list[str], packer: list[str]) -> DataFrame:
    """(hash, n_standard, n_packer, n_unknown): section names in either list, and in neither."""
    known = sections.sparkSession.createDataFrame([(n, True, False) for n in standard] + [(n, False, True) for n in packer], "name string, standard boolean, packer boolean")
    joined = sections.join(F.broadcast(known), "name", "left")  # the lists are parameters
    return joined.groupBy("hash").agg(F.count_if("standard").alias("n_standard"), F.count_if("packer").alias("n_packer"), F.count_if(F.col("standard").isNull()).alias("n_unknown"))


def api_lists(df: DataFrame, used: str, lists: dict[str, list[str]]) -> DataFrame:
    """(hash, n_<list>..., unknown): how many of a sample's distinct names each list holds, and those that none does."""
    names = F.array_distinct(F.coalesce(F.col(used), F.array().cast("array<string>")))
    known = F.array(*map(F.lit, sorted({n for v in lists.values() for n in v}))).cast("array<string>")
    counts = [F.size(F.array_intersect(names, F.array(*map(F.lit, v)).cast("array<string>"))).cast("long").alias(f"n_{k}") for k, v in lists.items()]
    return df.select("hash", *counts, F.array_join(F.array_sort(F.array_except(names, known)), ",").alias("unknown"))


def diff_from(df: DataFrame, reference: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """Per key, the difference of each column from the reference's."""
    ref = reference.select(key, *(F.col(c).alias(f"__{c}") for c in columns))
    return df.join(ref, key).select(key, *(F.round(F.col(c) - F.col(f"__{c}"), 6).alias(c) for c in columns))


def grid(spark, **values: list) -> DataFrame:
    """Every combination of the parameters' values."""
    out = spark.range(1)
    for name, items in values.items():
        out = out.select("*", F.explode(F.array(*map(F.lit, items))).alias(name))
    return out.drop("id")


def overlaps(blocks: DataFrame) -> DataFrame:
    """Neighbours in address order of which the first reaches into the second."""
    w = Window.partitionBy("hash").orderBy("addr", "size")
    pair = blocks.select("hash", "addr", "size", F.lead("addr").over(w).alias("next_addr"), F.lead("size").over(w).alias("next_size"))
    return pair.where("next_addr < addr + size")
