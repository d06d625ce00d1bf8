"""Snapshots of a table before it is changed, and going back to one."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Snapshots kept beside the first one.
KEPT = 3


def _files(spark: SparkSession, folder: str):
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    return path.getFileSystem(spark._jsc.hadoopConfiguration()), path


def numbers(spark: SparkSession, folder: str) -> list[int]:
    """The numbers of the snapshots in folder, oldest first."""
    fs, path = _files(spark, folder)
    if not fs.exists(path):
        return []
    names = [s.getPath().getName() for s in fs.listStatus(path)]
    return sorted(int(n.removeprefix("v")) for n in names if n.startswith("v") and fs.exists(spark._jvm.org.apache.hadoop.fs.Path(f"{folder}/{n}/_SUCCESS")))


def digest(df: DataFrame) -> tuple[int, str]:
    """(rows, a sum of hashes of the rows): the same for the same rows in any order."""
    told = [x for c in sorted(df.columns) for x in (F.col(c), F.col(c).isNull())]
    row = df.agg(F.count("*").alias("n"), F.sum(F.xxhash64(*told).cast("decimal(38,0)")).alias("s")).first()
    return row["n"], str(row["s"])


def take(df: DataFrame, folder: str, kept: int = KEPT) -> int | None:
    """Writes df as a new snapshot, unless it holds the rows of the last one; its number, or None.

    The first snapshot and the last `kept` stay; older ones are deleted. A write cut off leaves no snapshot.
    """
    spark = df.sparkSession
    have = numbers(spark, folder)
    if have and digest(spark.read.parquet(f"{folder}/v{have[-1]}")) == digest(df):
        return None
    number = have[-1] + 1 if have else 0
    df.write.mode("overwrite").parquet(f"{folder}/v{number}")
    fs, _ = _files(spark, folder)
    for old in [n for n in [*have, number][1:]][:-kept]:
        fs.delete(spark._jvm.org.apache.hadoop.fs.Path(f"{folder}/v{old}"), True)
    return number


def revert(spark: SparkSession, folder: str, to: str = "last") -> DataFrame:
    """The rows of the last snapshot, or of the first one (to='initial')."""
    have = numbers(spark, folder)
    if not have:
        raise ValueError(f"no snapshot in {folder}")
    return spark.read.parquet(f"{folder}/v{have[0] if to == 'initial' else have[-1]}")
