"""Folders that driver and executors share, for checkpoints and tables between steps."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession


#: Spark's setting that removes a query's shuffle files at its end.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def shared_dir(spark: SparkSession) -> str:
    """spark.checkpoint.dir; where it is unset, a new temporary folder in local mode, and an error on a cluster, whose machines share none."""
    context = spark.sparkContext
    set_ = context.getConf().get("spark.checkpoint.dir")
    if context.getCheckpointDir() is None:
        if not set_ and not context.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that the driver and the executors share")
        context.setCheckpointDir(set_ or _temporary())
    return set_ or context.getCheckpointDir()


def _temporary() -> str:
    folder = tempfile.mkdtemp(prefix="spark-")
    atexit.register(shutil.rmtree, folder, True)
    return folder


def new_folder(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


def cut(df: DataFrame) -> DataFrame:
    """Computes df once and cuts its lineage by a reliable checkpoint."""
    shared_dir(df.sparkSession)
    return df.checkpoint()


@contextmanager
def tidy(spark: SparkSession) -> Iterator[None]:
    """Within it, a query's shuffle files go when the query has ended; what it has written is all that is left of it."""
    before = spark.conf.get(CLEANUP)
    spark.conf.set(CLEANUP, "true")
    try:
        yield
    finally:
        spark.conf.set(CLEANUP, before)


def written(df: DataFrame, name: str) -> DataFrame:
    """df as a table in the shared folder: computed once, read back by column, safe from lost executors."""
    return written_at(df, new_folder(df.sparkSession, name))


def written_at(df: DataFrame, path: str, *by: str) -> DataFrame:
    """df as a table at path, with a folder for each value of the columns `by`."""
    with tidy(df.sparkSession):
        df.write.partitionBy(*by).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def remove(spark: SparkSession, path: str) -> None:
    """Removes a folder by the store's own client; nothing read later may rest on it."""
    place = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(place, True)


@contextmanager
def passing(df: DataFrame, name: str) -> Iterator[DataFrame]:
    """As written(), for the time of the block: the files go at its end, so what outlives it must be written itself."""
    path = new_folder(df.sparkSession, name)
    try:
        yield written_at(df, path)
    finally:
        remove(df.sparkSession, path)
