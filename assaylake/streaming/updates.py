"""Streaming forms of two batch operators: updating a sample table, and counting votes with their decisions."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from assaylake.operators import voting
from assaylake.sources.scratch import new_folder
from assaylake.streaming.pieces import Pieces


def _run(stream: DataFrame, each, folder: str, mode: str = "append") -> None:
    query = stream.writeStream.foreachBatch(each).outputMode(mode).option("checkpointLocation", f"{folder}/checkpoint").trigger(availableNow=True).start()
    query.awaitTermination()


def without_repeats(source: DataFrame, keep: str) -> DataFrame:
    """The stream without rows that are equal to one that came within `keep` before.

    The watermark stands on the time of arrival: it never calls a row late, so none is lost however old its file is, and the state holds the rows of the last `keep` only.
    """
    arrived = "arrived"
    while arrived in source.columns:
        arrived += "_"
    return source.withColumn(arrived, F.current_timestamp()).withWatermark(arrived, keep).dropDuplicatesWithinWatermark(source.columns).drop(arrived)


def upsert_batches(spark: SparkSession, source: DataFrame, order: str, folder: str | None = None, keep: str = "1 hour", fanout: int = 8) -> DataFrame:
    """Upserts a stream of (hash, label, columns...) into a table, one row for each hash: a known label goes before '?' and null, then the smallest `order`.

    Rows that repeat one of the last `keep` go first (see without_repeats()). Each micro-batch adds its best row for each hash to the table (see Pieces), which
    reads as the best row of all: the order of the files, late rows and batches run again do not change it, and nothing is kept in
    the driver. A stream started again with the same folder goes on where it stopped. An empty stream gives the table as it was; a null hash is a hash like any other.
    """
    folder = folder or new_folder(spark, "stream-upsert")
    columns = [c for c in source.columns if c != "hash"]
    unknown = F.coalesce(F.col("label") == "?", F.lit(True))

    def best(rows: DataFrame) -> DataFrame:
        return rows.groupBy("hash").agg(F.min_by(F.struct(*columns), F.struct(unknown, F.col(order), *(c for c in columns if c != order))).alias("r")).select("hash", *(F.col(f"r.{c}").alias(c) for c in columns))

    kinds = {f.name: f.dataType.simpleString() for f in source.schema.fields}
    table = Pieces(spark, f"{folder}/table", ", ".join(f"`{c}` {kinds[c]}" for c in ["hash", *columns]), best, fanout)
    _run(without_repeats(source, keep), table.add, folder)
    return table.read()


def windowed_votes(spark: SparkSession, source: DataFrame, time: str, width: str, rank: str, folder: str | None = None, delay: str | None = None, fanout: int = 8) -> tuple[DataFrame, DataFrame]:
    """((start, hash, label, n, first_rank), (start, hash, label, best)): votes of each hash in windows of event time, and what they decide.

    The stream counts in update mode: a micro-batch hands on the new counts of the windows, hashes and labels that it changed, they replace the older ones, and the hashes whose counts changed are decided
    again from all their counts (voting.decide_counts). first_rank is the least rank of a label's votes. Every event with a time counts, whatever the order of the files. delay: from that far behind the latest event on,
    windows are closed: their state goes, and events that come later still no longer count; without it the state grows with the windows. A stream started again with the
    same folder goes on where it stopped.
    """
    folder = folder or new_folder(spark, "stream-votes")
    kinds = {f.name: f.dataType.simpleString() for f in source.schema.fields}
    latest = lambda value: lambda rows: rows.groupBy("start", "hash", *(["label"] if value == "n" else [])).agg(F.max_by(F.struct("*"), value).alias("r")).select("r.*")
    counts = Pieces(spark, f"{folder}/counts", f"start timestamp, hash {kinds['hash']}, label {kinds['label']}, n long, first_rank {kinds[rank]}", latest("n"), fanout)  # counts only grow
    decisions = Pieces(spark, f"{folder}/decisions", f"start timestamp, hash {kinds['hash']}, label {kinds['label']}, best long, batch long", latest("batch"), fanout)

    def update(batch: DataFrame, number: int) -> None:
        changed = batch.select(F.col("window.start").alias("start"), "hash", "label", "n", "first_rank")
        counts.add(changed, number)
        touched = changed.select("start", "hash").distinct().withColumnsRenamed({"start": "s", "hash": "h"})
        mine = counts.read().join(touched, F.col("start").eqNullSafe(F.col("s")) & F.col("hash").eqNullSafe(F.col("h")), "left_semi")
        decisions.add(voting.decide_counts(mine, ["start", "hash"]).withColumn("batch", F.lit(number).cast("long")), number)

    timed = source.withWatermark(time, delay) if delay else source
    counted = timed.groupBy(F.window(time, width).alias("window"), "hash", "label").agg(F.count("*").alias("n"), F.min(rank).alias("first_rank"))
    _run(counted, update, folder, "update")
    return counts.read(), decisions.read().drop("batch")
