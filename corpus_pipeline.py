"""The corpus pipeline: toxic documents go, one document of each group of near copies stays, sources are mixed to their weights, and what is left is encoded.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; all but the last return the columns of documents.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from assaylake.llm import bpe, mixing, simhash, toxicity
from assaylake.llm.shared import written
from assaylake.sources.shipping import ship

#: The rows depend on trained weights and hashes that DuckDB does not have.
ORACLE_SQL = None


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """docs without those that the classifier, taught by the labels, rejects at their language's threshold.

    Null and empty texts are scored as empty; null ids and repeated rows are rows like any other; a long text is scored whole; other columns stay as they
    are; no rows give no rows.
    """
    ship(spark)
    return toxicity.without_toxic(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of near copies, that with the smallest id; rows with a null id come last, and equal ids are told apart by a hash of the row.

    Null and empty texts are one group; of rows equal in all columns one stays; other columns stay as they are; no rows give no rows.
    """
    ship(spark)
    return simhash.keep_first(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents mixed to the sources' targets: those taken twice are there twice, those taken in part are cut to the words taken.

    Null and empty texts hold no words and go; a null source is a source of its own; null ids and repeated rows are rows like any other; no rows give no rows.
    """
    return mixing.mixed_documents(docs)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256) of each row; a null text is empty, null ids and repeated rows are rows like any other, no rows give no rows."""
    ship(spark)
    return bpe.round_trip(docs, public_tokenizers.path("byte_bpe_50k.json"))


STAGES = [("toxicity", drop_toxic), ("simhash near-dedup", drop_near_copies), ("mix sources", mix_sources), ("bpe", encode)]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents, each stage's rows written and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES:
        docs = written(stage(spark, docs, sf_dir), "stage")
    return docs
