"""From raw documents to packed training sequences: five stages, each written and read again before the next one.

Every stage takes rows with null columns, empty and very long texts, ties and repeated rows, tables without rows, and
columns of any name beside those of ``documents``; all but the last return the rows they keep with all their columns. Rows
without an id take part: the classifier and the mixture keep them, of equal or linked texts the row with the smallest id
stays, and one without an id only if none of them has one. An empty table gives empty results.
"""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from proofspark.llm import exact, jaccard, mixing, packing, quality
from proofspark.llm.common import read
from proofspark.session import forget_written, scratch_dir

#: The classifier learns from labels on held-in rows and has no SQL; tests compare the stages with brute force.
ORACLE_SQL = None


def stage(work: Callable[[SparkSession, DataFrame, str], DataFrame]) -> Callable[[SparkSession, DataFrame, str], DataFrame]:
    """A stage begins when the result of the one before is stored, so it first deletes the tables which that one needed."""

    def run(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        forget_written(spark)
        return work(spark, docs, sf_dir)

    run.__name__, run.__doc__ = work.__name__, work.__doc__
    return run


@stage
def good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier accepts."""
    return quality.accepted(docs, read(spark, sf_dir, "labels"))


@stage
def unique(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of equal texts."""
    return exact.without_copies(docs)


@stage
def distinct(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of linked texts."""
    return jaccard.without_near_copies(docs)


@stage
def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents in the order of the mixture, kept by the order of files and of the rows in them."""
    return mixing.mixed(docs)


@stage
def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the stream of all documents, in the order in which they are stored."""
    tokens = packing.stored_token_table(docs, public_tokenizers.path("byte_bpe_50k.json"))
    return packing.pieces(tokens, keep=False).drop("ids")


STAGES = [("quality", good), ("exact", unique), ("near", distinct), ("mix", mixed), ("pack", packed)]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the table documents."""
    docs = read(spark, sf_dir, "documents")
    for name, stage in STAGES:
        path = scratch_dir(spark, f"pipeline-{name}")
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
