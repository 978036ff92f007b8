"""Counts per report."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

COUNTERS = ["total", "confirmed", "suspected", "typo", "punctuation", "grammar", "paragraph"]


def counters() -> list:
    """The seven report counters over issue rows."""
    return [
        F.count(F.lit(1)).alias("total"),
        *[F.count_if(F.col("level") == name).alias(name) for name in COUNTERS[1:3]],
        *[F.count_if(F.col("category") == name).alias(name) for name in COUNTERS[3:]],
    ]


def summarize(issues: DataFrame, docs: DataFrame) -> DataFrame:
    """One row per document; a document without issues has zeros."""
    counts = issues.groupBy("doc_id").agg(*counters())
    return docs.select("doc_id").join(counts, "doc_id", "left").na.fill(0, COUNTERS)
