"""Exact ranks inside groups of any size."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F


def bucketed_rank(df: DataFrame, keys: list[str], bucket: Column, order: list[Column], name: str = "rank") -> DataFrame:
    """1-based rank inside ``keys`` by ``order``, where ``bucket`` never decreases along that order.

    Rows are numbered inside their bucket only, and the sizes of the earlier buckets are added. One huge key thus
    spreads over its buckets instead of being sorted by a single task.
    """
    marked = df.withColumn("_bucket", bucket)
    sizes = marked.groupBy(*keys, "_bucket").agg(F.count(F.lit(1)).alias("_size"))
    earlier = W.partitionBy(*keys).orderBy("_bucket").rowsBetween(W.unboundedPreceding, -1)
    offsets = sizes.select(*keys, "_bucket", F.coalesce(F.sum("_size").over(earlier), F.lit(0)).alias("_offset"))
    inside = F.row_number().over(W.partitionBy(*keys, "_bucket").orderBy(*order))
    return marked.withColumn("_row", inside).join(offsets, [*keys, "_bucket"]).withColumn(
        name, F.col("_row") + F.col("_offset")).drop("_bucket", "_row", "_offset")


def newest_first(df: DataFrame, keys: list[str], key: str = "job_id", hours: int = 1) -> DataFrame:
    """``rank`` 1 for each key's newest row."""
    bucket = -F.floor(F.unix_seconds("created_at") / (hours * 3600))
    return bucketed_rank(df, keys, bucket, [F.col("created_at").desc(), F.col(key).desc()])
