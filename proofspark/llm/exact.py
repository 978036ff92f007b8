"""Exact duplicates by progressive refinement: length, then prefix hash, then full hash of what is left."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from proofspark.llm.common import maybe_in, whole
from proofspark.session import written

PREFIX = 256


def normalized(text: Column) -> Column:
    """Runs of ASCII white space as one space; null as the empty text."""
    return F.regexp_replace(F.coalesce(text, F.lit("")), r"[\x20\x09-\x0D]+", " ")


def _repeated(df: DataFrame, keys: list[str]) -> DataFrame:
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n")).where("_n > 1").drop("_n")


def copy_groups(docs: DataFrame) -> DataFrame:
    """(length, prefix, full, keep_id, group_size) of every group of two or more equal normalised texts.

    Lengths that occur once leave after the first step, prefixes that occur once after the second. Only texts whose
    length and prefix came through are hashed whole: a bitmap of bounded size tells them apart during the scan, so no
    text is shuffled. keep_id is the smallest doc_id of the group, null ids last.
    """
    text = normalized(F.col("text"))
    seen = written(docs.select(F.length(text).alias("length"), F.xxhash64(F.substring(text, 1, PREFIX)).alias("prefix"))
                   .groupBy("length", "prefix").agg(F.count(F.lit(1)).alias("rows")), "exact-prefixes")
    lengths = seen.groupBy("length").agg(F.sum("rows").alias("n")).where("n > 1").select("length")
    left = seen.where("rows > 1").join(lengths, "length", "left_semi")
    rows = docs.select("doc_id", text.alias("text")).withColumn("length", F.length("text")).withColumn("prefix", F.xxhash64(F.substring("text", 1, PREFIX)))
    hashed = maybe_in(rows, F.xxhash64("length", "prefix"), left.select(F.xxhash64("length", "prefix").alias("h"))).where("_maybe")
    full = hashed.select("doc_id", "length", "prefix", F.unhex(F.sha2("text", 256)).alias("full"))
    return (full.groupBy("length", "prefix", "full").agg(F.min("doc_id").alias("keep_id"), F.count(F.lit(1)).alias("group_size"))
            .where("group_size > 1"))


def exact_duplicates(docs: DataFrame) -> DataFrame:
    """(doc_id, keep_id, group_size, kept, full) of every row; full is the SHA-256 of the normalised text.

    One row of each group is kept: that with the smallest doc_id, one of them if rows repeat the id. A null text equals
    the empty one. Rows without an id are kept only if their whole group has none. Other columns are ignored.
    """
    groups = written(copy_groups(docs), "exact-groups").select("full", "keep_id", "group_size")
    rows = docs.select("doc_id", F.unhex(F.sha2(normalized(F.col("text")), 256)).alias("full"))
    # dealt out by both keys before the window, so that the join may split a large group
    joined = rows.join(groups, "full", "left").repartition("full", "doc_id")
    size = F.coalesce("group_size", F.lit(1).cast("bigint"))
    keep = F.when(F.col("group_size").isNull(), F.col("doc_id")).otherwise(F.col("keep_id"))
    # rows that repeat an id and a text: count them apart, the groups themselves may be large
    turn = F.row_number().over(W.partitionBy("full", "doc_id").orderBy(F.lit(1)))
    first = joined.withColumn("_turn", turn).withColumn("_keep", keep)
    return first.select("doc_id", F.col("_keep").alias("keep_id"), size.alias("group_size"),
                        (F.col("doc_id").eqNullSafe(F.col("_keep")) & (F.col("_turn") == 1)).alias("kept"), "full")


def without_copies(docs: DataFrame) -> DataFrame:
    """Rows of ``docs``, all their columns, without those that ``exact_duplicates`` drops.

    Texts outside every group pass straight through; only rows whose length and prefix may be in a group meet the
    groups in a join.
    """
    groups = written(copy_groups(docs), "exact-groups")
    text = normalized(F.col("_row.text"))
    rows = docs.select(whole(docs)).withColumn("_length", F.length(text)).withColumn("_prefix", F.xxhash64(F.substring(text, 1, PREFIX)))
    marked = maybe_in(rows, F.xxhash64("_length", "_prefix"), groups.select(F.xxhash64("length", "prefix").alias("h")))
    hashed = marked.where("_maybe").select("_row", F.col("_row.doc_id").alias("_id"), F.unhex(F.sha2(text, 256)).alias("_full"))
    kept = groups.select(F.col("full").alias("_full"), F.col("keep_id").alias("_keep"), F.lit(True).alias("_grouped"))
    turn = F.row_number().over(W.partitionBy("_id", "_full").orderBy("_row.text"))
    met = hashed.join(kept, "_full", "left").where("_grouped is null or _id <=> _keep").repartition("_id", "_full").withColumn("_turn", turn)
    stay = met.where("_grouped is null or _turn = 1").select("_row")
    return marked.where("not _maybe").select("_row").union(stay).select("_row.*")
