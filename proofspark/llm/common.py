"""Helpers that the training-data operators share."""

from __future__ import annotations

import ctypes

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window as W, functions as F

from proofspark.session import written

#: Bits in one block of Spark's bitmap functions, and the most bits a filter may have: 8 MB when broadcast.
BLOCK_BITS, MOST_BITS = 32768, 1 << 26


def fold(doc_id: Column, n: int) -> Column:
    """crc32 of the id as text modulo n; null for a null id."""
    return F.crc32(doc_id.cast("string")) % n


def read(spark, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def whole(docs: DataFrame, columns: list[str] | None = None) -> Column:
    """All columns in one named ``_row``, so that helper columns never meet their names."""
    return F.struct(*[F.col(f"`{c}`").alias(c) for c in (columns or docs.columns)]).alias("_row")


def release_memory() -> None:
    """Give what this Python worker has freed back to the system: workers live on between tasks, beside the executor's heap."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):
        pass  # a C library without it


def maybe_in(df: DataFrame, key: Column, keys: DataFrame) -> DataFrame:
    """``df`` with boolean ``_maybe``: true for every row whose 64-bit ``key`` is in the only column of ``keys``.

    The keys become a bitmap of 64 bits a key, at most ``MOST_BITS``, so the broadcast is bounded whatever the input;
    a full bitmap lets more rows through, never fewer. An exact join follows wherever that matters.
    """
    name = keys.columns[0]
    bits = max(BLOCK_BITS, min(MOST_BITS, 1 << (64 * keys.count()).bit_length()))
    slots = keys.select((F.pmod(F.col(name), F.lit(bits)) + 1).alias("s"))
    blocks = slots.groupBy(F.bitmap_bucket_number("s").alias("_block")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("s")).alias("_bits"))
    marked = df.withColumn("_slot", F.pmod(key, F.lit(bits))).withColumn("_block", F.floor(F.col("_slot") / BLOCK_BITS) + 1)
    byte = F.expr(f"cast(conv(hex(substring(_bits, cast(_slot % {BLOCK_BITS} div 8 as int) + 1, 1)), 16, 10) as int)")
    bit = F.call_function("shiftright", byte, F.expr("cast(_slot % 8 as int)")).bitwiseAND(F.lit(1)) == 1
    joined = marked.join(F.broadcast(blocks), "_block", "left")
    return joined.withColumn("_maybe", F.coalesce(bit, F.lit(False))).drop("_slot", "_block", "_bits")


def components(edges: DataFrame, name: str) -> DataFrame:
    """(node, root) of every node of the links (a, b): root is the smallest node reachable.

    Large-star and small-star steps in turn; each step is written, so lineage stays short and no link reaches the driver.
    """
    a, b = F.col("a"), F.col("b")
    known = written(edges.where(a != b).select(F.greatest(a, b).alias("a"), F.least(a, b).alias("b")).distinct(), name)
    mark = None
    while True:
        both = known.union(known.select("b", "a"))
        low = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = both.join(low, "a").where(b > a).select(b.alias("a"), F.col("m").alias("b")).distinct()
        low = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(low, "a").select(F.when(b == F.col("m"), a).otherwise(b).alias("a"), F.col("m").alias("b"))
        known = written(small.union(large.join(low, "a").select("a", F.col("m").alias("b"))).where(a != b).distinct(), name)
        row = known.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if tuple(row) == mark:
            break
        mark = tuple(row)
    return known.select(a.alias("node"), b.alias("root")).union(known.select(b, b).distinct())


def decided(docs: DataFrame, decisions: DataFrame) -> DataFrame:
    """Rows of ``docs`` after ``decisions`` (doc_id, mark, keep), where mark is the 64-bit hash of the text.

    A row without a decision stays; of the rows with one, those to keep stay once and the others go. Rows that cannot be
    meant pass by a bitmap during the scan, so only the texts that decisions are about are shuffled.
    """
    rows = docs.select(whole(docs)).withColumn("_id", F.col("_row.doc_id")).withColumn("_mark", F.xxhash64("_row.text"))
    marked = maybe_in(rows, F.xxhash64("_id", "_mark"), decisions.select(F.xxhash64("doc_id", "mark").alias("h")))
    known = decisions.select(F.col("doc_id").alias("_other"), F.col("mark").alias("_known"), F.col("keep").alias("_keep"))
    met = marked.where("_maybe").join(known, F.col("_id").eqNullSafe(F.col("_other")) & (F.col("_mark") == F.col("_known")), "left")
    turn = F.row_number().over(W.partitionBy("_id", "_mark").orderBy("_known"))
    stay = met.where("_keep is null or _keep").withColumn("_turn", turn).where("_keep is null or _turn = 1")
    return marked.where("not _maybe").select("_row").union(stay.select("_row")).select("_row.*")
