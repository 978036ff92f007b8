"""Token ids in ORC files: stripes with integer run-length encoding, row indexes and Bloom filters on document ids."""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import Broadcast, TaskContext
from pyspark.sql import DataFrame, SparkSession, Window as W, functions as F

from proofspark.llm.packing import encoded
from proofspark.session import written

FILES = "part int, doc_id bigint, before bigint, tokens bigint, ids array<int>"
END = 2
#: Bytes a stripe (the unit of a split), rows an index entry, share of false hits of the Bloom filters.
STRIPE, STRIDE, FALSE_HITS = 16 << 20, 1000, 0.01
#: Pieces that a Python worker remembers from task to task.
REMEMBERED = 1_000_000


def _rows(path: str, space: bool, end: int, kept: Broadcast):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, before = TaskContext.get().partitionId(), 0
        names, ids, held = [], [], 0

        def batch(start: int) -> pa.RecordBatch:
            sizes = np.fromiter(map(len, ids), np.int64, len(ids))
            offsets = np.concatenate([[0], np.cumsum(sizes)])
            flat = np.concatenate(ids).astype(np.uint32).view(np.int32) if ids else np.empty(0, np.int32)
            lists = pa.ListArray.from_arrays(pa.array(offsets.astype(np.int32)), pa.array(flat))
            return pa.RecordBatch.from_arrays([pa.array(np.full(len(ids), part, np.int32)), pa.array(names, pa.int64()), pa.array(start + offsets[:-1]), pa.array(sizes), lists],
                                              ["part", "doc_id", "before", "tokens", "ids"])

        for doc_id, x in encoded(batches, path, space, end, kept.value, REMEMBERED):
            names.append(doc_id)
            ids.append(x)
            held += len(x)
            if held > 1 << 20:
                yield batch(before)
                before, names, ids, held = before + held, [], [], 0
        yield batch(before)

    return run


def write_token_files(docs: DataFrame, folder: str, path: str, space: bool = False, end: int = END) -> None:
    """Encode whole texts and write them in ascending doc_id order, one file a range of ids (null ids first).

    Equal ids stand side by side. A range may be read alone: ``before`` counts the ids before a document in its own file.
    A worker's copy of the broadcast value holds its encoder, so one is made a worker, not a task, and knows pieces already.
    """
    kept = docs.sparkSession.sparkContext.broadcast({})
    order = [F.col("doc_id").asc_nulls_first(), F.xxhash64("text").asc()]
    rows = docs.select("doc_id", "text").repartitionByRange(*order).sortWithinPartitions(*order)
    (rows.mapInArrow(_rows(path, space, end, kept), FILES).write.option("orc.stripe.size", STRIPE).option("orc.row.index.stride", STRIDE)
     .option("orc.bloom.filter.columns", "doc_id").option("orc.bloom.filter.fpp", FALSE_HITS).option("orc.compress", "ZSTD").orc(folder))
    kept.unpersist()


def read_token_files(spark: SparkSession, folder: str, doc_ids: list[int] | None = None) -> DataFrame:
    """The files' rows; ``doc_ids`` are looked up by statistics and Bloom filters, so other stripes are not decoded."""
    rows = spark.read.schema(FILES).orc(folder)
    return rows if doc_ids is None else rows.where(F.col("doc_id").isin(doc_ids))


def _digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        lists = b.column("ids")
        flat, cuts = lists.values.to_numpy(zero_copy_only=False).astype("<i4", copy=False), lists.offsets.to_numpy()
        crcs = [zlib.crc32(flat[x:y].tobytes()) for x, y in zip(cuts[:-1], cuts[1:])]
        names = ["doc_id", "start", "n_tokens"]
        yield pa.RecordBatch.from_arrays([b.column(c) for c in names] + [pa.array(np.diff(cuts).astype(np.int64)), pa.array(crcs, pa.int64())], [*names, "n_read", "ids_crc32"])


def token_digests(spark: SparkSession, folder: str) -> DataFrame:
    """(doc_id, start, n_tokens, n_read, ids_crc32) of every document as the files hold it; start counts over all files.

    Files are in the order of their ids, so their totals (one row a file, hence broadcast) give each its first place.
    """
    rows = read_token_files(spark, folder)
    totals = rows.groupBy("part").agg(F.sum("tokens").alias("total"))
    earlier = F.sum("total").over(W.partitionBy(F.lit(0)).orderBy("part").rowsBetween(W.unboundedPreceding, -1))
    offsets = written(totals.select("part", F.coalesce(earlier, F.lit(0)).alias("base")), "orc-offsets")
    joined = rows.join(F.broadcast(offsets), "part").select("doc_id", (F.col("base") + F.col("before")).alias("start"), F.col("tokens").alias("n_tokens"), "ids")
    return joined.mapInArrow(_digests, "doc_id bigint, start bigint, n_tokens bigint, n_read bigint, ids_crc32 bigint")
