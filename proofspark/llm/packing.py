"""Packing by concatenate and cut: two passes of prefix sums give every document its place in one long stream of ids."""

from __future__ import annotations

import itertools
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, Window as W, functions as F

from proofspark.llm.common import release_memory
from proofspark.llm.tokens import REMEMBERED, Encoder
from proofspark.session import written

WINDOW, END = 1024, 0
TOKENS = "part bigint, first bigint, row bigint, doc_id bigint, before bigint, tokens bigint, ids binary"
PIECES = "doc_id bigint, start bigint, length bigint, ids_crc32 bigint, doc_tokens bigint, sequence_id bigint, offset bigint, opens boolean, closes boolean, ids binary"
#: Texts encoded at a time.
STEP = 500
#: Pieces remembered a task and rows that go to Python at a time, where other steps have filled the executor before.
SPARING, ROWS = 50_000, 250


def encoded(batches: Iterator[pa.RecordBatch], path: str, space: bool, end: int, known: dict | None = None, remembered: int = REMEMBERED):
    """(doc_id, ids with ``end``) of each row of (doc_id, text); ``known`` keeps the encoder for later calls."""
    known = {} if known is None else known
    encoder = known.setdefault("encoder", None) or Encoder(path, space, remembered)
    known["encoder"] = encoder
    mark = np.array([end], encoder.type)
    for b in batches:
        for at in range(0, b.num_rows, STEP):
            part = b.slice(at, STEP)
            for doc_id, ids in zip(part.column(0).to_pylist(), encoder(part.column(1).to_pylist())):
                yield doc_id, np.concatenate([ids, mark])


def _tokens(path: str, space: bool, end: int, placed: bool):
    """Runs of rows: those of a partition, or, if rows come with file and row number, of consecutive rows of a file."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        release_memory()
        task, first, row, before, rows, held, last = TaskContext.get().partitionId(), 0, 0, 0, [], 0, None
        for b in batches:
            numbers = zip(b.column(2).to_pylist(), b.column(3).to_pylist()) if placed else itertools.repeat((task, None), b.num_rows)
            for (part, at), (doc_id, ids) in zip(numbers, encoded([b], path, space, end, known, SPARING if placed else REMEMBERED)):
                if placed and last != (part, at - 1):
                    first, before = at, 0
                row = at if placed else row
                rows.append((part, first, row, doc_id, before, len(ids), ids.astype("<u4" if ids.itemsize == 4 else "<u2").tobytes()))
                last, row, before, held = (part, at), row + 1, before + len(ids), held + len(ids)
                if held > 1 << 20:
                    yield _batch(rows)
                    rows, held = [], 0
        yield _batch(rows)
        known.clear()
        release_memory()

    known: dict = {}
    return run


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    types = [pa.int64()] * 6 + [pa.binary()]
    return pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, t in enumerate(types)], ["part", "first", "row", "doc_id", "before", "tokens", "ids"])


def token_table(docs: DataFrame, path: str, space: bool = True, end: int = END, order: list[Column] | None = None) -> DataFrame:
    """Encode whole texts once into a written table: a row a document with its place in its run of rows (first pass).

    ``order`` sets the order of the stream, else it is that of the scan. A null text is empty and has ``end`` alone.
    """
    if order:
        docs = docs.repartitionByRange(*order).sortWithinPartitions(*order)
    return written(docs.select("doc_id", "text").mapInArrow(_tokens(path, space, end, False), TOKENS), "tokens")


def stored_token_table(docs: DataFrame, path: str, space: bool = True, end: int = END) -> DataFrame:
    """The same in the order in which ``docs`` is stored: by the numbers of its files, then by row. No row is moved.

    However the files are split among tasks, a run is a stretch of one file. ``docs`` that don't come from files are
    written first, in the order of their partitions.
    """
    try:
        meta = docs.metadataColumn("_metadata")
        rows = docs.select("doc_id", "text", meta["file_name"].alias("file"), meta["row_index"].alias("at"))
    except AnalysisException:
        return stored_token_table(written(docs.select("doc_id", "text"), "tokens-input"), path, space, end)
    number = F.coalesce(F.regexp_extract("file", r"part-(\d+)", 1).try_cast("bigint"), F.lit(0)) * 100_000
    place = number + F.coalesce(F.regexp_extract("file", r"-c(\d+)[^-]*$", 1).try_cast("bigint"), F.lit(0))
    return written(rows.select("doc_id", "text", place.alias("part"), "at").mapInArrow(_tokens(path, space, end, True), TOKENS), "tokens", ROWS)


def placed(tokens: DataFrame) -> DataFrame:
    """The token table with ``place``, the ids before each document in the whole stream (second pass).

    Totals of the runs are summed up first; they are a row a run, a few a task, whatever the documents, and so broadcast.
    """
    totals = tokens.groupBy("part", "first").agg(F.sum("tokens").alias("total"))
    earlier = F.sum("total").over(W.partitionBy(F.lit(0)).orderBy("part", "first").rowsBetween(W.unboundedPreceding, -1))
    offsets = written(totals.select("part", "first", F.coalesce(earlier, F.lit(0)).alias("base")), "token-offsets")
    return tokens.join(F.broadcast(offsets), ["part", "first"]).withColumn("place", F.col("base") + F.col("before"))


def _cut(window: int, keep: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = []
            for doc_id, place, n, raw in zip(*(b.column(c).to_pylist() for c in ("doc_id", "place", "tokens", "ids"))):
                data = raw if len(raw) == 4 * n else np.frombuffer(raw, "<u2").astype("<u4").tobytes()
                start = 0
                while start < n:
                    sequence, offset = divmod(place + start, window)
                    length = min(n - start, window - offset)
                    piece = data[4 * start : 4 * (start + length)]
                    rows.append((doc_id, start, length, zlib.crc32(piece), n, sequence, offset, start == 0, start + length == n, piece if keep else None))
                    start += length
            types = [pa.int64()] * 7 + [pa.bool_()] * 2 + [pa.binary()]
            yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, t in enumerate(types)],
                                             ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", "opens", "closes", "ids"])

    return run


def pieces(tokens: DataFrame, window: int = WINDOW, keep: bool = True) -> DataFrame:
    """Boundary records: one row for each piece of a document in a window, with the piece's ids (32-bit little-endian) if ``keep``.

    opens and closes say whether the document begins and ends in the piece. Every id lies in exactly one piece, all
    windows but the last are full, and a text longer than a window simply has more pieces. Rows with equal ids and null
    ids are documents of their own.
    """
    return placed(tokens).select("doc_id", "place", "tokens", "ids").mapInArrow(_cut(window, keep), PIECES)


def sequences(parts: DataFrame, window: int = WINDOW, pad: int = 0) -> DataFrame:
    """(sequence_id, ids, filled, bounds) from ``pieces``: each window's ids as binary, padded, and where its documents start."""
    grouped = parts.groupBy("sequence_id").agg(F.sort_array(F.collect_list(F.struct("offset", "doc_id", "start", "length", "ids"))).alias("p"))
    joined = F.aggregate("p", F.lit(b""), lambda z, x: F.concat(z, x.ids))
    filled = F.aggregate("p", F.lit(0).cast("bigint"), lambda z, x: z + x.length)
    bounds = F.transform("p", lambda x: F.struct(x.doc_id.alias("doc_id"), x.start.alias("start"), x.offset.alias("offset"), x.length.alias("length")))
    filler = F.call_function("repeat", F.lit(int(pad).to_bytes(4, "little").hex()), (F.lit(window) - filled).cast("int"))
    padded = F.concat(joined, F.unhex(filler))
    return grouped.select("sequence_id", padded.alias("ids"), filled.alias("filled"), bounds.alias("bounds"))
