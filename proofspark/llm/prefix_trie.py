"""Trie of conversation prefixes by splitters and a skeleton.

A conversation is its path: one element a turn, the digest and the length of the turn. Equal paths become one row, counted,
before anything is sorted. A sample gives the splitters, which cut the sorted paths into shards; a node whose members lie
in several shards is a prefix of a splitter, so the trie of the splitters, the skeleton, has all of these. It is broadcast,
bounded by ``SKELETON`` nodes whatever the input. Each shard is sorted and walked once: nodes outside the skeleton are
finished there, skeleton nodes give partial figures that are summed up and rolled up along the skeleton.

Paths are cut into segments of ``TURNS`` turns, so that no conversation has to fit into a row. The segments of a depth form
tries of their own, rooted at the prefix before them; the deepest are worked out first, and what a root has gathered is
added to the row of its prefix one segment above.
"""

from __future__ import annotations

import hashlib
from bisect import bisect_right
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window as W, functions as F

from proofspark.session import written

#: Turns a segment, nodes the skeleton may have, rows and bytes that a shard aims at, sampled rows a shard.
TURNS, SKELETON, ROWS, BYTES, SAMPLED = 8192, 1 << 16, 200_000, 1 << 25, 8
#: Bytes of an element: digest and length of a turn.
DIGEST, ELEMENT = 16, 24
#: Conversations whose heads are shared, and the most turns of a head plus one.
FAMILY, HEADS = 100, 6
#: Bytes of joined ids a row.
IDS = 1 << 20

NODES = ("kind int, block binary, conv_id bigint, depth int, parent_conv_id bigint, parent int, n_convs bigint, n_children bigint, n_leaves bigint, "
         "saved_tokens bigint, weight bigint, ends binary")
_NODES = pa.schema([("kind", pa.int32()), ("block", pa.binary()), ("conv_id", pa.int64()), ("depth", pa.int32()), ("parent_conv_id", pa.int64()), ("parent", pa.int32()),
                    ("n_convs", pa.int64()), ("n_children", pa.int64()), ("n_leaves", pa.int64()), ("saved_tokens", pa.int64()), ("weight", pa.int64()), ("ends", pa.binary())])
#: Kinds of rows that a shard gives: a finished node, a finished root of a segment, a partial skeleton node.
NODE, ROOT, PARTIAL = 0, 1, 2


def elements(turns: DataFrame) -> DataFrame:
    """(conv_id, t, element): turns numbered from 1 by turn, null first, then by digest; null roles and texts are empty."""
    role, text = F.coalesce(F.col("role"), F.lit("")), F.coalesce(F.col("text"), F.lit(""))
    name = F.sha2(F.concat(F.length(role).cast("string"), F.lit(":"), role, text), 256)
    element = F.concat(F.unhex(F.substring(name, 1, 2 * DIGEST)), F.unhex(F.lpad(F.hex(F.length(text).cast("bigint")), 2 * (ELEMENT - DIGEST), "0")))
    # only elements are shuffled, never a text
    rows = turns.where("conv_id is not null").select("conv_id", "turn", element.alias("element"))
    number = F.row_number().over(W.partitionBy("conv_id").orderBy(F.asc_nulls_first("turn"), "element"))
    return rows.select("conv_id", number.cast("bigint").alias("t"), "element")


def head_length(conv_id: Column) -> Column:
    return (F.crc32(conv_id.cast("string")) % HEADS).cast("bigint")


def rebuilt(turns: DataFrame) -> DataFrame:
    """(conv_id, d, element) of every rebuilt conversation, d from 1; and one row with d = 0 and no element for each.

    The first h turns are those of the first conversation of its family, the others its own after its first h.
    """
    own = written(elements(turns), "trie-turns")
    first = own.where((F.col("conv_id") % FAMILY == 0) & (F.col("t") < HEADS))
    heads = first.groupBy(F.col("conv_id").alias("family")).agg(F.sort_array(F.collect_list(F.struct("t", "element"))).alias("head"))  # fewer than HEADS elements
    convs = own.groupBy("conv_id").agg(F.max("t").alias("n")).withColumn("h", head_length(F.col("conv_id"))).withColumn("family", F.col("conv_id") - F.col("conv_id") % FAMILY)
    met = convs.join(heads, "family", "left").select("conv_id", "n", "h", F.filter(F.coalesce("head", F.array().cast("array<struct<t:bigint,element:binary>>")), lambda x: x.t <= F.col("h")).alias("head"))
    start = met.select("conv_id", F.explode(F.concat(F.array(F.struct(F.lit(0).cast("bigint").alias("t"), F.lit(None).cast("binary").alias("element"))), "head")).alias("x"))
    # a head may be shorter than h, and the own turns move up
    moved = met.where(F.size("head") < F.col("h")).where("n > h").select("conv_id", (F.col("h") - F.size("head")).alias("less"))
    rest = own.where(F.col("t") > head_length(F.col("conv_id"))).join(moved, "conv_id", "left")
    tail = rest.select("conv_id", (F.col("t") - F.coalesce("less", F.lit(0))).alias("d"), "element")
    return start.select("conv_id", F.col("x.t").alias("d"), F.col("x.element").alias("element")).union(tail)


def segments(rows: DataFrame, turns: int) -> DataFrame:
    """(conv_id, seg, block, path, last, next): the paths cut into segments of ``turns`` turns.

    block names the whole prefix before the segment, next the one before the following segment; a conversation that ends
    at a cut has an empty segment behind it.
    """
    d = F.col("d")
    seg = F.when(d == 0, 0).otherwise(F.floor((d - 1) / turns)).cast("int")
    marks = rows.where((d > 0) & (d % turns == 0)).select("conv_id", F.floor(d / turns).cast("int").alias("seg"), F.lit(0).cast("bigint").alias("d"), F.lit(None).cast("binary").alias("element"))
    cut = rows.select("conv_id", seg.alias("seg"), "d", "element").union(marks)
    listed = F.transform(F.array_sort(F.collect_list(F.when(F.col("element").isNotNull(), F.struct("d", "element")))), lambda x: x.element)  # `turns` at most
    paths = cut.groupBy("conv_id", "seg").agg(F.aggregate(listed, F.lit(b""), lambda z, x: F.concat(z, x)).alias("path"))
    before = W.partitionBy("conv_id").orderBy("seg").rowsBetween(W.unboundedPreceding, -1)
    named = [F.sum(F.xxhash64(F.lit(k), "seg", "path").cast("decimal(38,0)")).over(before).cast("string") for k in (1, 2)]
    block = F.when(F.col("seg") == 0, F.lit(b"")).otherwise(F.unhex(F.md5(F.concat_ws(":", F.col("seg").cast("string"), *named))))
    blocked = paths.withColumn("block", block)
    return blocked.withColumn("next", F.lead("block").over(W.partitionBy("conv_id").orderBy("seg"))).withColumn("last", F.col("next").isNull())


def _runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sorted (key, conv_id) to (key, first id, ids joined), in rows of about ``IDS`` bytes."""
    key, ids, size, out = None, [], 0, []

    def row():
        return {"key": key, "first": ids[0], "ids": ",".join(map(str, ids)).encode()}

    schema = pa.schema([("key", pa.binary()), ("first", pa.int64()), ("ids", pa.binary())])
    for b in batches:
        for k, c in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
            if ids and (k != key or size > IDS // 20):
                out.append(row())
                ids, size = [], 0
            key, size = k, size + 1
            ids.append(c)
        yield pa.RecordBatch.from_pylist(out, schema=schema)
        out = []
    yield pa.RecordBatch.from_pylist([row()] if ids else [], schema=schema)


def _digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Runs in order of (key, first id) to (key, SHA-256 of all their ids); only the state of one digest is held."""
    key, state, out = None, None, []
    schema = pa.schema([("key", pa.binary()), ("ends", pa.binary())])
    for b in batches:
        for k, ids in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
            if k != key:
                out += [{"key": key, "ends": state.digest()}] if state else []
                key, state = k, hashlib.sha256(ids)
            else:
                state.update(b"," + ids)
        yield pa.RecordBatch.from_pylist(out, schema=schema)
        out = []
    yield pa.RecordBatch.from_pylist([{"key": key, "ends": state.digest()}] if state else [], schema=schema)


def distinct_paths(parts: DataFrame) -> DataFrame:
    """(seg, block, path, next, n, least, ends) of every distinct segment path: members, the smallest, and the digest of those that end there.

    Ids of a path that many conversations share are sorted over many tasks and joined to long rows; only the digest itself
    is computed in order.
    """
    keyed = parts.withColumn("key", F.unhex(F.md5(F.concat(F.col("seg").cast("string").cast("binary"), F.lit(b":"), "block", "path"))))
    groups = keyed.groupBy("key").agg(F.first("seg").alias("seg"), F.first("block").alias("block"), F.first("path").alias("path"), F.min("next").alias("next"),
                                      F.count(F.lit(1)).alias("n"), F.min("conv_id").alias("least"), F.count_if("last").alias("ending"), F.min(F.when(F.col("last"), F.col("conv_id"))).alias("one"))
    groups = written(groups, "trie-groups")
    several = groups.where("ending > 1").select("key")
    ids = keyed.where("last").select("key", "conv_id").join(several, "key", "left_semi")
    runs = ids.repartitionByRange("key", "conv_id").sortWithinPartitions("key", "conv_id").mapInArrow(_runs, "key binary, first bigint, ids binary")
    many = runs.repartition("key").sortWithinPartitions("key", "first").select("key", "ids").mapInArrow(_digests, "key binary, ends binary")
    one = F.when(F.col("ending") == 1, F.unhex(F.sha2(F.col("one").cast("string"), 256)))
    met = groups.join(many, "key", "left")
    return written(met.select("seg", "block", "path", "next", "n", "least", F.coalesce("ends", one).alias("ends")), "trie-paths")


class Skeleton:
    """Trie of the splitters, node by node: children by element, parents, depths. Roots are named by their blocks."""

    def __init__(self, splitters: list[tuple[bytes, bytes]]) -> None:
        self.roots: dict[bytes, int] = {}
        self.children: list[dict[bytes, int]] = []
        self.parent: list[int] = []
        self.element: list[bytes] = []
        for block, path in splitters:
            node = self.roots.get(block)
            if node is None:
                node = self.roots[block] = self._new(-1, b"")
            for at in range(0, len(path), ELEMENT):
                x = path[at : at + ELEMENT]
                child = self.children[node].get(x)
                if child is None:
                    child = self.children[node][x] = self._new(node, x)
                node = child

    def _new(self, parent: int, element: bytes) -> int:
        self.children.append({})
        self.parent.append(parent)
        self.element.append(element)
        return len(self.parent) - 1


def _length(element: bytes) -> int:
    return int.from_bytes(element[DIGEST:], "big")


def _row(kind, block, least, depth, parent, n, kids, leaves, saved, weight, ends):
    return [kind, block, least, depth, None, parent, n, kids, leaves, saved, weight, ends]


def _batch(rows: list[list]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], f.type) for k, f in enumerate(_NODES)], schema=_NODES)


def _walk(skeleton: Skeleton):
    """Sorted rows (shard, block, path, n, least, ends, kids, leaves, saved) of whole shards to nodes, roots and partial figures.

    The stack has a frame for each element of the path at hand. A node that closes waits in its parent until that one
    closes too and knows its smallest member, but goes at once, with the parent's number, if that is in the skeleton.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: list[list] = []
        stack: list[dict] = []
        path: list[bytes] = []
        where = None

        def opened(number: int) -> dict:
            return {"number": number, "n": 0, "least": None, "kids": 0, "leaves": 0, "saved": 0, "ends": None, "waiting": []}

        def close() -> None:
            f, depth, block = stack.pop(), len(stack), where[1]
            weight = _length(path[depth - 1]) if depth else 0
            above = stack[-1] if stack else None
            if f["number"] >= 0:
                out.append(_row(PARTIAL, block, f["least"], depth, f["number"], f["n"], f["kids"], f["leaves"], f["saved"], weight, f["ends"]))
            else:
                leaves, saved = f["leaves"] if f["kids"] else 1, f["saved"] + (f["n"] - 1) * weight
                for x in f["waiting"]:
                    x[4] = f["least"]
                out.extend(f["waiting"])
                row = _row(NODE if above else ROOT, block, f["least"], depth, above["number"] if above else None, f["n"], f["kids"], leaves, saved, weight, f["ends"])
                if above:
                    above["kids"] += 1
                    above["leaves"] += leaves
                    above["saved"] += saved
                    (above["waiting"] if above["number"] < 0 else out).append(row)
                else:
                    out.append(row)
            if above:
                above["n"] += f["n"]
                above["least"] = f["least"] if above["least"] is None else min(above["least"], f["least"])
            else:
                path.clear()

        for b in batches:
            for shard, block, data, n, least, ends, kids, leaves, saved in zip(*(c.to_pylist() for c in b.columns)):
                if (shard, block) != where:
                    while stack:
                        close()
                    where = (shard, block)
                    stack.append(opened(skeleton.roots.get(block, -1)))
                same, top = 0, min(len(path), len(data) // ELEMENT)
                while same < top and data[same * ELEMENT : (same + 1) * ELEMENT] == path[same]:
                    same += 1
                while len(stack) > same + 1:
                    close()
                del path[same:]
                for at in range(same * ELEMENT, len(data), ELEMENT):
                    path.append(data[at : at + ELEMENT])
                    up = stack[-1]["number"]
                    stack.append(opened(skeleton.children[up].get(path[-1], -1) if up >= 0 else -1))
                f = stack[-1]
                f["n"] += n
                f["least"] = least if f["least"] is None else min(f["least"], least)
                f["ends"] = ends
                f["kids"], f["leaves"], f["saved"] = f["kids"] + kids, f["leaves"] + leaves, f["saved"] + saved
                if len(out) > 10_000:
                    yield _batch(out)
                    out.clear()
        while stack:
            close()
        yield _batch(out)

    return run


def _rolled_up(skeleton: Skeleton):
    """Summed figures of all skeleton nodes, ``SKELETON`` rows at most, to their nodes and roots."""

    def run(table):
        rows = {r["parent"]: r for r in table.to_pylist()}
        out = []
        for number in sorted(rows, reverse=True):  # children have larger numbers than their parents
            r, up = rows[number], skeleton.parent[number]
            leaves, saved = r["n_leaves"] if r["n_children"] else 1, r["saved_tokens"] + (r["n_convs"] - 1) * r["weight"]
            if up >= 0:
                above = rows[up]
                above["n_children"] += 1
                above["n_leaves"] += leaves
                above["saved_tokens"] += saved
            out.append([ROOT if up < 0 else NODE, r["block"], r["conv_id"], r["depth"], rows[up]["conv_id"] if up >= 0 else None, number, r["n_convs"], r["n_children"], leaves, saved, r["weight"], r["ends"]])
        return pa.Table.from_batches([_batch(out)])

    return run


def _sharded(paths: DataFrame, rows: int, size: int, skeleton: int) -> tuple[DataFrame, Skeleton]:
    """``paths`` with the number of their shard, and the skeleton of the splitters."""
    got = paths.agg(F.count(F.lit(1)), F.coalesce(F.sum(F.length("path")), F.lit(0))).first()
    shards = max(1, -(-got[0] // rows), -(-got[1] // size))
    shards = min(shards, skeleton // 2)
    longest = ELEMENT * max(1, skeleton // shards - 1)
    key = [F.col("block"), F.substring("path", 1, longest).alias("path")]
    splitters: list[tuple[bytes, bytes]] = []
    if shards > 1:
        # a bounded sample, and of it one key a shard: these reach the driver
        sample = paths.orderBy(F.xxhash64("block", "path")).limit(SAMPLED * shards).select(*key)
        turn = F.row_number().over(W.partitionBy(F.lit(0)).orderBy("block", "path"))
        chosen = sample.withColumn("k", turn).where(f"k % {SAMPLED} = 0").select("block", "path").distinct().collect()
        splitters = sorted((bytes(r["block"]), bytes(r["path"])) for r in chosen)

    def numbered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            shard = [bisect_right(splitters, x) for x in zip(b.column("block").to_pylist(), b.column("path").to_pylist())]
            yield pa.RecordBatch.from_arrays([pa.array(shard, pa.int32()), *b.columns], ["shard", *b.schema.names])

    names = ["block", "path", "n", "least", "ends", "kids", "leaves", "saved"]
    types = "shard int, block binary, path binary, n bigint, least bigint, ends binary, kids bigint, leaves bigint, saved bigint"
    return paths.select(*names).mapInArrow(numbered, types), Skeleton(splitters)


def _level(paths: DataFrame, rows: int, size: int, skeleton: int) -> DataFrame:
    """Nodes and roots of the tries of one depth of segments."""
    sharded, trie = _sharded(paths, rows, size, skeleton)
    order = ["shard", "block", "path"]
    walked = written(sharded.repartition("shard").sortWithinPartitions(*order).mapInArrow(_walk(trie), NODES), "trie-walked")
    if not trie.parent:
        return walked
    sums = [F.sum(c).alias(c) for c in ("n_convs", "n_children", "n_leaves", "saved_tokens")]
    reduced = walked.where(f"kind = {PARTIAL}").groupBy("parent").agg(F.min("block").alias("block"), F.min("conv_id").alias("conv_id"), F.min("depth").alias("depth"), *sums, F.min("weight").alias("weight"), F.max("ends").alias("ends"))
    top = written(reduced.groupBy(F.lit(0).alias("all")).applyInArrow(_rolled_up(trie), NODES), "trie-skeleton")
    known = top.select(F.col("parent").alias("number"), F.col("conv_id").alias("above"))
    local = walked.where(f"kind <> {PARTIAL}").join(F.broadcast(known), F.col("parent") == F.col("number"), "left")  # SKELETON rows at most
    return local.withColumn("parent_conv_id", F.coalesce("parent_conv_id", "above")).select(*walked.columns).union(top.select(*walked.columns))


def prefix_trie(turns: DataFrame, segment: int = TURNS, rows: int = ROWS, size: int = BYTES, skeleton: int = SKELETON) -> DataFrame:
    """(conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256) of every node of the trie.

    Turns are taken by number, null ones first; those of one number in the order of their digests (SHA-256 of the length of
    the role, a colon, role and text). Repeated rows are turns of their own. Null roles and texts are empty. Rows without a conv_id belong to no conversation. An empty table has no conversations, so
    not even the root. Other columns are ignored. Digests of turns have 128 bits, those of whole prefixes as well.
    """
    spark = turns.sparkSession
    empty = hashlib.sha256(b"").digest()
    paths = distinct_paths(written(segments(rebuilt(turns), segment), "trie-segments"))
    deepest = paths.agg(F.max("seg")).first()[0]
    out, roots = [], None
    for seg in range(-1 if deepest is None else deepest, -1, -1):
        own = paths.where(F.col("seg") == seg)
        if roots is None:
            own = own.withColumns({"kids": F.lit(0).cast("bigint"), "leaves": F.lit(0).cast("bigint"), "saved": F.lit(0).cast("bigint")})
        else:
            own = own.join(roots, "next", "left").fillna(0, ["kids", "leaves", "saved"]).withColumn("ends", F.coalesce("ends", "ended"))
        found = written(_level(own, rows, size, skeleton), "trie-nodes")
        whole = found.where(f"kind = {NODE}" if seg else "true").withColumn("depth", (F.col("depth") + seg * segment).cast("bigint"))
        ends = F.lower(F.hex(F.coalesce("ends", F.lit(empty)))).alias("ends_sha256")
        out.append(whole.select("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", ends))
        # of a root only what hangs below it counts here: the row above adds the node itself
        gathered = [F.col("n_children").alias("kids"), F.when(F.col("n_children") > 0, F.col("n_leaves")).otherwise(0).alias("leaves"), F.col("saved_tokens").alias("saved"), F.col("ends").alias("ended")]
        roots = found.where(f"kind = {ROOT}").select(F.col("block").alias("next"), *gathered)
    if not out:
        return spark.createDataFrame([], "conv_id bigint, depth bigint, parent_conv_id bigint, n_convs bigint, n_children bigint, n_leaves bigint, saved_tokens bigint, ends_sha256 string")
    result = out[0]
    for part in out[1:]:
        result = result.union(part)
    return result
