"""N-gram Jaccard join by vertical partitioning.

The distinct 4-word shingles of a text are 64-bit values in one global order. The order is cut into fragments by pivots
that depend on the size class only. Two sets of sizes adding up to S that link differ in at most 3 S / 37 members
(J >= 85/100), so with more fragments than that some fragment is untouched in both: equal fragments give the candidates.
Partial overlaps of a candidate pair are then counted fragment by fragment, by a join on node and fragment, and summed per
pair; a pair whose first fragments leave it no chance goes early, for the others the sum decides.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window as W, functions as F

from proofspark.llm.common import components, decided, maybe_in, release_memory
from proofspark.session import discard, written

WORDS = 4
#: Links: NUM / DEN is the least similarity.
NUM, DEN = 85, 100
#: Signatures that one shuffled shard holds on average, documents and signatures that one map-side star joins.
SHARD, STAR_DOCS, STAR_SIGS = 2_000_000, 50_000, 1_000_000
#: Fragments in which overlaps are counted, and those of them that are counted first.
COUNTED, FIRST = 8, 2
#: Holders of a signature, on average, that all others of other components meet before the rest meet each other.
CENTRES = 16
SLICE = 1 << 20

NODES = "kind int, doc_id bigint, mark bigint, n bigint, node binary, sketch array<bigint>, shard int, sigs binary, ids binary, nodes binary, a binary, b binary"


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values that spreads every input bit (the splitmix finalizer's constants)."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


_BLANK = np.zeros(256, bool)
_BLANK[[32, *range(9, 14)]] = True
_LOWER = np.arange(256, dtype=np.uint64)
_LOWER[65:91] += np.uint64(32)
_BYTE = mix((_LOWER + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15))
_BASE = np.uint64(0x5851F42D4C957F2D)
_NAME = np.dtype([("x", ">u8"), ("y", ">u8")])
_STEP = mix(np.arange(1, WORDS + 1, dtype=np.uint64)) | np.uint64(1)


class Powers:
    """Powers of the base modulo 2^64, as many as the longest word so far has bytes."""

    def __init__(self) -> None:
        self.known = np.ones(1, np.uint64)

    def upto(self, n: int) -> np.ndarray:
        if len(self.known) <= n:
            self.known = np.cumprod(np.concatenate([np.ones(1, np.uint64), np.full(2 * n + 64, _BASE)]), dtype=np.uint64)
        return self.known


def word_values(data: bytes, powers: Powers) -> np.ndarray:
    """One 64-bit value a word of ``[^\\x20\\x09-\\x0D]+``, A-Z as a-z; long texts go in slices cut at white space."""
    out, begin = [], 0
    whole = np.frombuffer(data, np.uint8)
    while begin < len(whole):
        end = min(len(whole), begin + SLICE)
        while end < len(whole) and not _BLANK[whole[end]]:
            ahead = np.flatnonzero(_BLANK[whole[end : end + SLICE]])
            end = end + int(ahead[0]) if len(ahead) else min(len(whole), end + SLICE)
        part = whole[begin:end]
        blank = _BLANK[part]
        first = ~blank
        first[1:] &= blank[:-1]
        starts = np.flatnonzero(first)
        if len(starts):
            at = np.zeros(len(part), np.int64)
            at[starts] = starts
            inside = np.arange(len(part)) - np.maximum.accumulate(at)
            inside[blank] = 0
            values = _BYTE[part] * powers.upto(int(inside.max()))[inside]
            values[blank] = 0
            out.append(mix(np.add.reduceat(values, starts)))
        begin = end
    return np.concatenate(out) if out else np.empty(0, np.uint64)


def shingle_set(data: bytes, powers: Powers) -> np.ndarray:
    """Sorted distinct shingle values; a text of fewer words is one shingle, one without words has none."""
    w = word_values(data, powers)
    if not len(w):
        return w
    if len(w) < WORDS:
        return mix((w * _STEP[: len(w)]).sum(dtype=np.uint64, keepdims=True) + np.uint64(len(w)))
    n = len(w) - WORDS + 1
    total = np.zeros(n, np.uint64)
    for k in range(WORDS):
        total += w[k : k + n] * _STEP[k]
    return np.unique(mix(total))


def identity(s: np.ndarray) -> bytes:
    """16 bytes that name a set of shingles."""
    two = np.array([s.sum(dtype=np.uint64) + np.uint64(len(s)), mix(s ^ np.uint64(0xA5A5A5A5A5A5A5A5)).sum(dtype=np.uint64)])
    return mix(two).tobytes()


def sketch(s: np.ndarray) -> np.ndarray:
    """512 parity bits: each member flips one, so two sketches differ in no more bits than the sets in members."""
    return np.packbits(np.bincount((s & np.uint64(511)).astype(np.int64), minlength=512).astype(np.uint8) & 1).view(np.int64)


def size_classes(top: int) -> list[int]:
    """Largest size of each class; sets that link lie in one class or in neighbours."""
    out = [6]
    while out[-1] < top:
        out.append(max(out[-1] + 1, out[-1] * DEN // NUM))
    return out


class Signatures:
    """Values of a set's fragments, cut for its own size class and for the next one."""

    def __init__(self) -> None:
        self.classes = np.array(size_classes(1 << 10))

    def of(self, s: np.ndarray) -> np.ndarray:
        n = len(s)
        if not n:
            return s
        if n >= self.classes[-2]:
            self.classes = np.array(size_classes(4 * n))
        own = int(np.searchsorted(self.classes, n))
        out = []
        for c in (own, own + 1):
            differ = int((DEN - NUM) * 2 * self.classes[c] // (DEN + NUM))
            if not differ:
                continue  # only equal sets link, and those are one node
            spare = differ // 32 + 1
            k = differ + 1 + spare
            fragment = ((s >> np.uint64(32)) * np.uint64(k)) >> np.uint64(32)
            starts = np.flatnonzero(np.concatenate([[True], fragment[1:] != fragment[:-1]]))
            names = fragment[starts] + np.uint64(c + 1) * np.uint64(1 << 40)
            out.append(mix(np.add.reduceat(mix(s), starts) + mix(names)))
            if k - len(starts) > spare:
                # all untouched fragments may be empty: then both sets are so sparse, and share a member of their prefix
                prefix = n - -(-NUM * n // DEN) + 1
                out.append(mix(s[:prefix] ^ np.uint64(0x0F0F0F0F0F0F0F0F)))
        return np.unique(np.concatenate(out)) if out else np.empty(0, np.uint64)


def _ranked(names: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Distinct names in the order of their bytes, as Spark compares them, and the rank of each given one."""
    given = np.frombuffer(names, _NAME)
    x, y = given["x"].astype(np.uint64), given["y"].astype(np.uint64)
    order = np.lexsort((y, x))
    new = np.ones(len(order), bool)
    new[1:] = (x[order][1:] != x[order][:-1]) | (y[order][1:] != y[order][:-1])
    rank = np.empty(len(order), np.int64)
    rank[order] = np.cumsum(new) - 1
    return given[order][new], rank


def _stars(sigs: np.ndarray, owner: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Rows of the first owner of each signature, and (other, first) owners that share one."""
    order = np.lexsort((owner, sigs))
    sigs, owner = sigs[order], owner[order]
    first = np.concatenate([[True], sigs[1:] != sigs[:-1]])
    head = owner[first][np.cumsum(first) - 1]
    other = owner != head
    pairs = np.unique(np.stack([owner[other], head[other]], 1), axis=0) if other.any() else np.empty((0, 2), np.int64)
    return order[first], pairs


def _pass(shards: int):
    """Documents to document rows, signature rows a shard and candidate pairs found on the way."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        powers, signatures = Powers(), Signatures()
        names, sigs = [], []

        def flush():
            kinds = []
            distinct, owner_of = _ranked(b"".join(names))
            owner = np.repeat(owner_of.astype(np.int32), [len(x) for x in sigs])
            values = np.concatenate(sigs) if sigs else np.empty(0, np.uint64)
            keep, pairs = _stars(values, owner)
            values, owner = values[keep], owner[keep]
            shard = (values % np.uint64(shards)).astype(np.int64)
            order = np.lexsort((owner, shard))
            values, owner, shard = values[order], owner[order], shard[order]
            cuts = np.searchsorted(shard, np.arange(shards + 1))
            for k in np.flatnonzero(np.diff(cuts)):
                v, o = values[cuts[k] : cuts[k + 1]], owner[cuts[k] : cuts[k + 1]]
                here, local = np.unique(o, return_inverse=True)
                rest = v // np.uint64(shards)
                kinds.append({"kind": 1, "shard": int(k), "sigs": (rest & np.uint64(0xFFFFFFFFFFFF)).view(np.uint8).reshape(-1, 8)[:, :6].tobytes(),
                              "ids": local.astype(np.uint16).tobytes(), "nodes": distinct[here].tobytes()})
            kinds += [{"kind": 2, "a": distinct[x].tobytes(), "b": distinct[y].tobytes()} for x, y in pairs]
            names.clear(), sigs.clear()
            return kinds

        for batch in batches:
            rows, held = [], 0
            for doc_id, mark, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2)):
                data = text.as_buffer().to_pybytes() if text.is_valid else b""
                s = shingle_set(data, powers)
                node = identity(s)
                rows.append({"kind": 0, "doc_id": doc_id, "mark": mark, "n": len(s), "node": node if len(s) else None, "sketch": sketch(s).tolist() if len(s) else None})
                if len(s):
                    names.append(node)
                    sigs.append(signatures.of(s))
                    held += len(sigs[-1])
                if len(names) >= STAR_DOCS or held >= STAR_SIGS:
                    rows += flush()
                    held = 0
                if len(rows) >= 20_000:
                    yield _rows(rows)
                    rows = []
            rows += flush() if names else []
            yield _rows(rows)
        release_memory()

    return run


_SCHEMA = pa.schema([("kind", pa.int32()), ("doc_id", pa.int64()), ("mark", pa.int64()), ("n", pa.int64()), ("node", pa.binary()), ("sketch", pa.list_(pa.int64())), ("shard", pa.int32()),
                     ("sigs", pa.binary()), ("ids", pa.binary()), ("nodes", pa.binary()), ("a", pa.binary()), ("b", pa.binary())])


def _rows(rows: list[dict]) -> pa.RecordBatch:
    return pa.RecordBatch.from_pylist(rows, schema=_SCHEMA)


def _shard_pairs(table):
    """Links of the first nodes that hold a signature, over all map tasks; one entry a signature and star comes here."""
    sigs, owners, names = [], [], []
    for s, i, n in zip(table["sigs"], table["ids"], table["nodes"]):
        wide = np.zeros((len(s.as_py()) // 6, 8), np.uint8)
        wide[:, :6] = np.frombuffer(s.as_py(), np.uint8).reshape(-1, 6)
        sigs.append(wide.view(np.uint64).ravel())
        owners.append(np.frombuffer(i.as_py(), np.uint16).astype(np.int32) + sum(map(len, names)) // 16)
        names.append(n.as_py())
    distinct, rank = _ranked(b"".join(names))
    values, owner = np.concatenate(sigs), rank.astype(np.int32)[np.concatenate(owners)]
    del sigs, owners, names, rank, table
    _, pairs = _stars(values, owner)
    del values, owner
    release_memory()
    return pa.table({"a": pa.array([distinct[x].tobytes() for x in pairs[:, 0]], pa.binary()), "b": pa.array([distinct[x].tobytes() for x in pairs[:, 1]], pa.binary())})


def _sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Texts to the fragments of their sets: (node, part, members), empty ones too."""
    powers = Powers()
    pivots = (np.arange(1, COUNTED, dtype=np.uint64) * np.uint64((1 << 64) // COUNTED))
    for batch in batches:
        nodes, parts, sizes, members = [], [], [], []
        for text in batch.column(0):
            s = shingle_set(text.as_buffer().to_pybytes() if text.is_valid else b"", powers)
            if len(s):
                nodes += [identity(s)] * COUNTED
                sizes.append(np.diff(np.searchsorted(s, pivots), prepend=0, append=len(s)))
                members.append(s.view(np.int64))
        ends = np.cumsum(np.concatenate([[0], *sizes]) if sizes else [0])
        values = pa.array(np.concatenate(members) if members else np.empty(0, np.int64))
        lists = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), values)
        yield pa.RecordBatch.from_arrays([pa.array(nodes, pa.binary()), pa.array(np.tile(np.arange(COUNTED), len(sizes)), pa.int32()), lists], ["node", "part", "members"])
    release_memory()


def _signed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Texts to (short name of the node, signature)."""
    powers, signatures = Powers(), Signatures()
    for batch in batches:
        names, values = [], []
        for text in batch.column(0):
            s = shingle_set(text.as_buffer().to_pybytes() if text.is_valid else b"", powers)
            if len(s):
                values.append(signatures.of(s))
                names.append(np.full(len(values[-1]), int.from_bytes(identity(s)[:8], "big", signed=True)))
        flat = [np.concatenate(x) if x else np.empty(0, np.int64) for x in (names, values)]
        yield pa.RecordBatch.from_arrays([pa.array(flat[0], pa.int64()), pa.array(flat[1].view(np.int64))], ["short", "sig"])
    release_memory()


def _short(node: str) -> Column:
    """The first 8 bytes of a node's name; two nodes may share it, which can only make more candidates."""
    return F.conv(F.hex(F.substring(node, 1, 8)), 16, -10).cast("bigint")


def _texts_of(docs: DataFrame, doc_ids: DataFrame) -> DataFrame:
    """Texts of all rows with these ids, and perhaps a few more."""
    return maybe_in(docs, F.xxhash64("doc_id"), doc_ids.select(F.xxhash64(doc_ids.columns[0]).alias("h")).distinct()).where("_maybe").select("text")


def _sets_of(docs: DataFrame, doc_ids: DataFrame, passing: list[str]) -> DataFrame:
    sets = _texts_of(docs, doc_ids).mapInArrow(_sets, "node binary, part int, members array<bigint>")
    return written(sets.dropDuplicates(["node", "part"]), "jaccard-sets", passing=passing)


def _possible(p: str, q: str):
    """Neither sizes nor parity sketches rule the pair out: differing members times 185 are at most 15 times the sizes' sum."""
    allowed = (F.col(f"{p}.n") + F.col(f"{q}.n")) * (DEN - NUM)
    bits = sum((F.bit_count(F.col(f"{p}.sketch")[k].bitwiseXOR(F.col(f"{q}.sketch")[k])) for k in range(8)), F.lit(0))
    return (F.abs(F.col(f"{p}.n") - F.col(f"{q}.n")) * (DEN + NUM) <= allowed) & (bits * (DEN + NUM) <= allowed)


def _partial(pairs: DataFrame, sets: DataFrame, parts: range) -> DataFrame:
    """``pairs`` with the overlap and the sizes of both sides, counted fragment by fragment and summed per pair.

    Both sides meet on node and fragment, so one exchange of the sets serves both.
    """
    some = sets.where(F.col("part").between(parts[0], parts[-1]))
    left = some.select(F.col("node").alias("a"), "part", F.col("members").alias("ma"))
    right = some.select(F.col("node").alias("b"), "part", F.col("members").alias("mb"))
    by_part = pairs.withColumn("part", F.explode(F.array(*[F.lit(k) for k in parts])))
    met = by_part.join(left, ["a", "part"]).join(right, ["b", "part"])
    counts = met.select(*pairs.columns, F.size(F.array_intersect("ma", "mb")).alias("o"), F.size("ma").alias("sa"), F.size("mb").alias("sb"))
    return counts.groupBy(*pairs.columns).agg(*[F.sum(c).alias(c) for c in ("o", "sa", "sb")])


def _counted(pairs: DataFrame, sets: DataFrame, passing: list[str]) -> DataFrame:
    """(a, b) of the ``pairs`` (a, b, na, nb) whose overlaps, counted in each fragment apart and summed, reach the threshold.

    After the first fragments a pair goes that cannot reach it, even if the smaller rest were shared in full.
    """
    needed = (F.col("na") + F.col("nb")) * NUM
    first = _partial(pairs, sets, range(FIRST))
    most = F.col("o") + F.least(F.col("na") - F.col("sa"), F.col("nb") - F.col("sb"))
    going = first.where(most * (DEN + NUM) >= needed).select("a", "b", "na", "nb", F.col("o").alias("so_far"))
    rest = _partial(written(going, "jaccard-going", passing=passing), sets, range(FIRST, COUNTED))
    return rest.where((F.col("so_far") + F.col("o")) * (DEN + NUM) >= needed).select("a", "b")


def _holders(df: DataFrame, name: str) -> DataFrame:
    return df.select("sig", F.struct("node", "doc", "root", "n", "sketch").alias(name)).alias(name)


def _met(p: DataFrame, q: DataFrame, order: Column) -> DataFrame:
    """Pairs of holders of one signature, in different components, that may link."""
    both = p.join(q, "sig").where(order & (F.col("p.root") != F.col("q.root")) & _possible("p", "q"))
    swap = F.col("p.node") < F.col("q.node")
    side = lambda f, x, y: F.when(swap, F.col(f"{y}.{f}")).otherwise(F.col(f"{x}.{f}"))
    return both.select(side("node", "p", "q").alias("a"), side("node", "q", "p").alias("b"), side("n", "p", "q").alias("na"), side("n", "q", "p").alias("nb"),
                       side("doc", "p", "q").alias("da"), side("doc", "q", "p").alias("db"))


def _verified(docs: DataFrame, pairs: DataFrame) -> DataFrame:
    passing: list[str] = []
    sets = _sets_of(docs, pairs.select("da").union(pairs.select("db")), passing)
    links = written(_counted(pairs.select("a", "b", "na", "nb"), sets, passing), "jaccard-links")
    discard(docs.sparkSession, passing)
    return links


def _mixed(marked: DataFrame, passing: list[str]) -> DataFrame:
    """``marked`` without signatures that only one component holds, with the number of holders of each."""
    mixed = marked.groupBy("sig").agg(F.min("root").alias("lo"), F.max("root").alias("hi"), F.count(F.lit(1)).alias("holders")).where("lo <> hi")
    return written(marked.join(mixed.select("sig", "holders"), "sig"), "jaccard-marked", passing=passing)


def jaccard_components(docs: DataFrame) -> DataFrame:
    """(doc_id, mark, n_shingles, component_id) of every row of ``docs``; other columns are ignored.

    mark is the 64-bit hash of the text, which tells rows of one doc_id apart. component_id is the smallest doc_id reachable by links, itself included. Equal sets are one node from the start, so
    copies are never paired. Null texts and texts without words have 0 shingles and link with nothing; a row with a null
    doc_id takes part and gets the smallest id of its component, null if there is none. Repeated rows are repeated.
    Three rounds: each signature links its holders in a star; members of components that failed pairs leave apart then meet
    a few holders of each signature they share across components, and last, where components still differ, each other.
    Together every pair that may link is counted or connected.
    """
    spark = docs.sparkSession
    docs = docs.select("doc_id", "text")
    chars = docs.agg(F.sum(F.length("text"))).first()[0] or 0
    first: list[str] = []
    found = written(docs.select("doc_id", F.xxhash64("text"), "text").mapInArrow(_pass(max(1, chars // 15 // SHARD)), NODES), "jaccard", passing=first)
    few = written(found.where("kind <> 1").drop("shard", "sigs", "ids", "nodes"), "jaccard-rows")
    rows = few.where("kind = 0")
    nodes = rows.where("node is not null").groupBy("node").agg(F.min("doc_id").alias("doc"), F.first("n").alias("n"), F.first("sketch").alias("sketch"))
    local = few.where("kind = 2").select("a", "b")
    shared = found.where("kind = 1").select("shard", "sigs", "ids", "nodes").groupBy("shard").applyInArrow(_shard_pairs, "a binary, b binary")
    pairs = local.union(shared).distinct().alias("x")
    p, q = nodes.select(*[F.col(c).alias(c) for c in nodes.columns]).alias("p"), nodes.alias("q")
    ends = written(pairs.join(p, F.col("x.a") == F.col("p.node")).join(q, F.col("x.b") == F.col("q.node"))
                   .select("x.a", "x.b", F.col("p.n").alias("na"), F.col("q.n").alias("nb"), _possible("p", "q").alias("possible"), F.col("p.doc").alias("da"), F.col("q.doc").alias("db")), "jaccard-pairs")
    discard(spark, first)
    tried = ends.where("possible")
    links = _verified(docs, tried)
    roots = written(components(links, "jaccard-components"), "jaccard-roots")

    # pairs of the first round that are still apart name the components in which a link may be missing
    ra, rb = roots.select(F.col("node").alias("a"), F.col("root").alias("ra")), roots.select(F.col("node").alias("b"), F.col("root").alias("rb"))
    apart = ends.select("a", "b").join(ra, "a", "left").join(rb, "b", "left").select(F.coalesce("ra", "a").alias("ra"), F.coalesce("rb", "b").alias("rb")).where("ra <> rb")
    odd = apart.select("ra").union(apart.select("rb")).distinct().withColumnRenamed("ra", "root")
    used = ends.select(F.col("a").alias("node"), F.col("da").alias("doc")).union(ends.select("b", "db")).distinct().join(roots, "node", "left")
    members = written(used.select("node", "doc", F.coalesce("root", "node").alias("root")).join(odd, "root", "left_semi"), "jaccard-odd")
    signed = written(_texts_of(docs, members.select("doc")).mapInArrow(_signed, "short bigint, sig bigint"), "jaccard-signed", passing=first)
    shared = signed.groupBy("sig").agg(F.min("short").alias("lo"), F.max("short").alias("hi")).where("lo <> hi").select("sig")
    named = members.join(nodes.select("node", "n", "sketch"), "node").withColumn("short", _short("node"))
    marked = maybe_in(signed, F.col("sig"), written(shared, "jaccard-shared", passing=first)).where("_maybe").select("short", "sig").join(named, "short")
    later: list[str] = []
    marked = _mixed(marked.select("sig", "node", "doc", "root", "n", "sketch"), later)
    discard(spark, first)
    seen = tried.select("a", "b")
    # holders of a signature that few have all meet each other; of others a few meet all others first: a number of pairs in proportion
    small, large = marked.where(F.col("holders") <= CENTRES), marked.where(F.col("holders") > CENTRES)
    part = F.pmod(F.xxhash64("sig", "node"), F.lit(1 << 30)) * F.col("holders") < CENTRES << 30
    found = _met(_holders(small, "p"), _holders(small, "q"), F.col("p.node") > F.col("q.node"))
    found = found.union(_met(_holders(large, "p"), _holders(large.where(part), "q"), F.col("p.node") != F.col("q.node"))).distinct()
    more = written(found.join(seen, ["a", "b"], "left_anti"), "jaccard-more")
    links, seen = links.union(_verified(docs, more)), seen.union(more.select("a", "b"))
    roots = written(components(links, "jaccard-components"), "jaccard-roots")
    # the rest: all pairs of holders of those that are still in different components
    named = large.drop("root", "holders").join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
    marked = _mixed(named, first)
    discard(spark, later)
    found = _met(_holders(marked, "p"), _holders(marked, "q"), F.col("p.node") > F.col("q.node")).distinct()
    more = written(found.join(seen, ["a", "b"], "left_anti"), "jaccard-more")
    discard(spark, first)
    extra = _verified(docs, more)
    if not extra.isEmpty():
        roots = components(links.union(extra), "jaccard-components")
    least = nodes.join(roots, "node").groupBy("root").agg(F.min("doc").alias("component"))
    named = roots.join(least, "root").select("node", "component")
    own = nodes.join(named, "node", "left").select("node", F.coalesce("component", "doc").alias("component"))
    out = rows.select("doc_id", "mark", "n", "node").join(own, "node", "left")
    return out.select("doc_id", "mark", F.col("n").alias("n_shingles"), F.coalesce("component", "doc_id").alias("component_id"))


def without_near_copies(docs: DataFrame) -> DataFrame:
    """Rows of ``docs``, all their columns, with one row of each component: that whose doc_id names it.

    Rows without shingles always stay. Where rows of a component repeat its doc_id, one of them stays.
    """
    found = jaccard_components(docs).where("n_shingles > 0")
    turn = F.row_number().over(W.partitionBy("doc_id", "component_id").orderBy("mark"))
    keys = found.groupBy("doc_id", "component_id", "mark").agg(F.count(F.lit(1)).alias("rows")).withColumn("turn", turn)
    keep = F.col("doc_id").eqNullSafe(F.col("component_id")) & (F.col("turn") == 1)
    decisions = keys.select("doc_id", "mark", keep.alias("keep"), "rows").where("not keep or rows > 1").drop("rows")
    return decided(docs, written(decisions, "jaccard-decisions"))
