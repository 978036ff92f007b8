"""Mixing sources to target weights by Pfair scheduling, with DataFrame functions only.

A source's rows, in the order of the digest of their ids, are cut into blocks of equal size. In virtual time v a source
with share s and N blocks is due min(N, s v) blocks, so t(v) = sum of min(N_j, s_j v) blocks are due altogether: the live
sources keep the proportion of their shares, and a source that ends leaves its place to the others. Block k of source i
may not start before slot floor(t((k - 1) / s_i)) and must be over by slot ceil(t(k / s_i)). Earliest deadline first meets
all of these windows, since no span of slots holds more blocks than it is long; hence each source is always less than one
block from what is due to it. Shares are the whole weights themselves, nothing is rounded, so this holds however long the
mixture is.

Frames of slots are independent of each other: what earliest deadline first has placed before slot t follows from the
windows alone. Blocks whose deadline is at most t are placed, and of the blocks whose window t cuts, one a source at most,
those with the earliest deadlines that fit: for every r, the placed blocks released at r or later fill at most t - r slots.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from proofspark.llm.common import maybe_in, whole
from proofspark.session import written

#: Characters a block; rows that a rank bucket aims at; slots a frame, or the sources if they are more.
BLOCK, BUCKET, FRAME = 16384, 50_000, 256


def _key(source: Column) -> Column:
    return F.coalesce(F.concat(F.lit("="), source.cast("string")), F.lit("none"))


def square_root_weights(sizes: DataFrame) -> DataFrame:
    """(key, weight): the whole square roots of the sources' sizes, which lift small sources and lower large ones."""
    return sizes.select("key", F.floor(F.sqrt("size")).cast("bigint").alias("weight"))


def frames(sources: DataFrame, frame: int = FRAME) -> DataFrame:
    """(key, block, slot) of every block, counted from 1, from (key, share, blocks) of n sources.

    Frames of max(``frame``, n) slots, each on its own. Whole numbers throughout, decimal where products may leave 64 bits.
    """
    n, total, shares = sources.agg(F.count(F.lit(1)), F.sum("blocks"), F.sum("share")).first()
    length, total = max(frame, n), total or 0
    kind = "bigint" if 4 * total * (shares or 0) < 1 << 63 else "decimal(19,0)"
    times = lambda a, b: f"(cast({a} as {kind}) * cast({b} as {kind}))"
    ended = f"""aggregate(array_sort(all, (a, b) -> int(sign({times("a.blocks", "b.share")} - {times("b.blocks", "a.share")}))),
        array(named_struct('ended', 0L, 'alive', cast(aggregate(all, 0L, (z, y) -> z + y.share) as bigint), 'blocks', 0L, 'share', 1L)),
        (z, y) -> concat(z, array(named_struct('ended', z[size(z) - 1].ended + y.blocks, 'alive', z[size(z) - 1].alive - y.share, 'blocks', y.blocks, 'share', y.share))))"""
    every = sources.agg(F.sort_array(F.collect_list(F.struct("key", "share", "blocks"))).alias("all"))
    # between two endings of sources: blocks of those that are over, shares of the others, and the source that ended last
    every = written(every.select("all", F.expr(f"filter({ended}, m -> m.alive > 0)").alias("spans")), "mix-spans")
    slots = -(-total // length)
    spans = sources.sparkSession.range(0, slots, 1, slots // 8 + 1).select((F.col("id") * length).alias("t"), F.least((F.col("id") + 1) * length, F.lit(total)).alias("end"))
    span = lambda t: f"element_at(filter(spans, m -> {times(f'({t} - m.ended)', 'm.share')} >= {times('m.blocks', 'm.alive')}), -1)"
    low = lambda y, t, m: f"least({y}.blocks, {times(f'{y}.share', f'({t} - {m}.ended)')} div {m}.alive)"
    high = lambda y, t, m: f"least({y}.blocks, ({times(f'{y}.share', f'({t} - {m}.ended)')} + {m}.alive - 1) div {m}.alive)"
    # t(k / share) times the share: the least of the lines that t(v) consists of
    due = lambda y, k: f"array_min(transform(spans, m -> {times('m.ended', f'{y}.share')} + {times(k, 'm.alive')}))"
    job = lambda y, k: f"named_struct('deadline', ({due(y, k)} + {y}.share - 1) div {y}.share, 'key', {y}.key, 'k', {k}, 'release', {due(y, f'({k} - 1)')} div {y}.share)"
    runs = spans.join(F.broadcast(every), F.lit(True)).withColumn("now", F.expr(span("t"))).withColumn("then", F.expr(span("end")))
    runs = runs.withColumn("at", F.expr(f"transform(all, y -> named_struct('key', y.key, 'share', y.share, 'blocks', y.blocks, 'low', {low('y', 't', 'now')}, 'high', {high('y', 't', 'now')}, 'last', {high('y', 'end', 'then')}))"))
    runs = runs.withColumn("cut", F.expr(f"transform(filter(at, y -> y.low < y.high), y -> {job('y', 'y.high')})"))
    room = f"t - r - aggregate(at, 0L, (z, y) -> z + greatest(0L, y.low - {high('y', 'r', 'w')}))"
    runs = runs.withColumn("placed", F.expr(f"""
        slice(aggregate(array_sort(array_distinct(transform(cut, j -> j.release)), (a, b) -> int(sign(b - a))), slice(cut, 1, 0),
            (s, r) -> slice(array_sort(concat(s, filter(cut, j -> j.release = r))), 1, int(element_at(transform(array({span("r")}), w -> {room}), 1)))),
            1, int(t - aggregate(at, 0L, (z, y) -> z + y.low)))"""))
    fresh = f"flatten(transform(filter(at, y -> y.last > y.high), y -> transform(sequence(y.high + 1, y.last), k -> {job('y', 'k')})))"
    runs = runs.withColumn("jobs", F.expr(f"array_sort(concat(filter(cut, j -> not array_contains(placed, j)), {fresh}))"))
    runs = runs.withColumn("order", F.expr("""
        aggregate(sequence(t, end - 1), struct(jobs as left, slice(jobs, 1, 0) as done),
            (s, x) -> element_at(transform(array(int(array_position(transform(s.left, j -> j.release <= x), true))), p ->
                struct(concat(slice(s.left, 1, p - 1), slice(s.left, p + 1, size(s.left))) as left, concat(s.done, slice(s.left, p, 1)) as done)), 1),
            s -> s.done)"""))
    return runs.select("t", F.posexplode("order").alias("nth", "job")).select("job.key", F.col("job.k").alias("block"), (F.col("t") + F.col("nth")).alias("slot"))


def mix(docs: DataFrame, weights=square_root_weights, block: int = BLOCK, carry: list[str] | None = None) -> DataFrame:
    """(_row, _block, _slot, _start) of every row of ``docs``: its columns, or those to ``carry``, and its place in the mixture.

    Order by (_slot, _start). _block counts the blocks of the source from 1, _start its characters before the row. A row
    lies in the block in which it starts; a long one uses up the blocks it covers. A null or empty text counts one
    character. A null source is a source of its own. Rows that repeat an id stand side by side. ``weights`` makes (key,
    weight) from the (key, size) of all sources: whole numbers, which are the shares, 1 at least.
    Sources have no largest size: ranks inside a source are counted in buckets of the digests of its ids.
    """
    rows = docs.select(*_handle(F.col("doc_id"), F.col("source"), F.col("text")), whole(docs, carry))
    return _placed(rows, docs.count(), weights, block).select("_row", "_block", "_slot", "_start")


def _handle(doc_id: Column, source: Column, text: Column) -> list[Column]:
    """Rows alike in these are interchangeable in the mixture."""
    size = F.greatest(F.lit(1), F.coalesce(F.length(text), F.lit(0))).cast("bigint")
    return [doc_id.alias("_id"), _key(source).alias("_key"), F.xxhash64(text).alias("_mark"), size.alias("_size")]


def _placed(rows: DataFrame, count: int, weights, block: int) -> DataFrame:
    """``rows`` (_id, _key, _mark, _size and others) with _block, _slot and _start."""
    digest = F.md5(F.coalesce(F.col("_id").cast("string"), F.lit("")))
    digits = max(1, (count // BUCKET).bit_length() // 4 + 1)
    rows = rows.withColumn("_digest", digest).withColumn("_bucket", F.substring("_digest", 1, digits))
    sizes = written(rows.groupBy(F.col("_key").alias("key"), F.col("_bucket").alias("bucket")).agg(F.sum("_size").alias("size")), "mix-sizes")
    earlier = F.coalesce(F.sum("size").over(W.partitionBy("key").orderBy("bucket").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    offsets = sizes.select(F.col("key").alias("_key"), F.col("bucket").alias("_bucket"), earlier.alias("_offset"))
    totals = sizes.groupBy("key").agg(F.sum("size").alias("size"))
    share = weights(totals).select("key", F.greatest(F.lit(1), F.col("weight")).cast("bigint").alias("share"))
    sources = written(totals.join(share, "key").select("key", "share", F.expr(f"(size + {block} - 1) div {block}").alias("blocks")), "mix-sources")
    table = written(frames(sources), "mix-frames")
    inside = F.sum("_size").over(W.partitionBy("_key", "_bucket").orderBy("_digest", "_id", "_size", "_mark").rowsBetween(W.unboundedPreceding, -1))
    starts = rows.withColumn("_inside", F.coalesce(inside, F.lit(0))).join(offsets, ["_key", "_bucket"]).withColumn("_start", F.col("_inside") + F.col("_offset"))
    cut = starts.withColumn("_block", F.expr(f"_start div {block} + 1"))
    named = table.select(F.col("key").alias("_key"), F.col("block").alias("_block"), F.col("slot").alias("_slot"))
    return cut.join(named, ["_key", "_block"])


def mixed(docs: DataFrame) -> DataFrame:
    """All rows of ``docs``, sorted into the mixture: written as files, their numbers and row numbers give its order.

    Places are worked out without the rows; a row then moves twice, to its place and to its file. Files get equal numbers
    of slots, and so about equal numbers of characters.
    """
    handle = ["_id", "_key", "_mark", "_size"]
    of = lambda row: _handle(F.col(f"{row}doc_id"), F.col(f"{row}source"), F.col(f"{row}text"))
    places = written(_placed(docs.select(*of("")), docs.count(), square_root_weights, BLOCK).select(*handle, F.struct("_slot", "_start").alias("_at")), "mix-places")
    hashed = F.xxhash64(*handle)
    repeated = written(places.groupBy(hashed.alias("h")).agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("h"), "mix-repeated")
    rows = maybe_in(docs.select(whole(docs)).select(*of("_row."), "_row"), hashed, repeated)
    found = maybe_in(places, hashed, repeated)
    met = lambda c: [F.col(f"x.{h}").eqNullSafe(F.col(f"y.{h}")) for h in c]
    # rows that are alike take their places in turn; they are few, or copies with one id
    turn = F.row_number().over(W.partitionBy(*handle).orderBy("_size")).alias("_turn")
    alike, theirs = rows.where("_maybe").select("*", turn), found.where("_maybe").select("*", F.row_number().over(W.partitionBy(*handle).orderBy("_at")).alias("_turn"))
    several = alike.alias("x").join(theirs.alias("y"), met([*handle, "_turn"]))
    alone = rows.where("not _maybe").alias("x").join(found.where("not _maybe").alias("y"), met(handle))
    out = alone.select("_row", "_at.*").union(several.select("_row", "_at.*"))
    files = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    slots = (places.agg(F.max("_at._slot")).first()[0] or 0) + 1
    part = F.expr(f"cast(_slot * {files} div {slots} as int)")
    return out.repartitionById(files, part).sortWithinPartitions("_slot", "_start", "_row.doc_id").select("_row.*")
