"""Paragraph ranges and overlapping chunks with disjoint cores.

Both are narrow: a document row becomes its paragraph or chunk rows without a shuffle. The paragraph lengths are
taken once, then a fold over plain integers packs them; the text is sliced only for the finished ranges.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from proofspark import constants as K
from proofspark.functions.text import explode_rows, is_blank, let, slice_text

PARAGRAPH_SPLIT = r"(?<=\n\n)(?!\n)"
RANGES = "array<struct<s:int,e:int,cs:int,ce:int,ink:boolean>>"


def _pieces(text: Column) -> Column:
    """Pieces of the text, each ending with its run of two or more newlines."""
    return F.split(text, PARAGRAPH_SPLIT, -1)


def _body_length(piece: Column) -> Column:
    return F.length(piece) - F.length(F.regexp_extract(piece, r"\n{2,}\z", 0))


def paragraphs(docs: DataFrame) -> DataFrame:
    """(doc_id, paragraph_no, char_start, char_end); a text of newlines only is one paragraph."""
    sized = F.transform(_pieces(F.col("text")), lambda p: F.struct(F.length(p).alias("n"), _body_length(p).alias("body")))

    def add(acc: Column, p: Column) -> Column:
        span = F.struct(acc["at"].alias("s"), (acc["at"] + p["body"]).alias("e"))
        return F.struct(
            (acc["at"] + p["n"]).alias("at"),
            F.when(p["body"] > 0, F.concat(acc["spans"], F.array(span))).otherwise(acc["spans"]).alias("spans"),
        )

    zero = F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<s:int,e:int>>").alias("spans"))
    spans = F.aggregate(sized, zero, add, lambda acc: acc["spans"])
    whole = F.array(F.struct(F.lit(0).alias("s"), F.length("text").alias("e")))
    found = let(spans, lambda ranges: F.when(F.size(ranges) == 0, whole).otherwise(ranges))
    return explode_rows(docs.where(F.length("text") > 0), found, "paragraph_no", "span", ["doc_id"]).select(
        "doc_id", "paragraph_no", F.col("span.s").alias("char_start"), F.col("span.e").alias("char_end")
    )


def _range(s: Column, e: Column, cs: Column, ce: Column, ink: Column) -> Column:
    return F.struct(
        s.cast("int").alias("s"), e.cast("int").alias("e"),
        cs.cast("int").alias("cs"), ce.cast("int").alias("ce"), ink.alias("ink"),
    )


def _cuts(piece: Column, body: Column, hard: int, overlap: int) -> Column:
    """Ranges of one over-long paragraph, relative to its start.

    A cut falls behind the last sentence end among the final ``overlap`` characters of the window; the shared
    context is owned half by each side.
    """
    stride = max(1, hard - 2 * overlap + 1)

    def step(acc: Column, _: Column) -> Column:
        at = acc["at"]
        window = F.substring(piece, at + (hard - overlap) + 1, F.lit(overlap))
        seen = F.length(F.regexp_extract(window, f"(?s)\\A.*[{K.CUT_MARKS}]", 0))
        end = F.when(at + hard >= body, body).when(seen > 0, at + (hard - overlap) + seen).otherwise(at + hard)

        def extend(end: Column) -> Column:
            following = F.when(end >= body, end).otherwise(F.greatest(end - overlap, at + 1))
            core_end = following + F.floor((end - following) / 2).cast("int")
            cut = _range(at, end, acc["core"], core_end, ~is_blank(slice_text(piece, at, end)))
            return F.struct(
                following.cast("int").alias("at"), core_end.cast("int").alias("core"),
                (end >= body).alias("done"), F.concat(acc["out"], F.array(cut)).alias("out"),
            )

        return F.when(acc["done"], acc).otherwise(let(end, extend))

    zero = F.struct(
        F.lit(0).alias("at"), F.lit(0).alias("core"), F.lit(False).alias("done"), F.array().cast(RANGES).alias("out")
    )
    rounds = F.sequence(F.lit(1), F.floor(body / stride).cast("int") + 2)
    return F.aggregate(rounds, zero, step, lambda acc: acc["out"])


def _pack(sized: Column, target: int, hard: int, overlap: int) -> Column:
    """Fold paragraph sizes into chunk ranges."""
    nothing = F.lit(None).cast("int")

    def add(acc: Column, p: Column) -> Column:
        s = acc["at"]
        e = s + p["body"]
        is_open = acc["st"].isNotNull()
        is_long = p["cuts"].isNotNull()
        overflow = ~is_long & is_open & (e - acc["st"] > target)
        lead = (acc["pe"] - acc["ps"] <= overlap) & (e - acc["ps"] <= hard)
        closed = F.when(
            is_open & (is_long | overflow),
            F.concat(acc["out"], F.array(_range(acc["st"], acc["en"], acc["core"], acc["en"], acc["ink"]))),
        ).otherwise(acc["out"])
        moved = F.transform(p["cuts"], lambda c: _range(c["s"] + s, c["e"] + s, c["cs"] + s, c["ce"] + s, c["ink"]))
        packed = F.struct(
            (s + p["n"]).alias("at"),
            F.when(is_long, nothing).when(overflow, F.when(lead, acc["ps"]).otherwise(s))
            .otherwise(F.coalesce(acc["st"], s)).alias("st"),
            e.alias("en"),
            F.when(is_open & ~overflow, acc["core"]).otherwise(s).alias("core"),
            F.when(overflow, p["ink"] | (lead & acc["pink"])).otherwise(p["ink"] | (is_open & acc["ink"])).alias("ink"),
            s.alias("ps"), e.alias("pe"), p["ink"].alias("pink"),
            F.when(is_long, F.concat(closed, moved)).otherwise(closed).alias("out"),
        )
        skipped = F.struct(
            (s + p["n"]).alias("at"), acc["st"].alias("st"), acc["en"].alias("en"), acc["core"].alias("core"),
            acc["ink"].alias("ink"), acc["ps"].alias("ps"), acc["pe"].alias("pe"), acc["pink"].alias("pink"),
            acc["out"].alias("out"),
        )
        return F.when(p["body"] == 0, skipped).otherwise(packed)

    zero = F.struct(
        F.lit(0).alias("at"), nothing.alias("st"), F.lit(0).alias("en"), F.lit(0).alias("core"),
        F.lit(False).alias("ink"), F.lit(0).alias("ps"), F.lit(0).alias("pe"), F.lit(False).alias("pink"),
        F.array().cast(RANGES).alias("out"),
    )

    def finish(acc: Column) -> Column:
        last = F.array(_range(acc["st"], acc["en"], acc["core"], acc["en"], acc["ink"]))
        return F.when(acc["st"].isNull(), acc["out"]).otherwise(F.concat(acc["out"], last))

    return F.aggregate(sized, zero, add, finish)


def chunk(
    docs: DataFrame,
    target: int = K.TARGET_CHUNK_CHARS,
    hard: int = K.HARD_CHUNK_CHARS,
    overlap: int = K.MAX_OVERLAP_CHARS,
) -> DataFrame:
    """One row per chunk: every column of ``docs`` but the text, plus chunk_index, source and core range, text."""

    def sized(piece: Column) -> Column:
        return let(_body_length(piece), lambda body: F.struct(
            F.length(piece).alias("n"), body.alias("body"), (~is_blank(piece)).alias("ink"),
            F.when(body > hard, _cuts(piece, body, hard, overlap)).alias("cuts"),
        ))

    ranges = _pack(F.transform(_pieces(F.col("text")), sized), target, hard, overlap)
    kept = [c for c in docs.columns if c != "text"]
    rows = explode_rows(docs, F.filter(ranges, lambda c: c["ink"]), "chunk_index", "r", [*kept, "text"])
    return rows.select(
        *kept, "chunk_index",
        F.col("r.s").alias("source_start"), F.col("r.e").alias("source_end"),
        F.col("r.cs").alias("core_start"), F.col("r.ce").alias("core_end"),
        slice_text(F.col("text"), F.col("r.s"), F.col("r.e")).alias("text"),
    )
