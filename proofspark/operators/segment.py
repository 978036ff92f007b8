"""Lines to segments, and spans to source locations."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window as W, functions as F

from proofspark.functions.text import explode_rows, is_blank, sentence_ends

BUCKET_CHARS = 4_096


def text_lines(docs: DataFrame) -> DataFrame:
    """One row per line of a plain text, numbered from 1; such lines never carry a paragraph break."""
    return explode_rows(docs, F.split("text", "\n", -1), "at", "line_text", ["doc_id"]).select(
        "doc_id", (F.col("at") + 1).alias("line_no"), F.col("line_text").alias("text"),
        F.lit(None).cast("int").alias("page"), F.lit(False).alias("paragraph_break_after"),
    )


def build_segments(lines: DataFrame) -> DataFrame:
    """Code-point range, page, line and paragraph of every non-empty line.

    A ``line`` column overrides the line number; formats without lines leave it NULL.
    """
    shown = "line" if "line" in lines.columns else "line_no"
    earlier = W.partitionBy("doc_id").orderBy("line_no").rowsBetween(W.unboundedPreceding, -1)
    gap = F.when(F.col("paragraph_break_after"), 1).otherwise(0)
    start = F.coalesce(F.sum(F.length("text") + 1 + gap).over(earlier), F.lit(0)).cast("int")
    paragraph = F.coalesce(F.sum(gap + F.when(is_blank(F.col("text")), 1).otherwise(0)).over(earlier), F.lit(0))
    return (
        lines.withColumn("char_start", start)
        .withColumn("paragraph_index", paragraph.cast("int"))
        .where(F.length("text") > 0)
        .select(
            "doc_id", "char_start", (F.col("char_start") + F.length("text")).alias("char_end"), "page",
            F.col(shown).alias("line"), "paragraph_index", F.col("text").alias("line_text"),
        )
    )


def assemble_text(lines: DataFrame) -> DataFrame:
    """The text a document's lines stand for; one document is bounded by the length gate."""
    parts = F.transform(
        F.array_sort(F.collect_list(F.struct("line_no", "text", "paragraph_break_after"))),
        lambda x: F.concat(x["text"], F.when(x["paragraph_break_after"], F.lit("\n")).otherwise(F.lit(""))),
    )
    joined = lines.groupBy("doc_id").agg(
        F.array_join(parts, "\n").alias("text"),
        F.max_by("paragraph_break_after", "line_no").alias("tail"),
    )
    # a paragraph break behind the very last line adds nothing
    return joined.select("doc_id", F.when(F.col("tail"), F.substring("text", F.lit(1), F.length("text") - 1))
                         .otherwise(F.col("text")).alias("text"))


def _buckets(start, end):
    return F.explode(F.sequence(
        F.floor(start / BUCKET_CHARS).cast("int"), F.floor((F.greatest(end, start + 1) - 1) / BUCKET_CHARS).cast("int")
    ))


def locate(spans: DataFrame, segments: DataFrame) -> DataFrame:
    """Add page, page_end, line_start, line_end, paragraph_index, sentence_index and ``located`` to every span.

    Spans and segments meet on (document, position bucket), so a long document spreads over many small groups. Lines are
    cut at the bucket bounds first, so a bucket carries its own characters only, however long the line. The sentence
    number adds the sentence ends of the paragraph before a piece to those inside it.
    """
    in_paragraph = W.partitionBy("doc_id", "paragraph_index").orderBy("piece_start").rowsBetween(W.unboundedPreceding, -1)
    at = F.greatest(F.col("char_start"), F.col("bucket") * BUCKET_CHARS)
    size = F.least(F.col("char_end"), (F.col("bucket") + 1) * BUCKET_CHARS) - at
    pieces = segments.select("*", _buckets(F.col("char_start"), F.col("char_end")).alias("bucket")).select(
        "doc_id", "bucket", "char_start", "char_end", "page", "line", "paragraph_index", at.alias("piece_start"),
        F.substring("line_text", at - F.col("char_start") + 1, size).alias("piece"))
    seg = pieces.withColumn("ends_before", F.coalesce(F.sum(sentence_ends(F.col("piece"))).over(in_paragraph), F.lit(0)))
    wanted = spans.select("doc_id", "char_start", "char_end").where(
        (F.col("char_start") >= 0) & (F.col("char_end") > F.col("char_start"))
    ).distinct().select(
        "doc_id", F.col("char_start").alias("span_start"), F.col("char_end").alias("span_end"),
        _buckets(F.col("char_start"), F.col("char_end")).alias("bucket"),
    )
    inside = F.substring("piece", F.lit(1), F.greatest(F.col("span_start") - F.col("piece_start"), F.lit(0)))
    # the first piece that a span meets holds its start, or starts its line behind it
    hits = wanted.join(seg.hint("merge"), ["doc_id", "bucket"]).where(
        (F.col("char_start") < F.col("span_end")) & (F.col("char_end") > F.col("span_start"))
    ).select(
        "doc_id", "span_start", "span_end", F.col("piece_start").alias("char_start"),
        F.struct("page", "line", "paragraph_index",
                 (F.col("ends_before") + sentence_ends(inside)).cast("int").alias("sentence_index")).alias("seg"),
    )
    found = hits.groupBy("doc_id", "span_start", "span_end").agg(
        F.min_by("seg", "char_start").alias("first"), F.max_by("seg", "char_start").alias("last")
    ).select(
        "doc_id", F.col("span_start").alias("char_start"), F.col("span_end").alias("char_end"),
        F.col("first.page").alias("page"),
        F.when(~F.col("last.page").eqNullSafe(F.col("first.page")), F.col("last.page")).alias("page_end"),
        F.col("first.line").alias("line_start"), F.col("last.line").alias("line_end"),
        F.col("first.paragraph_index").alias("paragraph_index"),
        F.col("first.sentence_index").alias("sentence_index"),
        F.lit(True).alias("located"),
    )
    return spans.join(found.hint("merge"), ["doc_id", "char_start", "char_end"], "left").withColumn(
        "located", F.coalesce("located", F.lit(False))
    )
