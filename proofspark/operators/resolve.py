"""Pinning candidates to one owned place of the source, and pairing them with verdicts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from proofspark.functions.locate import locate_unique
from proofspark.functions.spans import is_protected, protected_spans
from proofspark.functions.text import explode_rows, let


def flag_protected(quotes: DataFrame) -> DataFrame:
    """``protected`` for rows of (text, analysis_profile, category, start, end) local to a chunk, or of (spans, category, start, end)."""
    if "spans" not in quotes.columns:
        quotes = quotes.withColumn("spans", protected_spans(F.col("text"), F.col("analysis_profile")))
    return quotes.withColumn(
        "protected", is_protected(F.col("spans"), F.col("start"), F.col("end"), F.col("category"))
    )


def resolve_candidates(chunks: DataFrame) -> DataFrame:
    """One row per candidate that has exactly one place and whose midpoint lies in the chunk's core.

    Works on chunk rows carrying their ``candidates``; the protected spans are computed once per chunk and only the
    small span arrays, not the text, travel on. No shuffle.
    """
    kept = [c for c in chunks.columns if c not in ("text", "candidates", "source_start", "source_end", "core_start", "core_end")]

    def pin(text: Column) -> Column:
        return F.transform("candidates", lambda c, i: F.struct(
            i.alias("candidate_index"), c.alias("c"),
            locate_unique(text, c["quote"], c["context_before"], c["context_after"]).alias("local"),
            F.length(c["quote"]).alias("size"),
        ))

    def owned(p: Column) -> Column:
        middle = F.col("source_start") + p["local"] + F.floor(p["size"] / 2)
        return (middle >= F.col("core_start")) & (middle < F.col("core_end"))

    pinned = chunks.select(
        *kept, "source_start",
        F.when(F.size("candidates") > 0, F.filter(let(F.col("text"), pin), owned)).alias("places"),
        F.when(F.size("candidates") > 0, protected_spans(F.col("text"), F.col("analysis_profile"))).alias("spans"),
    )
    rows = explode_rows(pinned, F.col("places"), "at", "p", [*kept, "source_start", "spans"])
    start = F.col("source_start") + F.col("p.local")
    return rows.select(
        *kept, F.col("p.candidate_index").alias("candidate_index"),
        start.alias("char_start"), (start + F.col("p.size")).alias("char_end"),
        F.col("p.c.category").alias("category"), F.col("p.c.grammar_subtype").alias("grammar_subtype"),
        F.col("p.c.quote").alias("quote"), F.col("p.c.reason").alias("reason"),
        F.col("p.c.suggestion").alias("suggestion"),
        F.least(F.col("p.c.confidence"), F.lit(100)).alias("candidate_confidence"),
        is_protected(F.col("spans"), F.col("p.local"), F.col("p.local") + F.col("p.size"), F.col("p.c.category")).alias("protected"),
    )


def remap_verdicts(verdicts: DataFrame, resolved: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(verdicts with their original candidate_index, rejected chunks).

    Verdict indexes count the resolved candidates of a chunk only; an index without a candidate spoils the chunk.
    """
    keys = ["doc_id", "chunk_index"]
    numbered = resolved.groupBy(*keys).agg(F.sort_array(F.collect_list(F.struct("candidate_index"))).alias("numbered"))
    others = [c for c in verdicts.columns if c not in (*keys, "candidate_index")]
    # joined by chunk, so the window needs no exchange of its own
    joined = verdicts.join(numbered.hint("merge"), keys, "left").select(
        *keys, *others, F.get("numbered", F.col("candidate_index"))["candidate_index"].alias("candidate_index"))
    bad = joined.where(F.col("candidate_index").isNull()).select(*keys).distinct()
    spoilt = F.max(F.col("candidate_index").isNull()).over(W.partitionBy(*keys)) & F.col("doc_id").isNotNull() & F.col("chunk_index").isNotNull()
    good = joined.withColumn("spoilt", spoilt).where(~F.col("spoilt")).drop("spoilt")
    rejects = bad.select(
        F.lit("remap_verdicts").alias("stage"), "doc_id", "chunk_index", F.lit("MODEL_OUTPUT_INVALID").alias("error_code")
    )
    return good, rejects


VERDICT_FIELDS = ["category", "grammar_subtype", "verdict", "confidence", "reason", "suggestion", "evidence_source_ids"]


def pair_verdicts(resolved: DataFrame, verdicts: DataFrame) -> DataFrame:
    """Resolved candidates with their verdict as ``v_*`` columns; a verdict without a candidate is skipped."""
    side = verdicts.select(
        "doc_id", "chunk_index", "candidate_index", *[F.col(c).alias(f"v_{c}") for c in VERDICT_FIELDS]
    )
    return resolved.join(side.hint("merge"), ["doc_id", "chunk_index", "candidate_index"])


def fail_documents(rows: DataFrame, *rejects: DataFrame) -> DataFrame:
    """Drop every row of a document that has any reject: one failed chunk fails its document."""
    out = rows
    for reject in rejects:
        out = out.join(reject.select("doc_id").distinct().hint("merge"), "doc_id", "left_anti")
    return out
