"""Verified candidates to issues: gate, class, level, narrowed edit, evidence."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from proofspark import constants as K
from proofspark.functions.edits import localize_edit
from proofspark.schemas import EVIDENCE_REF


def merged_category(candidate: Column, verdict: Column) -> Column:
    return F.coalesce(verdict, candidate)


def merged_subtype(candidate_subtype: Column, verdict_category: Column, verdict_subtype: Column) -> Column:
    return F.when(verdict_category.isNotNull(), verdict_subtype).otherwise(candidate_subtype)


def class_changed(category: Column, subtype: Column, v_category: Column, v_subtype: Column) -> Column:
    return F.coalesce(
        (v_category != category) | ((v_category == "grammar") & ~v_subtype.eqNullSafe(subtype)), F.lit(False)
    )


def issue_level(
    candidate_confidence: Column, v_confidence: Column, verdict: Column, category: Column, subtype: Column,
    changed: Column, protected: Column, confirmed_threshold: int = K.CONFIRMED_THRESHOLD,
) -> Column:
    sure = (
        (candidate_confidence >= confirmed_threshold) & (v_confidence >= confirmed_threshold) & (verdict == "confirmed")
    )
    contextual = (category == "grammar") & F.coalesce(subtype.isin(K.CONTEXTUAL_SUBTYPES), F.lit(False))
    review = changed | (category == "paragraph") | protected | contextual
    return F.when(sure & ~review, F.lit("confirmed")).otherwise(F.lit("suspected"))


def evidence_refs(ids: Column, category: Column, evidence: DataFrame) -> Column:
    """References that the category may cite, in first-mention order.

    Only the ids of the fixed scope can ever be cited, so at most that many dimension rows reach the driver.
    """
    rows = evidence.where(F.col("active") & F.col("id").isin(list(K.EVIDENCE_SCOPE))).select(
        "id", "title", "revision", "source_url"
    ).distinct().collect()

    def ref(source_id: Column) -> Column:
        out = F.lit(None).cast(EVIDENCE_REF)
        for row in rows:
            hit = (source_id == row["id"]) & (category == K.EVIDENCE_SCOPE[row["id"]])
            out = F.when(hit, F.struct(
                F.lit(row["id"]).alias("source_id"), F.lit(row["title"]).alias("title"),
                F.lit(row["revision"]).alias("revision"), F.lit(row["source_url"]).alias("source_url"),
            )).otherwise(out)
        return out

    return F.array_compact(F.transform(F.array_distinct(ids), ref))


def issue_id(doc_id: Column, start: Column, end: Column, category: Column, subtype: Column, suggestion: Column) -> Column:
    return F.sha2(F.concat_ws("|", doc_id, start, end, category, F.coalesce(subtype, F.lit("")), suggestion), 256)


def finalize(
    paired: DataFrame, evidence: DataFrame,
    confirmed_threshold: int = K.CONFIRMED_THRESHOLD, suspected_threshold: int = K.SUSPECTED_THRESHOLD,
) -> DataFrame:
    """One row per accepted issue; narrow, no shuffle."""
    kept = [
        c for c in paired.columns
        if not c.startswith("v_") and c not in (
            "category", "grammar_subtype", "reason", "suggestion", "quote", "char_start", "char_end", "protected",
            "candidate_confidence")
    ]
    rows = (
        paired.where((F.col("v_verdict") != "rejected") & (F.col("v_confidence") >= suspected_threshold))
        .withColumn("changed", class_changed(
            F.col("category"), F.col("grammar_subtype"), F.col("v_category"), F.col("v_grammar_subtype")))
        .withColumn("new_subtype", merged_subtype(F.col("grammar_subtype"), F.col("v_category"), F.col("v_grammar_subtype")))
        .withColumn("new_category", merged_category(F.col("category"), F.col("v_category")))
        .withColumn("level", issue_level(
            F.col("candidate_confidence"), F.col("v_confidence"), F.col("v_verdict"), F.col("new_category"),
            F.col("new_subtype"), F.col("changed"), F.col("protected"), confirmed_threshold))
        .withColumn("edit", F.when(~F.col("changed"), localize_edit(
            F.col("new_category"), F.col("quote"), F.col("v_suggestion"))))
    )
    start = F.col("char_start") + F.coalesce(F.col("edit.char_offset"), F.lit(0))
    original = F.coalesce(F.col("edit.original_text"), F.col("quote"))
    shaped = rows.select(
        *kept, F.col("new_category").alias("category"), F.col("new_subtype").alias("grammar_subtype"), "level",
        start.alias("char_start"), (start + F.length(original)).alias("char_end"), original.alias("original_text"),
        F.col("v_reason").alias("reason"),
        F.coalesce(F.col("edit.suggestion"), F.col("v_suggestion")).alias("suggestion"),
        F.least(F.col("v_confidence"), F.lit(100)).alias("confidence"),
        evidence_refs(F.col("v_evidence_source_ids"), F.col("new_category"), evidence).alias("evidence_refs"),
    )
    return shaped.withColumn("issue_id", issue_id(
        F.col("doc_id"), F.col("char_start"), F.col("char_end"), F.col("category"), F.col("grammar_subtype"),
        F.col("suggestion")))
