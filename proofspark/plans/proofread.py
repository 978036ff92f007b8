"""From documents to folded issues, by rules or by stored model responses."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, functions as F

from proofspark import constants as K
from proofspark.operators import payloads as P
from proofspark.operators.chunk import chunk
from proofspark.operators.dedup import fold_issues
from proofspark.operators.finalize import finalize
from proofspark.operators.resolve import fail_documents, pair_verdicts, remap_verdicts, resolve_candidates
from proofspark.operators.rules import scan_occurrences, scan_rules
from proofspark.operators.segment import build_segments, locate, text_lines
from proofspark.session import written
from proofspark.sources.tables import assemble_reports, report_json
from proofspark.sources.text import gate_chunkless, gate_documents


def proofread(
    docs: DataFrame, rules: DataFrame, evidence: DataFrame, verify: Callable[[DataFrame], DataFrame],
    every_occurrence: bool = True,
) -> DataFrame:
    """Folded issues of a collection; texts beyond the length gate and blank ones have none.

    Everything up to the accepted issue is one narrow stage behind the scan; only issue rows are shuffled.
    """
    chunks = chunk(gate_documents(docs)[0])
    scanned = scan_occurrences(chunks, rules) if every_occurrence else scan_rules(chunks, rules)
    return fold_issues(finalize(verify(resolve_candidates(scanned)), evidence))


def full_reports(
    docs: DataFrame, rules: DataFrame, evidence: DataFrame, verify: Callable[[DataFrame], DataFrame], generated_at: Column,
) -> DataFrame:
    """(doc_id, job_id, content): the complete report of every document that passes the gate, as JSON, places in the source included.

    ``docs``: doc_id, original_name, document_format, analysis_profile, text. Job and report are named by the document.
    """
    good = written(gate_documents(docs)[0], "report-documents")
    issues = proofread(good.select("doc_id", "analysis_profile", "text"), rules, evidence, verify)
    found = locate(written(issues, "report-issues"), build_segments(text_lines(good.select("doc_id", "text"))))
    name = F.col("doc_id").cast("string")
    heads = good.select(
        "doc_id", name.alias("report_id"), name.alias("job_id"),
        F.struct("original_name", F.col("document_format").alias("format"), F.length("text").alias("char_count")).alias("document"),
        F.struct("analysis_profile").alias("analysis"))
    formats = good.select("doc_id", "document_format")
    return report_json(assemble_reports(heads, found.where("located").join(formats.hint("merge"), "doc_id"), generated_at))


def _reject(rows: DataFrame, stage: str, code: str) -> DataFrame:
    return rows.select(F.lit(stage).alias("stage"), "doc_id", "chunk_index", F.lit(code).alias("error_code"))


def proofread_responses(
    docs: DataFrame, segments: DataFrame, candidate_responses: DataFrame, verdict_responses: DataFrame, evidence: DataFrame,
    confirmed_threshold: int = K.CONFIRMED_THRESHOLD, suspected_threshold: int = K.SUSPECTED_THRESHOLD,
) -> tuple[DataFrame, DataFrame]:
    """(located and folded issues, rejects) from stored responses of both passes.

    Responses have doc_id, chunk_index, content, as normalize_responses gives them, with its error_code. A bad, missing
    or repeated response, an unknown verdict index or an issue without a place fails the document as a whole, and so does
    the length gate. Tables that several steps read are stored once in the shared scratch folder; all of them grow with the
    documents, so they are joined by sorting: a broadcast would pass a side through the driver.
    """
    keys = ["doc_id", "chunk_index"]
    candidate_responses, verdict_responses = _one_each(candidate_responses), _one_each(verdict_responses)
    docs, gated = gate_documents(docs)
    chunks = written(chunk(docs), "chunks")
    asked = chunks.select(*keys)
    first = written(_checked(P.check_candidates(P.parse_candidates(candidate_responses))), "candidates")
    good, bad_first = P.split_checked(first, "candidates")
    silent = _reject(asked.join(first.select(*keys).hint("merge"), keys, "left_anti"), "candidates", "PROVIDER_UNAVAILABLE")
    resolved = written(resolve_candidates(chunks.join(good.select(*keys, F.col("issues").alias("candidates")).hint("merge"), keys)), "resolved")
    counts = resolved.groupBy(*keys).agg(F.count(F.lit(1)).cast("int").alias("candidate_count"))
    second = P.check_verdicts(P.parse_verdicts(verdict_responses.join(counts.hint("merge"), keys)))
    second = written(_checked(second), "verdicts")
    good_second, bad_second = P.split_checked(second, "verdicts")
    unanswered = _reject(counts.join(second.select(*keys).hint("merge"), keys, "left_anti"), "verdicts", "PROVIDER_UNAVAILABLE")
    verdicts, lost = remap_verdicts(P.flatten_payload(good_second.select(*keys, "verdicts"), "verdicts"), resolved)
    found = written(finalize(pair_verdicts(resolved, verdicts), evidence, confirmed_threshold, suspected_threshold), "found")
    located = written(locate(found, segments), "located")
    homeless = _reject(located.where("not located"), "locate", "MODEL_OUTPUT_INVALID")
    empty = gate_chunkless(docs, chunks).unionByName(gated).select("stage", "doc_id", F.lit(None).cast("int").alias("chunk_index"), "error_code")
    rejects = written(
        bad_first.unionByName(silent).unionByName(bad_second).unionByName(unanswered).unionByName(lost).unionByName(homeless)
        .unionByName(empty).distinct(), "rejects")
    return fail_documents(fold_issues(located.where("located")), rejects), rejects


def _one_each(responses: DataFrame) -> DataFrame:
    """One row per chunk with the error it already has as ``earlier``; where several responses claim a chunk, none is taken.

    What has an error is not parsed any more, so its content is left behind. Rows without a key stay as they are.
    """
    earlier = F.max("error_code") if "error_code" in responses.columns else F.lit(None).cast("string")
    known = F.col("doc_id").isNotNull() & F.col("chunk_index").isNotNull()
    return responses.groupBy("doc_id", "chunk_index").agg(
        F.count(F.lit(1)).alias("n"), F.min("content").alias("content"), earlier.alias("found")
    ).withColumn("earlier", F.when(known, F.when(F.col("n") > 1, P.BAD).otherwise(F.col("found")))).select(
        "doc_id", "chunk_index", F.when(F.col("earlier").isNull(), F.col("content")).alias("content"), "earlier")


def _checked(parsed: DataFrame) -> DataFrame:
    """Keep the error an envelope already had."""
    return parsed.withColumn("error_code", F.coalesce("earlier", "error_code")).drop("earlier")
