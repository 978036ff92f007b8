"""A run that continues an earlier one: stored outputs of finished chunks are taken again, only the others are analysed."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, functions as F

from proofspark import constants as K
from proofspark.operators.chunk import chunk
from proofspark.operators.dedup import fold_issues
from proofspark.operators.finalize import finalize
from proofspark.operators.lifecycle import plan_reuse
from proofspark.operators.report import merge_issue_sets
from proofspark.operators.resolve import pair_verdicts, resolve_candidates
from proofspark.schemas import CANDIDATE, VERDICT
from proofspark.session import written
from proofspark.sources.text import gate_documents


def resumed_issues(
    docs: DataFrame, stored: DataFrame, find: Callable[[DataFrame], DataFrame], verify: Callable[[DataFrame], DataFrame], evidence: DataFrame,
    confirmed_threshold: int = K.CONFIRMED_THRESHOLD, suspected_threshold: int = K.SUSPECTED_THRESHOLD,
) -> tuple[DataFrame, DataFrame]:
    """(folded issues, plan) of documents of which some chunks were finished before.

    ``stored``: job_id (the document), chunk_index, source_start, source_end, content, status, candidate_output,
    verifier_output. ``find`` adds candidates to chunks, ``verify`` the second pass's columns to resolved ones; both see
    pending chunks only. Stored outputs are resolved and finalised anew, so that today's thresholds and evidence hold, and
    repeats are folded over both kinds of chunks. ``plan`` has job_id, chunk_index, plan (``reusable`` or ``pending``).
    """
    keys = ["doc_id", "chunk_index"]
    chunks = written(chunk(gate_documents(docs)[0]), "resume-chunks")
    plan = written(plan_reuse(chunks.withColumnRenamed("doc_id", "job_id"), stored)[0].select("job_id", "chunk_index", "plan"), "resume-plan")
    marked = chunks.join(plan.withColumnRenamed("job_id", "doc_id"), keys)
    limits = (evidence, confirmed_threshold, suspected_threshold)
    outputs = stored.select(
        F.col("job_id").alias("doc_id"), "chunk_index", F.from_json("candidate_output", f"array<{CANDIDATE}>").alias("candidates"),
        F.from_json("verifier_output", f"array<{VERDICT}>").alias("verdicts"))
    known = marked.where("plan = 'reusable'").drop("plan").join(outputs, keys)
    verdicts = known.select(*keys, F.explode("verdicts").alias("v")).select(*keys, "v.*")
    reused = finalize(pair_verdicts(resolve_candidates(known.drop("verdicts")), verdicts), *limits)
    fresh = finalize(verify(resolve_candidates(find(marked.where("plan = 'pending'").drop("plan")))), *limits)
    return fold_issues(merge_issue_sets(reused, fresh)), plan
