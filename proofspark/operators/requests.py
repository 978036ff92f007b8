"""Inference request tables, frozen configurations and the model-pass extension point."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F

from proofspark import constants as K


def profile_guidance(profile: Column) -> Column:
    out = F.lit(None).cast("string")
    for name, text in K.PROFILE_GUIDANCE.items():
        out = F.when(profile == name, F.lit(text)).otherwise(out)
    return out


def scoped_prompt_version(base: Column, profile: Column) -> Column:
    return F.concat(base, F.lit(f"+{K.GUIDANCE_VERSION}-"), profile)


def with_guidance(template: Column, profile: Column) -> Column:
    return F.concat(template, F.lit("\n\n"), profile_guidance(profile))


def json_string(text: Column) -> Column:
    """The text as one JSON string literal."""
    wrapped = F.to_json(F.struct(text.alias("t")))
    return F.substring(wrapped, F.lit(6), F.length(wrapped) - 6)


def _id_list(ids: Column) -> Column:
    return F.when(F.size(ids) == 0, F.lit(K.REQUEST_NO_IDS)).otherwise(F.array_join(ids, ", "))


def candidate_prompt(text: Column, ids: Column) -> Column:
    return F.concat(
        F.lit(K.REQUEST_IDS), _id_list(ids),
        F.lit(K.REQUEST_TEXT), json_string(text),
    )


def verifier_prompt(text: Column, targets_json: Column, ids: Column) -> Column:
    return F.concat(
        F.lit(K.REQUEST_IDS), _id_list(ids),
        F.lit(K.REQUEST_SOURCE), json_string(text),
        F.lit(K.REQUEST_PLACES), targets_json,
    )


def build_candidate_requests(chunks: DataFrame) -> DataFrame:
    """First pass: one request per chunk; expects analysis_profile, system_template, evidence_ids columns."""
    return chunks.select(
        "doc_id", "chunk_index",
        with_guidance(F.col("system_template"), F.col("analysis_profile")).alias("system_prompt"),
        candidate_prompt(F.col("text"), F.col("evidence_ids")).alias("user_prompt"),
    )


def build_verifier_requests(chunks: DataFrame, indexes: DataFrame) -> DataFrame:
    """Second pass for chunks with resolved candidates only.

    ``chunks`` carries candidates, analysis_profile, system_template, evidence_ids; ``indexes`` the resolved
    candidate_index rows. The request shows places and contexts, never the first diagnosis.
    """
    resolved = indexes.groupBy("doc_id", "chunk_index").agg(F.array_sort(F.collect_set("candidate_index")).alias("kept"))
    target = F.transform("kept", lambda i: F.struct(
        F.get("candidates", i)["quote"].alias("quote"),
        F.get("candidates", i)["context_before"].alias("context_before"),
        F.get("candidates", i)["context_after"].alias("context_after"),
    ))
    return chunks.join(resolved, ["doc_id", "chunk_index"]).select(
        "doc_id", "chunk_index", F.size("kept").alias("candidate_count"),
        with_guidance(F.col("system_template"), F.col("analysis_profile")).alias("system_prompt"),
        verifier_prompt(F.col("text"), F.to_json(target, {"ignoreNullFields": "false"}), F.col("evidence_ids")).alias("user_prompt"),
    )


def resolve_config(jobs: DataFrame, profiles: DataFrame, prompts: DataFrame) -> DataFrame:
    """Configuration of each job: its own snapshot, else model profile and pinned or active prompt.

    Guidance is appended once: a snapshot that names a guidance version is kept as it is.
    """
    fields = ("version", "candidate_template", "verifier_template", "confirmed_threshold", "suspected_threshold")
    # one prompt is active at a time, so the default travels as constants instead of a join on a constant key
    found = prompts.where("active").select(*fields).limit(2).collect()
    if len(found) > 1:
        raise ValueError("CONFIGURATION_INVALID: more than one active prompt")
    default = found[0].asDict() if found else dict.fromkeys(fields)
    pinned = prompts.select(F.col("prompt_id").alias("prompt_version_id"), *[F.col(c).alias(f"p_{c}") for c in fields])
    joined = jobs.join(profiles, "model_profile_id", "left").join(pinned, "prompt_version_id", "left")

    def base(name: str, column: str) -> Column:
        return F.coalesce(
            F.col(f"snapshot.{name}"),
            F.when(F.col("prompt_version_id").isNotNull(), F.col(f"p_{column}")).otherwise(F.lit(default[column])))

    frozen = F.coalesce(F.length("snapshot.guidance_version"), F.lit(0)) > 0
    profile = F.coalesce("snapshot.analysis_profile", "analysis_profile")
    version = base("prompt_version", "version")

    def guided(column: Column) -> Column:
        return F.when(frozen, column).otherwise(with_guidance(column, profile))

    return joined.select(
        "job_id", profile.alias("analysis_profile"),
        F.coalesce("snapshot.candidate_model", "candidate_model").alias("candidate_model"),
        F.coalesce("snapshot.verifier_model", "verifier_model").alias("verifier_model"),
        F.when(frozen, version).otherwise(scoped_prompt_version(version, profile)).alias("prompt_version"),
        guided(base("candidate_prompt", "candidate_template")).alias("candidate_prompt"),
        guided(base("verifier_prompt", "verifier_template")).alias("verifier_prompt"),
        base("confirmed_threshold", "confirmed_threshold").alias("confirmed_threshold"),
        base("suspected_threshold", "suspected_threshold").alias("suspected_threshold"),
        F.coalesce(F.when(frozen, F.col("snapshot.guidance_version")), F.lit(K.GUIDANCE_VERSION)).alias("guidance_version"),
    )


def reference_flag(df: DataFrame, scope: dict | None) -> DataFrame:
    """``reference_profile``: true only inside an active evaluation scope, for a reference model."""
    if scope is None:
        return df.withColumn("reference_profile", F.lit(False))
    inside = (
        F.col("is_reference") & (F.col("analysis_profile") == scope["analysis_profile"])
        & (F.col("char_count") <= scope["max_chars"]) & (F.col("prompt_version") == scope["prompt_version"])
        & (F.col("analyzer_version") == scope["analyzer_version"])
    )
    return df.withColumn("reference_profile", F.coalesce(inside, F.lit(False)))


_PASSES: dict[str, Callable[[Iterable[pd.DataFrame]], Iterator[pd.DataFrame]]] = {}


def register_pass(name: str, fn: Callable[[Iterable[pd.DataFrame]], Iterator[pd.DataFrame]]) -> None:
    """Register batch inference: a mapInPandas function from requests to (doc_id, chunk_index, content) rows."""
    _PASSES[name] = fn


def run_pass(name: str, requests: DataFrame, slots: int | None = None) -> DataFrame:
    """Run a registered pass; ``slots`` bounds how many model callers run at once."""
    spread = requests.repartition(slots) if slots else requests
    return spread.mapInPandas(_PASSES[name], "doc_id bigint, chunk_index int, content string")
