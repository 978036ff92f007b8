"""Operational figures over jobs, usage and retention."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from proofspark import constants as K
from proofspark.operators.lifecycle import seconds_between

ACTIVE = [*K.RUNNING, "cancel_requested"]


def _one_row(left: DataFrame, right: DataFrame) -> DataFrame:
    """Two one-row frames side by side, without a join."""
    stacked = left.unionByName(right, allowMissingColumns=True)
    return stacked.agg(*[F.max(c).alias(c) for c in stacked.columns])


def system_status(jobs: DataFrame, reports: DataFrame, as_of: Column) -> DataFrame:
    counted = jobs.agg(
        F.count_if(F.col("status") == "queued").alias("queued_jobs"),
        F.count_if(F.col("status").isin(ACTIVE)).alias("active_jobs"),
        F.count_distinct(F.when(F.col("lease_until") > as_of, F.col("worker_id"))).alias("active_workers"),
        F.count_if((F.col("status") == "failed") & (F.col("completed_at") >= as_of - F.expr("INTERVAL 24 HOURS"))).alias("failed_jobs_24h"),
    )
    return _one_row(counted, reports.agg(F.count_if(F.col("expires_at") > as_of).alias("retained_reports")))


def jobs_by_status(jobs: DataFrame) -> DataFrame:
    return jobs.groupBy("status").agg(F.count(F.lit(1)).alias("jobs"))


def oldest_queue(jobs: DataFrame, as_of: Column) -> DataFrame:
    oldest = F.min(F.when(F.col("status") == "queued", F.col("created_at")))
    return jobs.agg(F.greatest(F.coalesce(seconds_between(as_of, oldest), F.lit(0)), F.lit(0)).cast("bigint").alias("oldest_queue_seconds"))


def stage_age(jobs: DataFrame, as_of: Column) -> DataFrame:
    started = F.min(F.coalesce("started_at", "created_at"))
    return jobs.where(F.col("status").isin(ACTIVE)).groupBy("stage").agg(
        F.greatest(seconds_between(as_of, started), F.lit(0)).cast("bigint").alias("oldest_seconds"))


def model_calls(usage: DataFrame) -> DataFrame:
    return usage.groupBy("pass", "success").agg(F.count(F.lit(1)).alias("calls"))


def model_duration(usage: DataFrame) -> DataFrame:
    """Total duration per pass, successful or not."""
    return usage.groupBy("pass").agg(F.coalesce(F.sum("duration_ms"), F.lit(0)).alias("duration_ms"))


def model_retries(usage: DataFrame) -> DataFrame:
    return usage.agg(F.coalesce(F.sum(F.greatest(F.col("attempt") - 1, F.lit(0))), F.lit(0)).cast("bigint").alias("retries"))


def cleanup_backlog(docs: DataFrame, reports: DataFrame, as_of: Column) -> DataFrame:
    pending_docs = docs.agg(F.count_if(F.col("storage_path").isNotNull() & (F.col("input_expires_at") < as_of)).alias("pending"))
    pending_reports = reports.agg(F.count_if(F.col("expires_at") < as_of).alias("pending"))
    return pending_docs.select(F.lit("document").alias("kind"), "pending").unionByName(
        pending_reports.select(F.lit("report").alias("kind"), "pending"))


def usage_rollup(usage: DataFrame) -> DataFrame:
    """Calls, tokens, duration and failures per provider, model and pass, with subtotals."""
    return usage.rollup("provider_kind", "model", "pass").agg(
        F.count(F.lit(1)).alias("calls"), F.sum("prompt_tokens").alias("prompt_tokens"),
        F.sum("completion_tokens").alias("completion_tokens"), F.sum("duration_ms").alias("duration_ms"),
        F.count_if(~F.col("success")).alias("failures"),
    ).withColumn("failure_rate", F.col("failures").cast("double") / F.col("calls"))


def usage_by_job(usage: DataFrame) -> DataFrame:
    return usage.groupBy("job_id", "model", "pass").agg(
        F.count(F.lit(1)).alias("calls"), F.sum("prompt_tokens").alias("prompt_tokens"),
        F.sum("duration_ms").alias("duration_ms"), F.count_if(~F.col("success")).alias("failures"))


def ops_alerts(
    jobs: DataFrame, usage: DataFrame, as_of: Column, queue_minutes: int = 10, failure_rate: float = 0.05,
    retry_rate: float = 0.05, p95_minutes: int = 60, timeout_minutes: int = K.JOB_TIMEOUT_MINUTES,
) -> DataFrame:
    """One row of figures with a flag per alert; rates count as bursts above the given share."""
    elapsed = F.when(F.col("completed_at").isNotNull(), F.unix_seconds("completed_at") - F.unix_seconds("created_at"))
    a = jobs.agg(
        F.coalesce(seconds_between(as_of, F.min(F.when(F.col("status") == "queued", F.col("created_at")))), F.lit(0)).alias("oldest_wait_seconds"),
        F.count_if(F.col("status") == "failed").alias("failed"), F.count_if(F.col("status").isin(K.TERMINAL)).alias("ended"),
        F.count_if(F.col("error_code") == "WORKER_LEASE_EXPIRED").alias("lease_recoveries"),
        F.percentile(elapsed, F.lit(0.95)).alias("p95_seconds"))
    b = usage.agg(F.count_if(F.col("attempt") > 1).alias("retried"), F.count(F.lit(1)).alias("calls"))
    return _one_row(a, b).select(
        "oldest_wait_seconds", "failed", "ended", "lease_recoveries", "p95_seconds", "retried", "calls",
        (F.col("oldest_wait_seconds") > queue_minutes * 60).alias("queue_alert"),
        (F.col("failed") > F.col("ended") * failure_rate).alias("failure_alert"),
        (F.col("retried") > F.col("calls") * retry_rate).alias("retry_alert"),
        (F.col("lease_recoveries") != 0).alias("lease_alert"),
        F.coalesce(F.col("p95_seconds") > p95_minutes * 60, F.lit(False)).alias("duration_alert"),
        F.coalesce(F.col("p95_seconds") > timeout_minutes * 60 * 0.9, F.lit(False)).alias("timeout_alert"),
    )


def feedback_stats(issues: DataFrame, feedback: DataFrame) -> DataFrame:
    """Verdict counts per category; no source text leaves."""
    per_issue = feedback.groupBy("issue_id", "verdict").agg(F.count(F.lit(1)).alias("n"))
    return issues.select("issue_id", "category").join(per_issue, "issue_id").groupBy("category").pivot(
        "verdict", K.FEEDBACK_VERDICTS).agg(F.sum("n")).na.fill(0)


def reference_version(evidence: DataFrame) -> DataFrame:
    """Fingerprint of the active reference works; the dimension is small by nature."""
    entries = F.array_sort(F.collect_list(F.struct("id", "revision")))
    text = F.array_join(F.transform(entries, lambda e: F.concat(e["id"], F.char(F.lit(0)), e["revision"], F.char(F.lit(0)))), "")
    return evidence.where("active").agg(F.concat(F.lit("sha256:"), F.sha2(text, 256)).alias("reference_version"))
