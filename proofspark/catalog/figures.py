"""Queries for operational figures."""

from __future__ import annotations

from pyspark.sql import functions as F

from proofspark import constants as K
from proofspark.catalog import sql as S
from proofspark.operators import ops
from proofspark.operators.lifecycle import error_codes
from proofspark.plans import fixtures as X

Q, O = {}, {}


def registered(fn):
    Q[fn.__name__] = fn
    return fn


_T = S.AS_OF
_ACTIVE = "('extracting','analyzing','verifying','merging','rendering','cancel_requested')"


@registered
def system_status(spark, d):
    return ops.system_status(X.jobs(spark, d), X.reports(spark, d), X.as_of())


O["system_status"] = S.with_plain(S.JOBS, S.REPORTS, select=f"""
SELECT count(*) FILTER (status = 'queued') AS queued_jobs, count(*) FILTER (status IN {_ACTIVE}) AS active_jobs, count(DISTINCT worker_id) FILTER (lease_until > {_T}) AS active_workers,
 count(*) FILTER (status = 'failed' AND completed_at >= {_T} - INTERVAL 24 HOURS) AS failed_jobs_24h, (SELECT count(*) FROM reports WHERE expires_at > {_T}) AS retained_reports FROM jobs""")


@registered
def jobs_by_status(spark, d):
    return ops.jobs_by_status(X.jobs(spark, d))


O["jobs_by_status"] = S.with_plain(S.JOBS, select="SELECT status, count(*) AS jobs FROM jobs GROUP BY status")


@registered
def oldest_queue(spark, d):
    return ops.oldest_queue(X.jobs(spark, d), X.as_of())


O["oldest_queue"] = S.with_plain(S.JOBS, select=f"SELECT coalesce(round(epoch({_T}) - epoch(min(created_at))), 0)::BIGINT AS oldest_queue_seconds FROM jobs WHERE status = 'queued'")


@registered
def stage_age(spark, d):
    return ops.stage_age(X.jobs(spark, d), X.as_of())


O["stage_age"] = S.with_plain(S.JOBS, select=f"""
SELECT stage, greatest(round(epoch({_T}) - epoch(min(coalesce(started_at, created_at)))), 0)::BIGINT AS oldest_seconds FROM jobs WHERE status IN {_ACTIVE} GROUP BY stage""")


@registered
def model_calls(spark, d):
    return ops.model_calls(X.usage(spark, d))


O["model_calls"] = S.with_plain(S.USAGE, select="SELECT pass, success, count(*) AS calls FROM usage GROUP BY ALL")


@registered
def model_duration(spark, d):
    return ops.model_duration(X.usage(spark, d))


O["model_duration"] = S.with_plain(S.USAGE, select="SELECT pass, sum(duration_ms)::BIGINT AS duration_ms FROM usage GROUP BY ALL")


@registered
def model_retries(spark, d):
    return ops.model_retries(X.usage(spark, d))


O["model_retries"] = S.with_plain(S.USAGE, select="SELECT sum(greatest(attempt - 1, 0))::BIGINT AS retries FROM usage")


@registered
def cleanup_backlog(spark, d):
    return ops.cleanup_backlog(X.stored_documents(spark, d), X.reports(spark, d), X.as_of())


O["cleanup_backlog"] = S.with_plain(S.STORED, S.REPORTS, select=f"""
SELECT 'document' AS kind, count(*) AS pending FROM stored WHERE storage_path IS NOT NULL AND input_expires_at < {_T} UNION ALL SELECT 'report', count(*) FROM reports WHERE expires_at < {_T}""")


@registered
def usage_rollup(spark, d):
    return ops.usage_rollup(X.usage(spark, d))


O["usage_rollup"] = S.with_plain(S.USAGE, select="""
SELECT provider_kind, model, pass, count(*) AS calls, sum(prompt_tokens)::BIGINT AS prompt_tokens, sum(completion_tokens)::BIGINT AS completion_tokens, sum(duration_ms)::BIGINT AS duration_ms,
 count(*) FILTER (NOT success) AS failures, count(*) FILTER (NOT success)::DOUBLE / count(*) AS failure_rate FROM usage GROUP BY ROLLUP (provider_kind, model, pass)""")


@registered
def usage_by_job(spark, d):
    return ops.usage_by_job(X.usage(spark, d))


O["usage_by_job"] = S.with_plain(S.USAGE, select="""
SELECT job_id, model, pass, count(*) AS calls, sum(prompt_tokens)::BIGINT AS prompt_tokens, sum(duration_ms)::BIGINT AS duration_ms, count(*) FILTER (NOT success) AS failures FROM usage GROUP BY ALL""")


@registered
def ops_alerts(spark, d):
    return ops.ops_alerts(X.jobs(spark, d), X.usage(spark, d), X.as_of())


O["ops_alerts"] = S.with_plain(S.JOBS, S.USAGE, f"""
a AS (SELECT coalesce(round(epoch({_T}) - epoch(min(created_at) FILTER (status = 'queued'))), 0)::BIGINT AS oldest_wait_seconds, count(*) FILTER (status = 'failed') AS failed,
  count(*) FILTER (status IN {S.TERMINAL}) AS ended, count(*) FILTER (error_code = 'WORKER_LEASE_EXPIRED') AS lease_recoveries,
  quantile_cont((epoch(completed_at) - epoch(created_at)), 0.95) AS p95_seconds FROM jobs),
b AS (SELECT count(*) FILTER (attempt > 1) AS retried, count(*) AS calls FROM usage)""", select="""
SELECT *, oldest_wait_seconds > 600 AS queue_alert, failed > ended * 0.05 AS failure_alert, retried > calls * 0.05 AS retry_alert, lease_recoveries <> 0 AS lease_alert,
 p95_seconds > 3600 AS duration_alert, p95_seconds > 6480 AS timeout_alert FROM a, b""")


@registered
def feedback_stats(spark, d):
    i = X.line_issues(spark, d)
    return ops.feedback_stats(i, i.where("feedback is not null").select("issue_id", F.col("feedback").alias("verdict")))


O["feedback_stats"] = S.with_plain(S.LINE_ISSUES, select="""
SELECT category, count(*) FILTER (feedback = 'correct') AS correct, count(*) FILTER (feedback = 'incorrect') AS incorrect, count(*) FILTER (feedback = 'disputed') AS disputed
FROM iss WHERE feedback IS NOT NULL GROUP BY category""")


@registered
def reference_fingerprint(spark, d):
    """Nations as reference works; a third of them inactive."""
    n = F.col("n_nationkey")
    works = X.table(spark, d, "nation").select(F.col("n_name").alias("id"), F.concat(F.lit("r"), n.cast("string")).alias("revision"), (n % 3 != 0).alias("active"))
    return ops.reference_version(works)


O["reference_fingerprint"] = """
SELECT 'sha256:' || sha256(string_agg(n_name || chr(0) || 'r' || n_nationkey || chr(0), '' ORDER BY n_name)) AS reference_version FROM nation WHERE n_nationkey % 3 <> 0"""


@registered
def reject_codes(spark, d):
    """How often each known error code occurs on the jobs; codes without a job show zero."""
    jobs = X.jobs(spark, d).select(X.pick(K.ERROR_CODES[8:16], F.col("job_id")).alias("error_code")).groupBy("error_code").agg(F.count(F.lit(1)).alias("jobs"))
    return error_codes(spark).select("error_code").join(jobs, "error_code", "left").na.fill(0, ["jobs"])


O["reject_codes"] = f"""
SELECT c AS error_code, count(o_orderkey) AS jobs FROM (SELECT unnest({S._list(K.ERROR_CODES)}) AS c, unnest(range(0, 20)) AS i) LEFT JOIN orders ON i BETWEEN 8 AND 15 AND o_orderkey % 8 = i - 8 GROUP BY c"""

QUERIES, ORACLES = Q, O
