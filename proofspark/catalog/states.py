"""Queries over job, document, chunk and report state at a fixed moment."""

from __future__ import annotations

from pyspark.sql import functions as F

from proofspark import constants as K
from proofspark.catalog import sql as S
from proofspark.catalog.text import longs
from proofspark.operators import lifecycle as L
from proofspark.plans import fixtures as X
from proofspark.session import scratch_dir
from proofspark.sources import tables as T

Q, O = {}, {}


def registered(fn):
    Q[fn.__name__] = fn
    return fn


def _state(jobs):
    return longs(jobs.select("job_id", "status", "stage", "worker_id", F.unix_seconds("lease_until").alias("lease_until"),
                             F.unix_seconds("completed_at").alias("completed_at"), "error_code"))


_T = S.AS_OF
_SEL = "epoch(lease_until)::BIGINT AS lease_until, epoch(completed_at)::BIGINT AS completed_at, error_code"


def _state_sql(source: str) -> str:
    return f"SELECT job_id, status, stage, worker_id, {_SEL} FROM {source}"


@registered
def expired_queue(spark, d):
    return _state(L.expire_queued(X.jobs(spark, d), X.as_of()))


O["expired_queue"] = S.with_plain(S.JOBS, f"""
x AS (SELECT *, status = 'queued' AND timeout_at <= {_T} AS due FROM jobs),
y AS (SELECT job_id, CASE WHEN due THEN 'failed' ELSE status END AS status, CASE WHEN due THEN 'failed' ELSE stage END AS stage, CASE WHEN NOT due THEN worker_id END AS worker_id,
  CASE WHEN NOT due THEN lease_until END AS lease_until, CASE WHEN due THEN {_T} ELSE completed_at END AS completed_at, CASE WHEN due THEN 'JOB_TIMEOUT' ELSE error_code END AS error_code FROM x)""",
    select=_state_sql("y"))


@registered
def recovered_leases(spark, d):
    return _state(L.recover_leases(X.jobs(spark, d), X.as_of()))


O["recovered_leases"] = S.with_plain(S.JOBS, f"""
x AS (SELECT *, status IN {S.RUNNING} AND lease_until < {_T} AND timeout_at > {_T} AS lost, (status = 'queued' OR status IN {S.RUNNING}) AND timeout_at <= {_T} AS late FROM jobs),
y AS (SELECT job_id, CASE WHEN lost THEN 'queued' WHEN late THEN 'failed' ELSE status END AS status, CASE WHEN lost THEN 'queued' WHEN late THEN 'failed' ELSE stage END AS stage,
  CASE WHEN NOT lost THEN worker_id END AS worker_id, CASE WHEN NOT lost AND NOT late THEN lease_until END AS lease_until, CASE WHEN late THEN {_T} ELSE completed_at END AS completed_at,
  CASE WHEN lost THEN 'WORKER_LEASE_EXPIRED' WHEN late THEN 'JOB_TIMEOUT' ELSE error_code END AS error_code FROM (SELECT * REPLACE (coalesce(lost, false) AS lost, coalesce(late, false) AS late) FROM x))""",
    select=_state_sql("y"))


def _docs(df):
    return df.select("doc_id", "has_text", F.unix_seconds("input_expires_at").alias("input_expires_at"))


def _purged_chunks(spark, d, job_ids):
    """All stored chunks after those of the given jobs were emptied in their table; jobs of one range share a partition."""
    path = scratch_dir(spark, "stored-chunks")
    X.stored_chunks(spark, d).withColumn("part", F.floor(F.col("job_id") / 4096)).repartition("part").write.partitionBy("part").parquet(path)
    T.purge_stored(job_ids, path, "part", L.CHUNK_PAYLOAD)
    return spark.read.parquet(path).drop("part")


@registered
def finalized_cancellations(spark, d):
    return _state(L.finalize_cancelled(X.jobs(spark, d), X.stored_documents(spark, d), X.as_of())[0])


_DUE = f"due AS (SELECT * FROM jobs WHERE status = 'cancel_requested' AND (lease_until IS NULL OR lease_until < {_T}))"
O["finalized_cancellations"] = S.with_plain(S.JOBS, _DUE, f"""
y AS (SELECT job_id, CASE WHEN hit THEN 'cancelled' ELSE status END AS status, CASE WHEN hit THEN 'cancelled' ELSE stage END AS stage, worker_id, CASE WHEN NOT hit THEN lease_until END AS lease_until,
  CASE WHEN hit THEN {_T} ELSE completed_at END AS completed_at, CASE WHEN hit THEN 'JOB_CANCELLED' ELSE error_code END AS error_code FROM (SELECT *, job_id IN (SELECT job_id FROM due) AS hit FROM jobs))""",
    select=_state_sql("y"))


@registered
def cancelled_documents(spark, d):
    return _docs(L.finalize_cancelled(X.jobs(spark, d), X.stored_documents(spark, d), X.as_of())[1])


O["cancelled_documents"] = S.with_plain(S.STORED, S.JOBS, _DUE, select=f"""
SELECT doc_id, text IS NOT NULL AND doc_id NOT IN (SELECT document_id FROM due) AS has_text,
 epoch(CASE WHEN doc_id IN (SELECT document_id FROM due) THEN CASE WHEN storage_path IS NOT NULL THEN {_T} END ELSE input_expires_at END)::BIGINT AS input_expires_at FROM stored""")


@registered
def cancelled_chunks(spark, d):
    out = _purged_chunks(spark, d, L.finalize_cancelled(X.jobs(spark, d), X.stored_documents(spark, d), X.as_of())[2])
    return longs(out.select("job_id", "chunk_index", "content", "candidate_output", "verifier_output"))


O["cancelled_chunks"] = S.with_plain(S.JOBS, _DUE, S.STORED_CHUNKS, """
gone AS (SELECT job_id FROM due UNION SELECT job_id FROM jobs WHERE status = 'cancelled')""", select="""
SELECT c.job_id, chunk_index, CASE WHEN g.job_id IS NULL THEN content END AS content, CASE WHEN g.job_id IS NULL THEN candidate_output END AS candidate_output,
 CASE WHEN g.job_id IS NULL THEN verifier_output END AS verifier_output FROM stored_chunks c LEFT JOIN gone g ON g.job_id = c.job_id""")


def _cancel_requests(spark, d):
    k = F.col("job_id")
    return X.jobs(spark, d).select(k, F.when(k % 14 == 0, F.lit(-1)).otherwise(F.col("user_id")).alias("user_id"))


@registered
def cancel_outcomes(spark, d):
    return L.apply_cancels(X.jobs(spark, d), _cancel_requests(spark, d), X.as_of())[1]


O["cancel_outcomes"] = S.with_plain(S.JOBS, select=f"""
SELECT job_id, CASE WHEN job_id % 14 = 0 THEN -1 ELSE user_id END AS user_id, CASE WHEN job_id % 14 = 0 THEN 'not_found' WHEN status IN ('queued','cancelled') THEN 'finalized'
 WHEN status = 'cancel_requested' OR status IN {S.RUNNING} THEN 'requested' ELSE 'conflict' END AS outcome FROM jobs""")


@registered
def cancelled_jobs(spark, d):
    return _state(L.apply_cancels(X.jobs(spark, d), _cancel_requests(spark, d), X.as_of())[0])


O["cancelled_jobs"] = S.with_plain(S.JOBS, f"""
x AS (SELECT *, job_id % 14 <> 0 AND status = 'queued' AS q, job_id % 14 <> 0 AND status IN {S.RUNNING} AS r FROM jobs),
y AS (SELECT job_id, CASE WHEN q THEN 'cancelled' WHEN r THEN 'cancel_requested' ELSE status END AS status, CASE WHEN q THEN 'cancelled' WHEN r THEN 'cancel_requested' ELSE stage END AS stage, worker_id,
  CASE WHEN NOT q THEN lease_until END AS lease_until, CASE WHEN q THEN {_T} ELSE completed_at END AS completed_at, CASE WHEN q THEN 'JOB_CANCELLED' ELSE error_code END AS error_code FROM x)""",
    select=_state_sql("y"))

_BUSY = f"""
busy AS (SELECT DISTINCT document_id FROM jobs WHERE status NOT IN {S.TERMINAL}),
live AS (SELECT DISTINCT document_id FROM reports r JOIN jobs j USING (job_id) WHERE r.expires_at > {_T}),
retryable AS (SELECT DISTINCT doc_id FROM stored JOIN jobs ON document_id = doc_id WHERE status = 'failed' AND storage_path IS NOT NULL AND input_expires_at > {_T})"""


@registered
def documents_with_active_jobs(spark, d):
    return L.docs_with_active_jobs(X.stored_documents(spark, d), X.jobs(spark, d)).select("doc_id")


O["documents_with_active_jobs"] = S.with_plain(S.STORED, S.JOBS, S.REPORTS, _BUSY, select="SELECT doc_id FROM stored WHERE doc_id IN (SELECT document_id FROM busy)")


@registered
def documents_with_live_reports(spark, d):
    return L.docs_with_live_reports(X.stored_documents(spark, d), X.jobs(spark, d), X.reports(spark, d), X.as_of()).select("doc_id")


O["documents_with_live_reports"] = S.with_plain(S.STORED, S.JOBS, S.REPORTS, _BUSY, select="SELECT doc_id FROM stored WHERE doc_id IN (SELECT document_id FROM live)")


def _idle_jobs(spark, d):
    """Jobs without the running ones, so that some documents are free."""
    return X.jobs(spark, d).withColumn("status", F.when(
        F.col("document_id") % 3 != 0, F.when(F.col("status").isin(K.TERMINAL), F.col("status")).otherwise("completed")).otherwise(F.col("status")))


_IDLE = S.JOBS.replace("jobs AS (", "jobs1 AS (") + f""",
jobs AS (SELECT * REPLACE (CASE WHEN document_id % 3 <> 0 AND status NOT IN {S.TERMINAL} THEN 'completed' ELSE status END AS status) FROM jobs1)"""


@registered
def releasable_documents(spark, d):
    return L.releasable_sources(X.stored_documents(spark, d), _idle_jobs(spark, d), X.reports(spark, d), X.as_of()).select("doc_id")


O["releasable_documents"] = S.with_plain(S.STORED, _IDLE, S.REPORTS, _BUSY, select="""
SELECT doc_id FROM stored WHERE doc_id NOT IN (SELECT document_id FROM busy) AND doc_id NOT IN (SELECT document_id FROM live) AND doc_id NOT IN (SELECT doc_id FROM retryable)""")


@registered
def expired_inputs(spark, d):
    return _docs(L.expire_inputs(X.stored_documents(spark, d), _idle_jobs(spark, d), X.reports(spark, d), X.as_of())[0])


O["expired_inputs"] = S.with_plain(S.STORED, _IDLE, S.REPORTS, _BUSY, f"""
x AS (SELECT *, coalesce(input_expires_at < {_T}, false) AND doc_id NOT IN (SELECT document_id FROM busy) AS due FROM stored)""", select="""
SELECT doc_id, text IS NOT NULL AND NOT (due AND doc_id NOT IN (SELECT document_id FROM live)) AS has_text,
 epoch(CASE WHEN NOT (due AND storage_path IS NULL) THEN input_expires_at END)::BIGINT AS input_expires_at FROM x""")


@registered
def expired_chunks(spark, d):
    out = _purged_chunks(spark, d, L.expire_inputs(X.stored_documents(spark, d), _idle_jobs(spark, d), X.reports(spark, d), X.as_of())[1])
    return longs(out.select("job_id", "chunk_index", "content"))


O["expired_chunks"] = S.with_plain(S.STORED, _IDLE, S.REPORTS, _BUSY, S.STORED_CHUNKS, f"""
due AS (SELECT doc_id FROM stored WHERE input_expires_at < {_T} AND doc_id NOT IN (SELECT document_id FROM busy))""", select="""
SELECT c.job_id, chunk_index, CASE WHEN document_id NOT IN (SELECT doc_id FROM due) THEN content END AS content FROM stored_chunks c JOIN jobs j USING (job_id)""")


@registered
def cleanup_targets(spark, d):
    return L.cleanup_targets(X.stored_documents(spark, d), _idle_jobs(spark, d), X.reports(spark, d), X.as_of())


O["cleanup_targets"] = S.with_plain(S.STORED, _IDLE, S.REPORTS, _BUSY, select=f"""
SELECT 'document' AS kind, doc_id AS target_id FROM stored WHERE input_expires_at < {_T} AND storage_path IS NOT NULL AND doc_id NOT IN (SELECT document_id FROM busy)
UNION ALL SELECT 'report', report_id FROM reports WHERE expires_at < {_T}""")


def _report_sweep(spark, d):
    return L.expire_reports(X.reports(spark, d), X.jobs(spark, d), X.stored_documents(spark, d), X.as_of())


@registered
def expired_report_jobs(spark, d):
    return _report_sweep(spark, d)[1].select("job_id", "status", "stage", "report_id")


_GONE = f"gone AS (SELECT job_id FROM reports WHERE expires_at < {_T})"
O["expired_report_jobs"] = S.with_plain(S.JOBS, S.REPORTS, _GONE, select="""
SELECT job_id, CASE WHEN x THEN 'expired' ELSE status END AS status, CASE WHEN x THEN 'expired' ELSE stage END AS stage, CASE WHEN NOT x THEN report_id END AS report_id
FROM (SELECT *, job_id IN (SELECT job_id FROM gone) AND status = 'completed' AS x FROM jobs)""")


@registered
def expired_report_chunks(spark, d):
    return longs(_purged_chunks(spark, d, _report_sweep(spark, d)[3]).select("job_id", "chunk_index", "content"))


O["expired_report_chunks"] = S.with_plain(S.JOBS, S.REPORTS, _GONE, S.STORED_CHUNKS, select="""
SELECT job_id, chunk_index, CASE WHEN job_id NOT IN (SELECT job_id FROM gone) THEN content END AS content FROM stored_chunks""")


@registered
def kept_reports(spark, d):
    return _report_sweep(spark, d)[0].select("report_id")


O["kept_reports"] = S.with_plain(S.REPORTS, select=f"SELECT report_id FROM reports WHERE expires_at >= {_T}")


@registered
def report_released_documents(spark, d):
    out = L.expire_reports(X.reports(spark, d), _idle_jobs(spark, d), X.stored_documents(spark, d), X.as_of())[2]
    return out.select("doc_id", "has_text")


O["report_released_documents"] = S.with_plain(S.STORED, _IDLE, S.REPORTS, _BUSY, _GONE, """
touched AS (SELECT DISTINCT document_id FROM jobs JOIN gone USING (job_id))""", select="""
SELECT doc_id, NOT (doc_id IN (SELECT document_id FROM touched) AND doc_id NOT IN (SELECT document_id FROM busy) AND doc_id NOT IN (SELECT document_id FROM live)
 AND doc_id NOT IN (SELECT doc_id FROM retryable)) AS has_text FROM stored""")


def _finished(spark, d):
    k = F.col("job_id")
    return X.jobs(spark, d).select(
        k, F.when(k % 15 == 0, F.lit(-1)).otherwise(F.col("user_id")).alias("user_id"),
        F.when(k % 21 == 0, "thief").otherwise(F.col("worker_id")).alias("worker_id"), (k + 1_000_000).alias("report_id"))


def _completion(spark, d):
    return L.apply_completion(_finished(spark, d), X.jobs(spark, d), X.stored_documents(spark, d), X.as_of())


@registered
def completed_jobs(spark, d):
    return longs(_completion(spark, d)[0].select("job_id", "status", "progress", "report_id", F.unix_seconds("lease_until").alias("lease_until"), "error_code"))


_DONE = """
fin AS (SELECT *, job_id % 15 <> 0 AND job_id % 21 <> 0 AND worker_id IS NOT NULL AND status IN ('analyzing','verifying','merging','rendering') AS done FROM jobs)"""
O["completed_jobs"] = S.with_plain(S.JOBS, _DONE, select="""
SELECT job_id, CASE WHEN done THEN 'completed' ELSE status END AS status, CASE WHEN done THEN 100 ELSE progress END AS progress, CASE WHEN done THEN job_id + 1000000 ELSE report_id END AS report_id,
 epoch(CASE WHEN NOT done THEN lease_until END)::BIGINT AS lease_until, CASE WHEN NOT done THEN error_code END AS error_code FROM fin""")


@registered
def completion_rejects(spark, d):
    return _completion(spark, d)[3].select("job_id", "error_code")


O["completion_rejects"] = S.with_plain(S.JOBS, select="""
SELECT job_id, CASE WHEN job_id % 15 = 0 OR job_id % 21 = 0 OR worker_id IS NULL THEN 'CONFLICT' WHEN status IN ('cancel_requested','cancelled') THEN 'JOB_CANCELLED' ELSE 'CONFLICT' END AS error_code
FROM jobs WHERE job_id % 15 = 0 OR job_id % 21 = 0 OR worker_id IS NULL OR status NOT IN ('analyzing','verifying','merging','rendering')""")


@registered
def completed_documents(spark, d):
    return _docs(_completion(spark, d)[1])


O["completed_documents"] = S.with_plain(S.STORED, S.JOBS, _DONE, select=f"""
SELECT doc_id, text IS NOT NULL AS has_text, epoch(CASE WHEN doc_id IN (SELECT document_id FROM fin WHERE done) THEN CASE WHEN storage_path IS NOT NULL THEN {_T} END ELSE input_expires_at END)::BIGINT AS input_expires_at FROM stored""")


@registered
def eligible_requests(spark, d):
    """Orders as requests; documents of re-queued jobs are taken already."""
    k = F.col("o_orderkey")
    document = X.document_of(spark, d, k)
    reqs = X.table(spark, d, "orders").select(k.alias("request_id"), document.alias("document_id"), (document % 150).alias("user_id"),
                                              (k % 25).cast("int").alias("model_profile_id"))
    jobs = X.jobs(spark, d).where("status = 'queued' AND error_code IS NOT NULL")
    n = F.col("n_nationkey")
    profiles = X.table(spark, d, "nation").select(
        n.alias("model_profile_id"), F.when(n % 5 == 0, n.cast("bigint")).alias("owner_id"), (n % 4 != 0).alias("enabled"))
    return L.eligible_submissions(reqs, X.stored_documents(spark, d), jobs, profiles, X.as_of()).select("request_id")


O["eligible_requests"] = S.with_plain(S.STORED, S.JOBS, select=f"""
SELECT o_orderkey AS request_id FROM orders JOIN stored ON doc_id = o_orderkey % {S.DOCUMENTS} JOIN nation ON n_nationkey = o_orderkey % 25
WHERE storage_path IS NOT NULL AND input_expires_at > {_T} AND doc_id NOT IN (SELECT document_id FROM jobs WHERE status = 'queued' AND error_code IS NOT NULL) AND n_nationkey % 4 <> 0 AND (n_nationkey % 5 <> 0 OR n_nationkey = doc_id % 150)""")


@registered
def retried_jobs(spark, d):
    out = L.retry_jobs(X.jobs(spark, d), X.stored_documents(spark, d), X.as_of())
    return longs(out.select("job_id", "status", "progress", "completed_chunks", F.unix_seconds("timeout_at").alias("timeout_at"), "worker_id", "error_code"))


O["retried_jobs"] = S.with_plain(S.STORED, S.JOBS, select=f"""
SELECT job_id, 'queued' AS status, 0::BIGINT AS progress, 0::BIGINT AS completed_chunks, epoch({_T} + INTERVAL 120 MINUTES)::BIGINT AS timeout_at, NULL::VARCHAR AS worker_id, NULL::VARCHAR AS error_code
FROM jobs JOIN stored ON doc_id = document_id WHERE status = 'failed' AND storage_path IS NOT NULL AND input_expires_at > {_T}""")


@registered
def next_jobs(spark, d):
    return L.next_eligible(X.jobs(spark, d), X.as_of(), 25).select("job_id")


O["next_jobs"] = S.with_plain(S.JOBS, select=f"SELECT job_id FROM jobs WHERE status = 'queued' AND timeout_at > {_T} ORDER BY created_at, job_id LIMIT 25")


@registered
def remaining_time(spark, d):
    return X.jobs(spark, d).select("job_id", L.remaining_seconds(F.col("timeout_at"), X.as_of()).alias("seconds"))


O["remaining_time"] = S.with_plain(S.JOBS, select=f"SELECT job_id, greatest(0, epoch(timeout_at) - epoch({_T}))::BIGINT AS seconds FROM jobs")


@registered
def chunk_progress(spark, d):
    return L.chunk_progress(X.stored_chunks(spark, d))


O["chunk_progress"] = S.with_plain(S.STORED_CHUNKS, select="""
SELECT job_id, count(*) AS total_chunks, count(*) FILTER (status = 'completed') AS completed_chunks, 10 + count(*) FILTER (status = 'completed') * 75 // count(*) AS progress FROM stored_chunks GROUP BY job_id""")


@registered
def deletion_plans(spark, d):
    jobs = X.jobs(spark, d).withColumn("user_id", F.col("document_id") % 50)
    reports = X.reports(spark, d).withColumn("user_id", X.document_of(spark, d, F.col("job_id")) % 50)
    k = F.col("job_id")
    targets = (
        jobs.select(F.lit("analysis").alias("kind"), k.alias("target_id"), "user_id")
        .unionByName(reports.select(F.lit("report").alias("kind"), F.col("report_id").alias("target_id"), "user_id"))
        .unionByName(X.documents(spark, d).select(F.lit("document").alias("kind"), F.col("doc_id").alias("target_id"), (F.col("doc_id") % 50).alias("user_id"))))
    return L.deletion_plan(targets, jobs, reports)


O["deletion_plans"] = S.with_plain(S.JOBS.replace("jobs AS (", "jobs1 AS ("), "jobs AS (SELECT * REPLACE (document_id % 50 AS user_id) FROM jobs1)", S.REPORTS, f"""
rep AS (SELECT r.report_id, r.job_id, j.document_id FROM reports r JOIN jobs j USING (job_id)),
t AS (SELECT 'analysis' AS kind, job_id AS target_id, user_id, document_id, job_id AS sel FROM jobs
  UNION ALL SELECT 'report', report_id, document_id % 50, document_id, job_id FROM rep UNION ALL SELECT 'document', doc_id, doc_id % 50, doc_id, NULL FROM documents),
f AS (SELECT document_id, count(*) AS n, bool_or(status NOT IN {S.TERMINAL}) AS blocked, count(*) FILTER (status = 'failed') AS failed FROM jobs GROUP BY 1),
g AS (SELECT document_id, count(*) AS n FROM rep GROUP BY 1)""", select="""
SELECT kind, target_id, t.user_id, t.document_id, coalesce(f.n, 0) AS jobs, coalesce(g.n, 0) AS reports, CASE WHEN kind = 'document' THEN coalesce(g.n, 0) ELSE (r.job_id IS NOT NULL)::BIGINT END AS selected_reports,
 coalesce(f.blocked, false) AS blocked, kind = 'document' OR NOT (coalesce(f.failed, 0) > (coalesce(j.status, '') = 'failed')::INT OR coalesce(g.n, 0) > (r.job_id IS NOT NULL)::INT) AS delete_source
FROM t LEFT JOIN f USING (document_id) LEFT JOIN g USING (document_id) LEFT JOIN jobs j ON j.job_id = t.sel LEFT JOIN rep r ON r.job_id = t.sel""")


@registered
def changed_ids(spark, d):
    k = F.col("o_orderkey")
    o = X.table(spark, d, "orders").select(k)
    return L.ids_unchanged(o.select((k * 2).alias("id")), o.select((k * 3).alias("id")))


O["changed_ids"] = """
(SELECT id, 'vanished' AS change FROM (SELECT o_orderkey * 2 AS id FROM orders EXCEPT ALL SELECT o_orderkey * 3 FROM orders))
UNION ALL (SELECT id, 'appeared' FROM (SELECT o_orderkey * 3 AS id FROM orders EXCEPT ALL SELECT o_orderkey * 2 FROM orders))"""


@registered
def progress_log(spark, d):
    """Changes per job up to its first terminal status."""
    out = L.progress_changes(X.status_events(X.table(spark, d, "events")))
    return longs(out.select("job_id", "event_id", "status", "progress"))


O["progress_log"] = S.with_plain(S.STATUS_EVENTS, f"""
x AS (SELECT *, max((status IN {S.TERMINAL})::INT) OVER (PARTITION BY job_id ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS ended,
  lag(status || progress) OVER (PARTITION BY job_id ORDER BY ts, event_id) AS was FROM status_events)""", select="""
SELECT job_id, event_id, status, progress FROM x WHERE coalesce(ended, 0) = 0 AND was IS DISTINCT FROM status || progress""")


@registered
def login_pressure(spark, d):
    out = L.login_pressure(X.attempts(spark, d), window_minutes=15)
    return out.select("attempt_id", "failures", "blocked")


O["login_pressure"] = S.with_plain(S.ATTEMPTS, select="""
SELECT a.attempt_id, count(b.attempt_id) AS failures, count(b.attempt_id) >= 5 AS blocked FROM attempts a LEFT JOIN attempts b ON NOT b.success AND b.attempted_at < a.attempted_at
 AND b.attempted_at > a.attempted_at - INTERVAL 15 MINUTES AND (lower(b.username) = lower(a.username) OR b.ip = a.ip) GROUP BY a.attempt_id""")


@registered
def trimmed_attempts(spark, d):
    return L.trim_log(X.attempts(spark, d), "attempted_at", 24, F.lit("2024-01-15 00:00:00").cast("timestamp")).select("attempt_id")


O["trimmed_attempts"] = S.with_plain(S.ATTEMPTS, select="SELECT attempt_id FROM attempts WHERE attempted_at >= TIMESTAMP '2024-01-14 00:00:00'")

QUERIES, ORACLES = Q, O
