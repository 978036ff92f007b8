"""Job, document, chunk and report state as of a given moment."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from proofspark import constants as K
from proofspark.operators.payloads import stored_candidates_ok, stored_verdicts_ok

def minutes(n: int) -> Column:
    return F.expr(f"INTERVAL {int(n)} MINUTES")


def seconds_between(later: Column, earlier: Column) -> Column:
    """Whole seconds, rounded to the nearest like the operational counters."""
    return F.round(F.unix_micros(later) / 1e6 - F.unix_micros(earlier) / 1e6).cast("bigint")


def error_codes(spark) -> DataFrame:
    return spark.createDataFrame([(i, c) for i, c in enumerate(K.ERROR_CODES)], "code_no int, error_code string")


def _patch(df: DataFrame, changes: dict[str, Column]) -> DataFrame:
    return df.select(*[changes[c].cast(df.schema[c].dataType).alias(c) if c in changes else c for c in df.columns])


def _when(condition: Column, values: dict[str, Column], df: DataFrame) -> DataFrame:
    condition = F.coalesce(condition, F.lit(False))
    return _patch(df, {c: F.when(condition, v).otherwise(F.col(c)) for c, v in values.items() if c in df.columns})


def remaining_seconds(timeout_at: Column, as_of: Column) -> Column:
    return F.greatest(F.lit(0), F.floor((F.unix_micros(timeout_at) - F.unix_micros(as_of)) / 1_000_000)).cast("bigint")


def expire_queued(jobs: DataFrame, as_of: Column) -> DataFrame:
    """A queued job past its deadline fails."""
    return _when((F.col("status") == "queued") & (F.col("timeout_at") <= as_of), {
        "status": F.lit("failed"), "stage": F.lit("failed"), "completed_at": as_of, "worker_id": F.lit(None),
        "lease_until": F.lit(None), "error_code": F.lit("JOB_TIMEOUT")}, jobs)


def recover_leases(jobs: DataFrame, as_of: Column) -> DataFrame:
    """A lost lease re-queues the job while its deadline is ahead; past the deadline it fails."""
    requeued = _when(
        F.col("status").isin(K.RUNNING) & (F.col("lease_until") < as_of) & (F.col("timeout_at") > as_of),
        {"status": F.lit("queued"), "stage": F.lit("queued"), "worker_id": F.lit(None), "lease_until": F.lit(None),
         "error_code": F.lit("WORKER_LEASE_EXPIRED")}, jobs)
    return _when(F.col("status").isin("queued", *K.RUNNING) & (F.col("timeout_at") <= as_of), {
        "status": F.lit("failed"), "stage": F.lit("failed"), "lease_until": F.lit(None), "completed_at": as_of,
        "error_code": F.lit("JOB_TIMEOUT")}, requeued)


#: Columns of a stored chunk that retention empties; see ``purge_stored``.
CHUNK_PAYLOAD = ["content", "candidate_output", "verifier_output"]


def _cancelled(as_of: Column) -> dict[str, Column]:
    return {"status": F.lit("cancelled"), "stage": F.lit("cancelled"), "lease_until": F.lit(None),
            "completed_at": as_of, "error_code": F.lit("JOB_CANCELLED")}


def heads(docs: DataFrame) -> DataFrame:
    """Documents without their text; ``has_text`` tells whether there is one. Retention moves only these rows."""
    return docs.withColumn("has_text", F.col("text").isNotNull()).drop("text") if "text" in docs.columns else docs


def _change_heads(docs: DataFrame, marked: DataFrame, changes: dict[str, Column]) -> DataFrame:
    """Heads with some columns replaced; the marks that were joined to them are dropped."""
    return marked.select(*[changes[c].cast(docs.schema[c].dataType).alias(c) if c in changes else c for c in docs.columns])


def finalize_cancelled(jobs: DataFrame, docs: DataFrame, as_of: Column) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(jobs, document heads, ids of jobs whose chunks go): a requested cancellation without a live lease is final."""
    due = (F.col("status") == "cancel_requested") & (F.col("lease_until").isNull() | (F.col("lease_until") < as_of))
    docs = heads(docs)
    after = _when(due, _cancelled(as_of), jobs)
    hit = jobs.where(due).select(F.col("document_id").alias("doc_id"), F.lit(True).alias("purge")).distinct()
    gone = F.coalesce("purge", F.lit(False))
    docs_after = _change_heads(docs, docs.join(hit, "doc_id", "left"), {
        "has_text": F.col("has_text") & ~gone,
        "input_expires_at": F.when(gone, F.when(F.col("storage_path").isNotNull(), as_of)).otherwise(F.col("input_expires_at"))})
    return after, docs_after, after.where("status = 'cancelled'").select("job_id")


def apply_cancels(jobs: DataFrame, requests: DataFrame, as_of: Column) -> tuple[DataFrame, DataFrame]:
    """(jobs after the cancel requests, outcome per request)."""
    asked = requests.select("job_id", "user_id").distinct()
    joined = asked.join(jobs.select("job_id", "user_id", "status"), ["job_id", "user_id"], "left")
    outcomes = joined.select("job_id", "user_id", F.when(F.col("status").isNull(), "not_found")
                             .when(F.col("status").isin("queued", "cancelled"), "finalized")
                             .when(F.col("status").isin("cancel_requested", *K.RUNNING), "requested")
                             .otherwise("conflict").alias("outcome"))
    marked = jobs.join(asked.withColumn("asked", F.lit(True)), ["job_id", "user_id"], "left")
    wanted = F.coalesce("asked", F.lit(False))
    finals = _when(wanted & (F.col("status") == "queued"), _cancelled(as_of), marked)
    after = _when(wanted & F.col("status").isin(K.RUNNING), {
        "status": F.lit("cancel_requested"), "stage": F.lit("cancel_requested")}, finals)
    return after.select(*jobs.columns), outcomes


def docs_with_active_jobs(docs: DataFrame, jobs: DataFrame) -> DataFrame:
    busy = jobs.where(~F.col("status").isin(K.TERMINAL)).select(F.col("document_id").alias("doc_id")).distinct()
    return docs.join(busy, "doc_id", "left_semi")


def docs_with_live_reports(docs: DataFrame, jobs: DataFrame, reports: DataFrame, as_of: Column) -> DataFrame:
    live = reports.where(F.col("expires_at") > as_of).join(jobs.select("job_id", "document_id"), "job_id")
    return docs.join(live.select(F.col("document_id").alias("doc_id")).distinct(), "doc_id", "left_semi")


def releasable_sources(docs: DataFrame, jobs: DataFrame, reports: DataFrame, as_of: Column) -> DataFrame:
    """Documents whose text nobody needs: no active job, no failed job that may be retried, no unexpired report."""
    idle = docs.join(docs_with_active_jobs(docs.select("doc_id"), jobs), "doc_id", "left_anti")
    retryable = docs.where(F.col("storage_path").isNotNull() & (F.col("input_expires_at") > as_of)).select("doc_id").join(
        jobs.where("status = 'failed'").select(F.col("document_id").alias("doc_id")).distinct(), "doc_id", "left_semi")
    live = docs_with_live_reports(docs.select("doc_id"), jobs, reports, as_of)
    return idle.join(retryable, "doc_id", "left_anti").join(live, "doc_id", "left_anti")


def expire_inputs(docs: DataFrame, jobs: DataFrame, reports: DataFrame, as_of: Column) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(document heads, ids of jobs whose chunks go, cleanup targets): busy documents wait, reported texts stay."""
    docs = heads(docs)
    due = docs.where(F.col("input_expires_at") < as_of).select("doc_id", "storage_path")
    due = due.join(docs_with_active_jobs(due.select("doc_id"), jobs), "doc_id", "left_anti")
    live = docs_with_live_reports(docs.select("doc_id"), jobs, reports, as_of).withColumn("live", F.lit(True))
    marked = docs.join(due.select("doc_id", F.lit(True).alias("due")), "doc_id", "left").join(live, "doc_id", "left")
    is_due = F.coalesce("due", F.lit(False))
    after = _change_heads(docs, marked, {
        "has_text": F.col("has_text") & ~(is_due & F.col("live").isNull()),
        "input_expires_at": F.when(~(is_due & F.col("storage_path").isNull()), F.col("input_expires_at"))})
    due_jobs = jobs.join(due.select(F.col("doc_id").alias("document_id")), "document_id", "left_semi").select("job_id")
    targets = due.where(F.col("storage_path").isNotNull()).select(F.lit("document").alias("kind"), F.col("doc_id").alias("target_id"))
    return after, due_jobs, targets


def expire_reports(
    reports: DataFrame, jobs: DataFrame, docs: DataFrame, as_of: Column
) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """(reports, jobs, document heads, ids of jobs whose chunks go) after report expiry."""
    docs = heads(docs)
    expired = reports.where(F.col("expires_at") < as_of).select("job_id", F.lit(True).alias("gone")).distinct()
    kept = reports.where(~F.coalesce(F.col("expires_at") < as_of, F.lit(False)))
    marked = jobs.join(expired, "job_id", "left")
    after = _when(F.col("gone") & (F.col("status") == "completed"), {
        "status": F.lit("expired"), "stage": F.lit("expired"), "report_id": F.lit(None)}, marked)
    touched = after.where("gone")
    jobs_after = after.select(*jobs.columns)
    free = releasable_sources(docs, jobs_after, kept, as_of).select("doc_id").join(
        touched.select(F.col("document_id").alias("doc_id")).distinct(), "doc_id", "left_semi").withColumn("free", F.lit(True))
    docs_after = _change_heads(docs, docs.join(free, "doc_id", "left"), {"has_text": F.col("has_text") & F.col("free").isNull()})
    return kept, jobs_after, docs_after, touched.where("status = 'expired'").select("job_id")


def apply_completion(
    finished: DataFrame, jobs: DataFrame, docs: DataFrame, as_of: Column
) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """(jobs, document heads, ids of jobs whose chunks go, rejects) after finished reports.

    Reports come as (job_id, user_id, worker_id, report_id). Only the owning worker may complete, and only from a
    reporting state.
    """
    docs = heads(docs)
    looked = finished.join(
        jobs.select("job_id", "user_id", F.col("worker_id").alias("owner"), "status"), ["job_id", "user_id"], "left")
    verdict = (
        F.when(~F.coalesce(F.col("owner") == F.col("worker_id"), F.lit(False)), "CONFLICT")
        .when(F.col("status").isin("cancel_requested", "cancelled"), "JOB_CANCELLED")
        .when(~F.col("status").isin(K.REPORTABLE), "CONFLICT")
    )
    judged = looked.withColumn("error_code", verdict)
    rejects = judged.where(F.col("error_code").isNotNull()).select("job_id", "worker_id", "error_code")
    good = judged.where(F.col("error_code").isNull()).select("job_id", F.col("report_id").alias("new_report"))
    marked = jobs.join(good, "job_id", "left")
    done = F.col("new_report").isNotNull()
    after = _when(done, {
        "status": F.lit("completed"), "stage": F.lit("completed"), "progress": F.lit(100), "report_id": F.col("new_report"),
        "completed_at": as_of, "lease_until": F.lit(None), "error_code": F.lit(None)}, marked)
    doc_ids = after.where(done).select(F.col("document_id").alias("doc_id"), F.lit(True).alias("hit")).distinct()
    docs_after = _change_heads(docs, docs.join(doc_ids, "doc_id", "left"), {
        "input_expires_at": F.when(F.col("hit"), F.when(F.col("storage_path").isNotNull(), as_of)).otherwise(F.col("input_expires_at"))})
    return after.select(*jobs.columns), docs_after, good.select("job_id"), rejects


def trim_log(df: DataFrame, column: str, ttl_hours: int, as_of: Column) -> DataFrame:
    """Keep log rows younger than the retention time."""
    return df.where(F.col(column) >= as_of - F.expr(f"INTERVAL {int(ttl_hours)} HOURS"))


def eligible_submissions(reqs: DataFrame, docs: DataFrame, jobs: DataFrame, profiles: DataFrame, as_of: Column) -> DataFrame:
    """Requests for an owned, stored, unexpired, never analysed document with a usable model profile."""
    usable = docs.where(F.col("storage_path").isNotNull() & (F.col("input_expires_at") > as_of)).select(
        F.col("doc_id").alias("document_id"), "user_id")
    shared = profiles.where("enabled").select("model_profile_id", "owner_id")
    return (
        reqs.join(usable, ["document_id", "user_id"], "left_semi")
        .join(jobs.select("document_id").distinct(), "document_id", "left_anti")
        .join(shared, "model_profile_id").where(F.col("owner_id").isNull() | (F.col("owner_id") == F.col("user_id")))
        .drop("owner_id")
    )


def retry_jobs(jobs: DataFrame, docs: DataFrame, as_of: Column, timeout_minutes: int = K.JOB_TIMEOUT_MINUTES) -> DataFrame:
    """Failed jobs whose input still lives, reset to the queue with a fresh deadline."""
    alive = docs.where(F.col("storage_path").isNotNull() & (F.col("input_expires_at") > as_of)).select(
        F.col("doc_id").alias("document_id"))
    failed = jobs.where("status = 'failed'").join(alive, "document_id", "left_semi").select(*jobs.columns)
    return _when(F.lit(True), {
        "status": F.lit("queued"), "stage": F.lit("queued"), "progress": F.lit(0), "completed_chunks": F.lit(0),
        "error_code": F.lit(None), "worker_id": F.lit(None), "lease_until": F.lit(None), "timeout_at": as_of + minutes(timeout_minutes),
        "completed_at": F.lit(None)}, failed)


def next_eligible(jobs: DataFrame, as_of: Column, k: int = 1) -> DataFrame:
    """Oldest queued jobs that are still within their deadline."""
    return jobs.where((F.col("status") == "queued") & (F.col("timeout_at") > as_of)).orderBy("created_at", "job_id").limit(k)


def plan_reuse(new_chunks: DataFrame, stored: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(plan, surplus): per planned chunk ``reusable`` or ``pending``; stored indexes beyond the plan are surplus.

    ``stored`` has job_id, chunk_index, source_start, source_end, content, status, candidate_output, verifier_output.
    Outputs count only as lists of candidates and of verdicts of the exact member types. Contents are compared by digest, so no text crosses the shuffle.
    """
    planned = new_chunks.select("job_id", "chunk_index", "source_start", "source_end", F.sha2("text", 256).alias("digest"))
    old = stored.select(
        "job_id", "chunk_index", F.col("source_start").alias("o_start"), F.col("source_end").alias("o_end"),
        F.sha2("content", 256).alias("o_digest"),
        ((F.col("status") == "completed") & stored_candidates_ok(F.col("candidate_output"))
         & stored_verdicts_ok(F.col("verifier_output"))).alias("finished"))
    same = (
        (F.col("source_start") == F.col("o_start")) & (F.col("source_end") == F.col("o_end"))
        & (F.col("digest") == F.col("o_digest")) & F.col("finished"))
    plan = planned.join(old, ["job_id", "chunk_index"], "left").select(
        "job_id", "chunk_index", "source_start", "source_end",
        F.when(F.coalesce(same, F.lit(False)), "reusable").otherwise("pending").alias("plan"))
    planned_jobs = new_chunks.select("job_id").distinct()
    surplus = stored.join(planned_jobs, "job_id", "left_semi").join(
        new_chunks.select("job_id", "chunk_index"), ["job_id", "chunk_index"], "left_anti").select("job_id", "chunk_index")
    return plan, surplus


def chunk_progress(chunks: DataFrame) -> DataFrame:
    """Completed chunks and job progress, which runs from 10 to 85 while chunks finish."""
    counts = chunks.groupBy("job_id").agg(
        F.count(F.lit(1)).alias("total_chunks"), F.count_if(F.col("status") == "completed").alias("completed_chunks"))
    return counts.withColumn("progress", F.expr("10 + (completed_chunks * 75) div greatest(total_chunks, 1)"))


def deletion_plan(targets: DataFrame, jobs: DataFrame, reports: DataFrame) -> DataFrame:
    """What removing each target would do.

    ``targets``: kind (document, analysis, report), target_id, user_id. Gives the document, the related and selected
    jobs and reports, whether an unfinished job blocks it, and whether the source text may go.
    """
    by_job = jobs.select("job_id", "user_id", "document_id", "status")
    owned_reports = reports.join(by_job.select("job_id", "user_id", "document_id"), ["job_id", "user_id"]).select(
        "report_id", "job_id", "user_id", "document_id")
    docs = targets.where("kind = 'document'").select("*", F.col("target_id").alias("document_id"), F.lit(None).cast("bigint").alias("selected_job"))
    analyses = targets.where("kind = 'analysis'").join(
        by_job.select(F.col("job_id").alias("target_id"), "user_id", "document_id"), ["target_id", "user_id"]).withColumn(
        "selected_job", F.col("target_id"))
    by_report = targets.where("kind = 'report'").join(
        owned_reports.select(F.col("report_id").alias("target_id"), "user_id", "document_id", F.col("job_id").alias("selected_job")),
        ["target_id", "user_id"])
    keys = ["kind", "target_id", "user_id", "document_id", "selected_job"]
    found = docs.select(*keys).unionByName(analyses.select(*keys)).unionByName(by_report.select(*keys))
    scope = ["user_id", "document_id"]
    # per-document figures first, so the join carries one row per document instead of one per job and target
    job_facts = by_job.groupBy(*scope).agg(
        F.count(F.lit(1)).alias("jobs"), F.bool_or(~F.col("status").isin(K.TERMINAL)).alias("blocked"),
        F.count_if(F.col("status") == "failed").alias("failed_jobs"))
    report_facts = owned_reports.groupBy(*scope).agg(F.count(F.lit(1)).alias("reports"))
    mine = by_job.where("status = 'failed'").select(F.col("job_id").alias("selected_job"), F.lit(1).alias("own_failed"))
    own_reports = owned_reports.groupBy(F.col("job_id").alias("selected_job")).agg(F.count(F.lit(1)).alias("own_reports"))
    out = (
        found.join(job_facts, scope, "left").join(report_facts, scope, "left")
        .join(mine, "selected_job", "left").join(own_reports, "selected_job", "left")
        .na.fill(0, ["jobs", "failed_jobs", "reports", "own_failed", "own_reports"]).na.fill(False, ["blocked"])
    )
    others = (F.col("failed_jobs") > F.col("own_failed")) | (F.col("reports") > F.col("own_reports"))
    is_doc = F.col("kind") == "document"
    return out.select(
        "kind", "target_id", "user_id", "document_id", "jobs", "reports",
        F.when(is_doc, F.col("reports")).otherwise(F.col("own_reports")).alias("selected_reports"), "blocked",
        (is_doc | ~others).alias("delete_source"))


def ids_unchanged(before: DataFrame, after: DataFrame) -> DataFrame:
    """Ids that appeared or vanished between two reads of the affected set; empty means stable."""
    return before.exceptAll(after).withColumn("change", F.lit("vanished")).unionByName(
        after.exceptAll(before).withColumn("change", F.lit("appeared")))


def cleanup_targets(docs: DataFrame, jobs: DataFrame, reports: DataFrame, as_of: Column) -> DataFrame:
    """Expired inputs that may go now and expired reports, tagged by kind."""
    _, _, inputs = expire_inputs(docs, jobs, reports, as_of)
    return inputs.unionByName(reports.where(F.col("expires_at") < as_of).select(
        F.lit("report").alias("kind"), F.col("report_id").alias("target_id")))


def progress_changes(events: DataFrame) -> DataFrame:
    """Status events that differ from the one before; nothing behind a terminal status."""
    by_job = W.partitionBy("job_id").orderBy("ts", "event_id")
    earlier = by_job.rowsBetween(W.unboundedPreceding, -1)
    signature = F.struct("status", "stage", "progress", "completed_chunks")
    return (
        events.withColumn("ended", F.coalesce(F.max(F.col("status").isin(K.TERMINAL)).over(earlier), F.lit(False)))
        .withColumn("same", F.coalesce(F.lag(signature).over(by_job) == signature, F.lit(False)))
        .where("not ended and not same").drop("ended", "same")
    )


def login_pressure(attempts: DataFrame, limit: int = 5, window_minutes: int = 15) -> DataFrame:
    """For every attempt the failures of the same user or address strictly within the window before it.

    Failures per user, per address and per both are running counts, combined by inclusion and exclusion. Every row
    also serves as history in the following time bucket, so a group spans two windows of time however hot its key is.
    """
    span = window_minutes * 60 * 1_000_000
    at = F.unix_micros("attempted_at")
    rows = (
        attempts.withColumn("user_key", F.lower("username")).withColumn("at", at)
        .withColumn("own", F.floor(F.col("at") / span))
        .select("*", F.explode(F.array(F.col("own"), F.col("own") + 1)).alias("bucket"))
    )
    failed = F.when(F.col("success"), 0).otherwise(1)

    def recent(*keys: str) -> Column:
        frame = W.partitionBy(*keys, "bucket").orderBy("at").rangeBetween(-span + 1, -1)
        return F.coalesce(F.sum(failed).over(frame), F.lit(0))

    # attempts without an address count by user only, so they never gather in one group of unknown addresses
    by_user = rows.withColumn("by_user", recent("user_key"))
    known = by_user.where("ip is not null").select("*", recent("ip").alias("by_ip"), recent("user_key", "ip").alias("by_both"))
    counted = known.unionByName(by_user.where("ip is null").select("*", F.lit(0).cast("bigint").alias("by_ip"), F.lit(0).cast("bigint").alias("by_both")))
    by_ip = F.col("by_ip") - F.col("by_both")
    return counted.where("bucket = own").select(
        *attempts.columns, (F.col("by_user") + by_ip).cast("bigint").alias("failures")
    ).withColumn("blocked", F.col("failures") >= limit)
