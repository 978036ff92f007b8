"""Streams over the given tables, run to the end of what is available."""

from __future__ import annotations

import os

from pyspark.sql import functions as F

from proofspark.catalog import sql as S
from proofspark.catalog.text import SEGMENTS, longs
from proofspark.plans import fixtures as X
from proofspark.plans.proofread import full_reports, proofread
from proofspark.operators.summary import summarize
from proofspark.session import scratch_dir
from proofspark.sources import tables as T
from proofspark.streaming import jobs as J, run as R

Q, O = {}, {}


def registered(fn):
    Q[fn.__name__] = fn
    return fn


def source(spark, d, name):
    """A table of the folder as a stream; the table is one file or a folder of files, which a pattern takes alike."""
    schema = X.table(spark, d, name).schema
    return spark.readStream.schema(schema).parquet(os.path.join(d, f"{{{name}.parquet}}"))


@registered
def streamed_progress(spark, d):
    out = R.collect_stream(J.stream_progress(X.status_events(source(spark, d, "events"))), "progress")
    return longs(out.select("job_id", "event_id", "status", "progress"))


O["streamed_progress"] = S.with_plain(S.STATUS_EVENTS, f"""
x AS (SELECT *, max((status IN {S.TERMINAL})::INT) OVER (PARTITION BY job_id ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS ended,
  lag(status || progress) OVER (PARTITION BY job_id ORDER BY ts, event_id) AS was FROM status_events)""", select="""
SELECT job_id, event_id, status, progress FROM x WHERE coalesce(ended, 0) = 0 AND was IS DISTINCT FROM status || progress""")


@registered
def streamed_lease_watch(spark, d):
    out = R.collect_stream(J.stream_lease_watch(X.status_events(source(spark, d, "events"))), "leases")
    return out.select("job_id", F.unix_seconds("ts").alias("at"), "alert")


#: Job by job, event by event, and what is still open by the last watermark.
O["streamed_lease_watch"] = S.with_recursive(S.STATUS_EVENTS, f"""
e AS (SELECT *, row_number() OVER (PARTITION BY job_id ORDER BY ts, event_id) AS i, count(*) OVER (PARTITION BY job_id) AS n FROM status_events),
r AS (SELECT job_id, i, n, ts AS seen, status, ts + INTERVAL 2 HOUR AS deadline, NULL::TIMESTAMP AS lost, NULL::TIMESTAMP AS late FROM e WHERE i = 1
  UNION ALL SELECT e.job_id, e.i, e.n, e.ts, e.status, CASE WHEN r.status IN {S.TERMINAL} OR r.deadline <= e.ts THEN e.ts + INTERVAL 2 HOUR ELSE r.deadline END,
    CASE WHEN r.status IN {S.RUNNING} AND r.seen + INTERVAL 2 MINUTE < least(r.deadline, e.ts) THEN r.seen + INTERVAL 2 MINUTE END,
    CASE WHEN r.status NOT IN {S.TERMINAL} AND r.deadline <= e.ts THEN r.deadline END
  FROM r JOIN e ON e.job_id = r.job_id AND e.i = r.i + 1),
open AS (SELECT *, (SELECT max(ts) - INTERVAL 10 MINUTE FROM status_events) AS mark FROM r WHERE i = n AND status NOT IN {S.TERMINAL})""", select=f"""
SELECT job_id, epoch_us(lost) // 1000000 AS at, 'lease_expired' AS alert FROM r WHERE lost IS NOT NULL
UNION ALL SELECT job_id, epoch_us(late) // 1000000, 'job_timeout' FROM r WHERE late IS NOT NULL
UNION ALL SELECT job_id, epoch_us(seen + INTERVAL 2 MINUTE) // 1000000, 'lease_expired' FROM open WHERE status IN {S.RUNNING} AND seen + INTERVAL 2 MINUTE < deadline AND seen + INTERVAL 2 MINUTE <= mark
UNION ALL SELECT job_id, epoch_us(deadline) // 1000000, 'job_timeout' FROM open WHERE deadline <= mark""")


def in_batches(spark, d, name, order, batches=6):
    """A table as a stream of so many batches, in the order of a column."""
    rows = X.table(spark, d, name)
    low, high = rows.agg(F.min(order.cast("double")), F.max(order.cast("double"))).first()
    path = scratch_dir(spark, f"{name}-batches")
    nth = F.least(F.floor((order.cast("double") - (low or 0.0)) * batches / max(1e-9, (high or 0.0) - (low or 0.0))), F.lit(batches - 1))
    for k in range(batches):
        rows.where(nth == k).coalesce(1).write.mode("append").parquet(path)
    return spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", 1).parquet(path)


@registered
def streamed_login_blocks(spark, d):
    """Failures of the same user or address before each attempt, and whether they block it, batch after batch."""
    out = R.stream_login_blocks(X.as_attempts(in_batches(spark, d, "events", F.col("event_id"))), scratch_dir(spark, "login-blocks"), delay="400 days", slice_minutes=2880, buckets=4)
    return out.select("attempt_id", "failures", "blocked")


O["streamed_login_blocks"] = S.with_plain(S.ATTEMPTS, select="""
SELECT a.attempt_id, count(b.attempt_id) AS failures, count(b.attempt_id) >= 5 AS blocked FROM attempts a LEFT JOIN attempts b ON NOT b.success AND b.attempted_at < a.attempted_at
 AND b.attempted_at > a.attempted_at - INTERVAL 15 MINUTES AND (lower(b.username) = lower(a.username) OR b.ip = a.ip) GROUP BY a.attempt_id""")


@registered
def streamed_logins(spark, d):
    attempts = source(spark, d, "events").select(
        F.concat(F.lit("User"), F.col("user_id").cast("string")).alias("username"),
        (F.col("event_type") != "error").alias("success"), F.col("ts").cast("timestamp").alias("attempted_at"))
    out = R.collect_stream(J.stream_login_pressure(attempts), "logins", "update", ["username", "window_start"])
    return out.select("username", F.unix_seconds("window_start").alias("window_start"), "failures")


O["streamed_logins"] = S.with_plain(S.ATTEMPTS, select="""
SELECT lower(username) AS username, (epoch(date_trunc('minute', attempted_at))::BIGINT - 60 * k) AS window_start, count(*) AS failures
FROM attempts, range(0, 15) t(k) WHERE NOT success GROUP BY ALL""")


@registered
def streamed_ops(spark, d):
    out = R.collect_stream(J.stream_ops(X.status_events(source(spark, d, "events"))), "ops", "update", ["window_start"])
    return out.withColumn("window_start", F.unix_seconds("window_start"))


O["streamed_ops"] = S.with_plain(S.STATUS_EVENTS, select="""
SELECT epoch(date_trunc('hour', ts))::BIGINT AS window_start, count(*) FILTER (status = 'queued') AS starts, count(*) FILTER (status = 'completed') AS completions,
 count(*) FILTER (status = 'failed') AS failures, count(*) AS events FROM status_events GROUP BY ALL""")


@registered
def streamed_usage(spark, d):
    e = source(spark, d, "events")
    usage = e.select(
        F.col("ts").cast("timestamp").alias("ts"), X.pick(["candidate", "verification", "repair"], F.col("event_id")).alias("pass"),
        (1 + F.col("event_id") % 4).cast("int").alias("attempt"), F.floor("value").cast("bigint").alias("duration_ms"))
    out = R.collect_stream(J.stream_usage(usage), "usage", "update", ["window_start", "pass"])
    return out.withColumn("window_start", F.unix_seconds("window_start")).withColumn("retries", F.col("retries").cast("bigint"))


O["streamed_usage"] = """
SELECT epoch(date_trunc('hour', ts))::BIGINT AS window_start, ['candidate','verification','repair'][event_id % 3 + 1] AS pass, count(*) AS calls, sum(event_id % 4)::BIGINT AS retries,
 sum(floor("value"))::BIGINT AS duration_ms FROM events GROUP BY ALL"""


def _requests(events):
    k = F.col("event_id")
    return events.select(
        k.alias("request_id"), F.col("ts").cast("timestamp").alias("ts"), "user_id", F.concat(F.lit("key-"), (k % 7).cast("string")).alias("idempotency_key"),
        (k % 7 + F.when(k % 10 == 0, 1).otherwise(0)).alias("document_id"), F.lit(1).alias("model_profile_id"), F.lit("general").alias("analysis_profile"))


_REQ = """
req AS (SELECT event_id AS request_id, ts, user_id, 'key-' || event_id % 7 AS idempotency_key, event_id % 7 + CASE WHEN event_id % 10 = 0 THEN 1 ELSE 0 END AS document_id FROM events),
won AS (SELECT user_id, idempotency_key, arg_min(struct_pack(r := request_id, d := document_id), (ts, request_id)) AS w FROM req GROUP BY ALL)"""


@registered
def accepted_submissions(spark, d):
    accepted, _ = R.stream_submissions(_requests(source(spark, d, "events")), scratch_dir(spark, "submissions"))
    return accepted.select("user_id", "idempotency_key", "document_id", "request_id")


O["accepted_submissions"] = S.with_plain(_REQ, select="SELECT user_id, idempotency_key, w.d AS document_id, w.r AS request_id FROM won")


@registered
def conflicting_submissions(spark, d):
    _, conflicts = R.stream_submissions(_requests(source(spark, d, "events")), scratch_dir(spark, "submissions"))
    return conflicts.select("user_id", "idempotency_key", "document_id")


O["conflicting_submissions"] = S.with_plain(_REQ, select="""
SELECT DISTINCT user_id, idempotency_key, document_id FROM req JOIN won USING (user_id, idempotency_key) WHERE document_id <> w.d""")


@registered
def submissions_in_batches(spark, d):
    """The same keys over many batches: each looks up its own keys among all that came before."""
    accepted, conflicts = R.stream_submissions(_requests(in_batches(spark, d, "events", F.unix_micros(F.col("ts").cast("timestamp")))), scratch_dir(spark, "submissions"))
    some = ["user_id", "idempotency_key", "document_id"]
    return accepted.select(*some, F.lit(True).alias("accepted")).unionByName(conflicts.select(*some, F.lit(False).alias("accepted")))


O["submissions_in_batches"] = S.with_plain(_REQ, select="""
SELECT user_id, idempotency_key, w.d AS document_id, true AS accepted FROM won UNION ALL
SELECT DISTINCT user_id, idempotency_key, document_id, false FROM req JOIN won USING (user_id, idempotency_key) WHERE document_id <> w.d""")


@registered
def latest_feedback(spark, d):
    e = source(spark, d, "events").select(
        (F.col("event_id") % 50).alias("issue_id"), "user_id", F.col("ts").cast("timestamp").alias("updated_at"),
        F.when(F.col("event_type") == "click", "correct").when(F.col("event_type") == "view", "incorrect").otherwise("disputed").alias("verdict"))
    return R.stream_feedback(e, scratch_dir(spark, "feedback")).select("issue_id", "user_id", "verdict")


O["latest_feedback"] = """
SELECT event_id % 50 AS issue_id, user_id, arg_max(CASE event_type WHEN 'click' THEN 'correct' WHEN 'view' THEN 'incorrect' ELSE 'disputed' END, ts) AS verdict FROM events GROUP BY ALL"""


@registered
def streamed_intake(spark, d):
    """Documents as a stream to report summaries."""
    rules, evidence = X.rules(spark), X.evidence(spark)

    def reports(batch):
        docs = X.shaped(batch)
        return summarize(proofread(docs.select("doc_id", "analysis_profile", "text"), rules, evidence, X.arithmetic_verdicts), docs)

    return longs(R.stream_intake(source(spark, d, "documents").select("doc_id", "source", "text"), reports, scratch_dir(spark, "intake")))


O["streamed_intake"] = S.with_recursive(S.DOCS, S.CHUNKS, S.RULES, S.OCCURRENCES, S.ISSUES, select="""
SELECT d.doc_id, count(i.doc_id) AS total, count(*) FILTER (level = 'confirmed') AS confirmed, count(*) FILTER (level = 'suspected') AS suspected,
  count(*) FILTER (category = 'typo') AS typo, count(*) FILTER (category = 'punctuation') AS punctuation,
  count(*) FILTER (category = 'grammar') AS grammar, count(*) FILTER (category = 'paragraph') AS paragraph
FROM docs d LEFT JOIN issues i USING (doc_id) GROUP BY d.doc_id""")


@registered
def streamed_reports(spark, d):
    """Documents, each of them in two files, to complete stored reports with the lines of their issues."""
    path = scratch_dir(spark, "intake-files")
    docs = X.table(spark, d, "documents").select("doc_id", "source", "text")
    files = max(1, -(-docs.count() // X.PART_ROWS))  # a batch is a file, so there are no more batches as the input has more files
    for some in (docs.where("doc_id % 3 > 0"), docs.where("doc_id % 3 < 2")):
        some.repartition(files, "doc_id").write.mode("append").parquet(path)
    stream = spark.readStream.schema(docs.schema).option("maxFilesPerTrigger", 1).parquet(path)
    rules, evidence = X.rules(spark), X.evidence(spark)
    reports, intake = R.stream_reports(
        stream, lambda batch: full_reports(X.shaped(batch), rules, evidence, X.arithmetic_verdicts, F.lit("2001-08-02T00:00:00Z")), scratch_dir(spark, "intake"))
    issue = "array<struct<location:struct<line_start:bigint,line_end:bigint>>>"
    lines = F.from_json(F.get_json_object("content", "$.issues"), issue)
    of = lambda f: F.aggregate(lines, F.lit(0).cast("bigint"), lambda z, x: z + x["location"][f])
    repeats = intake.agg(F.sum("repeats")).first()[0]
    return reports.select(
        "doc_id", F.get_json_object("content", "$.summary.total").cast("bigint").alias("total"), F.get_json_object("content", "$.summary.confirmed").cast("bigint").alias("confirmed"),
        of("line_start").alias("line_starts"), of("line_end").alias("line_ends"), F.lit(repeats).cast("bigint").alias("repeats"))


O["streamed_reports"] = S.with_recursive(S.DOCS, S.CHUNKS, S.RULES, S.OCCURRENCES, S.ISSUES, SEGMENTS.replace("FROM documents", "FROM docs"), """
put AS (SELECT i.doc_id, i.level, i.char_start, i.char_end, min(g.line) AS a, max(g.line) AS z FROM issues i JOIN seg g ON g.doc_id = i.doc_id AND g.char_start < i.char_end AND g.char_end > i.char_start
  GROUP BY i.doc_id, i.level, i.char_start, i.char_end, i.category, i.grammar_subtype, i.suggestion, i.chunk_index, i.candidate_index)""", select="""
SELECT d.doc_id, count(put.doc_id) AS total, count(*) FILTER (level = 'confirmed') AS confirmed, coalesce(sum(a), 0)::BIGINT AS line_starts, coalesce(sum(z), 0)::BIGINT AS line_ends,
  (SELECT count(*) FILTER (doc_id % 3 = 1) FROM documents) AS repeats FROM docs d LEFT JOIN put USING (doc_id) WHERE regexp_matches(d.text, '\\S') GROUP BY d.doc_id""")


@registered
def swept_jobs(spark, d):
    out = R.sweep(X.jobs(spark, d), X.stored_documents(spark, d), X.reports(spark, d), X.as_of())
    return out["jobs"].groupBy("status", "error_code").agg(F.count(F.lit(1)).alias("jobs"))


O["swept_jobs"] = S.with_plain(S.JOBS, S.REPORTS, f"""
x AS (SELECT *, coalesce(status IN {S.RUNNING} AND lease_until < {S.AS_OF} AND timeout_at > {S.AS_OF}, false) AS lost, (status = 'queued' OR status IN {S.RUNNING}) AND timeout_at <= {S.AS_OF} AS late,
  status = 'cancel_requested' AND (lease_until IS NULL OR lease_until < {S.AS_OF}) AS cut, status = 'completed' AND job_id IN (SELECT job_id FROM reports WHERE expires_at < {S.AS_OF}) AS gone FROM jobs)""", select="""
SELECT CASE WHEN lost THEN 'queued' WHEN late THEN 'failed' WHEN cut THEN 'cancelled' WHEN gone THEN 'expired' ELSE status END AS status,
 CASE WHEN lost THEN 'WORKER_LEASE_EXPIRED' WHEN late THEN 'JOB_TIMEOUT' WHEN cut THEN 'JOB_CANCELLED' ELSE error_code END AS error_code, count(*) AS jobs FROM x GROUP BY ALL""")


@registered
def stored_reports(spark, d):
    """Complete reports stored, half of them twice, and read back."""
    issues = X.line_issues(spark, d)
    issues = issues.select(
        "*", F.lit("txt").alias("document_format"), *[F.lit(None).cast("int").alias(c) for c in
                                                    ("page", "page_end", "line_start", "line_end", "paragraph_index", "sentence_index")],
        F.repeat(F.lit("x"), F.col("char_end") - F.col("char_start")).alias("original_text"), F.lit("r").alias("reason"), F.lit("s").alias("suggestion"),
        F.array().cast("array<struct<source_id:string,title:string,revision:string,source_url:string>>").alias("evidence_refs"))
    k = F.col("o_orderkey")
    heads = X.table(spark, d, "orders").select(
        k.alias("doc_id"), k.cast("string").alias("report_id"), k.cast("string").alias("job_id"),
        F.struct(F.concat(k.cast("string"), F.lit(".txt")).alias("original_name"), F.lit("txt").alias("format"), F.lit(600).alias("char_count")).alias("document"),
        F.struct(F.lit("general").alias("analysis_profile"), F.lit("anthropic").alias("provider_kind")).alias("analysis"))
    reports = T.report_json(T.assemble_reports(heads, issues, F.lit("2001-08-02T00:00:00Z")))
    path = scratch_dir(spark, "stored-reports")
    T.write_reports(reports, path)
    T.write_reports(reports.where(F.col("doc_id") % 2 == 0), path)
    return T.stored_reports(spark, path).select("doc_id", F.get_json_object("content", "$.summary.total").cast("bigint").alias("total"),
                         F.get_json_object("content", "$.summary.grammar").cast("bigint").alias("grammar"),
                         F.get_json_object("content", "$.issues[0].id").alias("first_id"))


O["stored_reports"] = S.with_plain(S.LINE_ISSUES, select="""
SELECT o_orderkey AS doc_id, count(issue_id) AS total, count(*) FILTER (category = 'grammar') AS grammar, arg_min(issue_id, (char_start, char_end, issue_id)) AS first_id
FROM orders LEFT JOIN iss ON doc_id = o_orderkey GROUP BY o_orderkey""")


def _gold_lines(spark, d):
    i = X.line_issues(spark, d)
    k = F.col("doc_id")
    item = F.struct("category", "grammar_subtype", "char_start", (F.col("char_end") - F.when(F.col("sk") % 20 == 0, 1).otherwise(0)).alias("char_end"),
                    F.lit("kept").alias("note"))
    docs = i.groupBy("doc_id").agg(F.collect_list(item).alias("issues"))
    line = F.to_json(F.struct(F.concat(F.lit("doc-"), k.cast("string")).alias("document_id"), "issues", F.when(k % 41 == 0, "draft").alias("review_status")))
    return docs.select(line.alias("value"))


@registered
def gold_file_problems(spark, d):
    """Labels written as JSON lines and loaded strictly."""
    path = scratch_dir(spark, "gold")
    _gold_lines(spark, d).write.text(path)
    return T.read_gold(spark, path)[1]


O["gold_file_problems"] = S.with_plain(S.LINE_ISSUES, select="""
SELECT DISTINCT 'doc-' || doc_id AS document_id, 'malformed_line' AS problem FROM iss WHERE doc_id % 41 = 0
UNION ALL SELECT DISTINCT 'doc-' || doc_id, 'invalid_range' FROM iss WHERE doc_id % 41 <> 0 AND sk % 20 = 0""")


@registered
def gold_file_rows(spark, d):
    path = scratch_dir(spark, "gold")
    _gold_lines(spark, d).write.text(path)
    return T.read_gold(spark, path)[0].select("document_id", F.explode("issues").alias("i")).groupBy("document_id").agg(
        F.count(F.lit(1)).alias("issues"), F.sum("i.char_start").alias("starts"))


O["gold_file_rows"] = S.with_plain(S.LINE_ISSUES, select="""
SELECT 'doc-' || doc_id AS document_id, count(*) AS issues, sum(char_start)::BIGINT AS starts FROM iss WHERE doc_id % 41 <> 0 GROUP BY ALL""")


@registered
def usage_facts(spark, d):
    """Calls with and without a repair as append-only facts."""
    u = X.usage(spark, d)
    repair = F.struct("prompt_tokens", F.lit(None).cast("int").alias("completion_tokens"), (F.col("duration_ms") % 100).alias("duration_ms"))
    facts = T.usage_rows(u.withColumnRenamed("attempt", "attempts").withColumn("repair", F.when(F.col("attempts") == 3, repair)))
    return facts.groupBy("pass", "attempt", "success").agg(
        F.count(F.lit(1)).alias("rows"), F.sum("prompt_tokens").alias("prompt_tokens"), F.sum("duration_ms").alias("duration_ms")).withColumn(
        "attempt", F.col("attempt").cast("bigint"))


O["usage_facts"] = S.with_plain(S.USAGE, """
f AS (SELECT pass, attempt, success, prompt_tokens, duration_ms FROM usage UNION ALL SELECT 'repair', 1, true, prompt_tokens, duration_ms % 100 FROM usage WHERE attempt = 3)""", select="""
SELECT pass, attempt::BIGINT AS attempt, success, count(*) AS rows, sum(prompt_tokens)::BIGINT AS prompt_tokens, sum(duration_ms)::BIGINT AS duration_ms FROM f GROUP BY ALL""")

QUERIES, ORACLES = Q, O
