import os

import pytest
from pyspark.sql import functions as F

from proofspark.catalog.streams import Q as CATALOG
from proofspark.operators.lifecycle import progress_changes
from proofspark.plans import fixtures as X
from proofspark.streaming import jobs as J, run as R


@pytest.fixture
def daily(spark, sf_dir, tmp_path):
    """The events as ten files in time order."""
    events = X.table(spark, sf_dir, "events")
    path = str(tmp_path / "events")
    days = events.withColumn("day", F.floor((F.dayofmonth("ts") - 1) / 3))
    for day in range(10):
        days.where(F.col("day") == day).drop("day").coalesce(1).write.mode("append").parquet(path)
    return spark.readStream.schema(events.schema).option("maxFilesPerTrigger", 1).parquet(path)


def test_progress_in_many_batches_equals_batch(spark, sf_dir, daily):
    columns = ["job_id", "event_id", "status"]
    got = R.collect_stream(J.stream_progress(X.status_events(daily)), "p").select(*columns).collect()
    want = progress_changes(X.status_events(X.table(spark, sf_dir, "events"))).select(*columns).collect()
    assert sorted(map(tuple, got)) == sorted(map(tuple, want))


def test_windows_in_many_batches(spark, sf_dir, daily):
    got = R.collect_stream(J.stream_ops(X.status_events(daily)), "o", "update", ["window_start"])
    assert got.agg(F.sum("events")).first()[0] == X.table(spark, sf_dir, "events").count()


def test_feedback_in_many_batches(spark, sf_dir, daily, tmp_path):
    def shape(e):
        return e.select((F.col("event_id") % 20).alias("issue_id"), "user_id", F.col("ts").cast("timestamp").alias("updated_at"), F.col("event_type").alias("verdict"))

    got = R.stream_feedback(shape(daily), str(tmp_path / "fb"))
    want = shape(X.table(spark, sf_dir, "events")).groupBy("issue_id", "user_id").agg(F.max_by("verdict", "updated_at").alias("verdict"))
    assert sorted(map(tuple, got.select("issue_id", "user_id", "verdict").collect())) == sorted(map(tuple, want.collect()))


def source(spark, path, schema, *batches):
    os.makedirs(path)
    for i, rows in enumerate(batches):
        spark.createDataFrame(rows, schema).withColumn("ts", F.to_timestamp("t")).drop("t").coalesce(1).write.mode("append").parquet(path)
    full = spark.read.parquet(path).schema
    return spark.readStream.schema(full).option("maxFilesPerTrigger", 1).parquet(path)


def test_lease_watch(spark, tmp_path):
    schema = "job_id long, event_id long, t string, status string"
    stream = source(
        spark, str(tmp_path / "in"), schema,
        [(1, 1, "2024-01-01 00:00:00", "queued"), (1, 2, "2024-01-01 00:01:00", "analyzing"), (2, 3, "2024-01-01 00:00:00", "analyzing"),
         (2, 4, "2024-01-01 00:01:00", "completed"), (3, 5, "2024-01-01 00:00:00", "queued")],
        [(9, 6, "2024-01-01 00:30:00", "completed")], [(9, 7, "2024-01-01 05:00:00", "completed")], [(9, 8, "2024-01-01 06:00:00", "completed")])
    got = R.collect_stream(J.stream_lease_watch(stream), "l")
    assert sorted((r.job_id, str(r.ts), r.alert) for r in got.collect()) == [
        (1, "2024-01-01 00:03:00", "lease_expired"), (1, "2024-01-01 02:00:00", "job_timeout"), (3, "2024-01-01 02:00:00", "job_timeout")]


def test_submissions_across_batches(spark, tmp_path):
    schema = "request_id long, t string, user_id long, idempotency_key string, document_id long, model_profile_id int, analysis_profile string"
    stream = source(
        spark, str(tmp_path / "in"), schema,
        [(1, "2024-01-01 00:00:00", 1, "key-aaaa", 5, 1, "general"), (2, "2024-01-01 00:00:01", 1, "key-aaaa", 5, 1, "general")],
        [(3, "2024-01-01 00:10:00", 1, "key-aaaa", 5, 1, "general"), (4, "2024-01-01 00:11:00", 1, "key-aaaa", 6, 1, "general"),
         (5, "2024-01-01 00:12:00", 2, "key-aaaa", 6, 1, "general")],
        [(6, "2024-01-03 00:00:00", 1, "key-aaaa", 7, 1, "general")])
    accepted, conflicts = R.stream_submissions(stream, str(tmp_path / "out"))
    assert sorted(r.request_id for r in accepted.collect()) == [1, 5]
    assert sorted((r.user_id, r.document_id) for r in conflicts.collect()) == [(1, 6), (1, 7)]


def test_restart_continues_from_the_checkpoint(spark, sf_dir, tmp_path):
    events = X.table(spark, sf_dir, "events")
    path, root = str(tmp_path / "in"), str(tmp_path / "root")

    def run():
        stream = spark.readStream.schema(events.schema).parquet(path)
        return R.collect_stream(J.stream_progress(X.status_events(stream)), "r", root=root)

    events.where("event_id < 500").coalesce(1).write.parquet(path)
    first = run().count()
    assert run().count() == first
    events.where("event_id >= 500").coalesce(1).write.mode("append").parquet(path)
    assert run().count() == progress_changes(X.status_events(events)).count()


def test_intake_repeats_nothing(spark, tmp_path):
    path, root = str(tmp_path / "in"), str(tmp_path / "root")
    docs = spark.range(20).select(F.col("id").alias("doc_id"), F.lit("text").alias("text"))

    def run():
        stream = spark.readStream.schema(docs.schema).parquet(path)
        return R.stream_intake(stream, lambda b: b.select("doc_id", F.length("text").alias("n")), root)

    docs.where("doc_id < 10").write.parquet(path)
    assert run().count() == 10
    docs.where("doc_id >= 10").write.mode("append").parquet(path)
    assert run().count() == 20 and run().count() == 20


EVENTS = "job_id long, event_id long, t string, status string, stage string, progress int, completed_chunks int"


def test_ended_jobs_leave_the_state(spark, tmp_path):
    """Repeats and later rows of an ended job stay silent; after the keep time its state is gone, and the id starts anew."""
    def row(job, event, t, status, progress=None):
        return (job, event, f"2024-01-01 {t}", status, status, progress, 0)

    stream = source(
        spark, str(tmp_path / "in"), EVENTS,
        [row(1, 1, "00:00:00", "queued"), row(1, 2, "00:01:00", "analyzing", 5), row(1, 3, "00:02:00", "analyzing", 5), row(1, 4, "00:03:00", "completed", 100), row(1, 5, "00:04:00", "failed")],
        [row(1, 6, "00:30:00", "analyzing", 1), row(2, 7, "03:00:00", "completed")],
        [row(3, 8, "09:00:00", "completed")],
        [row(1, 9, "09:10:00", "queued"), row(1, 10, "00:05:00", "queued"), row(4, 11, "20:00:00", "completed")],
        [row(4, 12, "23:00:00", "completed")])
    root = str(tmp_path / "root")
    got = R.collect_stream(J.stream_progress(stream, keep_minutes=60), "p", root=root)
    assert sorted((r.job_id, r.event_id) for r in got.collect()) == [(1, 1), (1, 2), (1, 4), (1, 9), (2, 7), (3, 8), (4, 11)]
    kept = R.read_progress(spark, os.path.join(root, "progress"))
    assert kept.agg(F.sum("late_rows")).first()[0] == 1  # event 10
    again = J.stream_progress(spark.readStream.schema(spark.read.parquet(str(tmp_path / "in")).schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in")), keep_minutes=10**6)
    assert (1, 9) not in {(r.job_id, r.event_id) for r in R.collect_stream(again, "q").collect()}


def test_lease_watch_in_many_batches(spark, sf_dir, daily):
    """Alerts do not depend on how events are dealt out to batches, but for those still open at a later watermark."""
    whole = spark.readStream.schema(X.table(spark, sf_dir, "events").schema).option("pathGlobFilter", "events.parquet").parquet(sf_dir)
    rows = lambda s: sorted((r.job_id, str(r.ts), r.alert) for r in R.collect_stream(J.stream_lease_watch(X.status_events(s)), "l").collect())
    assert rows(daily) == rows(whole)


def test_lease_watch_equals_a_plain_loop(spark, tmp_path):
    import random
    from datetime import datetime, timedelta

    rng = random.Random(3)
    start, names = datetime(2024, 1, 1), ["queued", "analyzing", "verifying", "completed", "failed", "cancel_requested"]
    events = [(job, k, start + timedelta(seconds=rng.choice([30, 119, 120, 121, 600, 7200]) * rng.randint(1, 9)), rng.choice(names)) for k, job in enumerate(rng.choices(range(12), k=200))]
    stream = source(spark, str(tmp_path / "in"), "job_id long, event_id long, t string, status string", [(j, k, str(t), s) for j, k, t, s in events])
    mark, want = max(t for _, _, t, _ in events) - timedelta(minutes=10), []
    for job in range(12):
        seen = deadline = status = None
        for _, k, t, s in sorted((e for e in events if e[0] == job), key=lambda e: (e[2], e[1])):
            if status is not None:
                lost = seen + timedelta(minutes=2)
                if status in ("analyzing", "verifying") and lost < min(deadline, t):
                    want.append((job, str(lost), "lease_expired"))
                if deadline <= t and status not in ("completed", "failed"):
                    want.append((job, str(deadline), "job_timeout"))
                    status = "failed"
            if status in (None, "completed", "failed"):
                deadline = t + timedelta(hours=2)
            seen, status = t, s
        if status not in (None, "completed", "failed"):
            lost = seen + timedelta(minutes=2)
            if status in ("analyzing", "verifying") and lost < deadline and lost <= mark:
                want.append((job, str(lost), "lease_expired"))
            if deadline <= mark:
                want.append((job, str(deadline), "job_timeout"))
    got = sorted((r.job_id, str(r.ts), r.alert) for r in R.collect_stream(J.stream_lease_watch(stream), "l").collect())
    assert got == sorted(want)


def test_submissions_look_up_their_own_keys_only(spark, tmp_path):
    """No batch reads what earlier ones accepted: its plan has the batch's source and the state, and no table."""
    schema = "request_id long, t string, user_id long, idempotency_key string, document_id long, model_profile_id int, analysis_profile string"
    batches = [[(10 * b + k, f"2024-01-0{b + 1} 00:00:0{k}", k % 3, "hot" if k % 2 else f"k{b}", (b + k) % 2, 1, "general") for k in range(9)] for b in range(5)]
    stream = source(spark, str(tmp_path / "in"), schema, *batches, [(99, "2024-02-01 00:00:00", None, "x", 1, 1, "general"), (98, "2024-02-01 00:00:00", 1, None, 1, 1, "general")])
    root = str(tmp_path / "out")
    accepted, conflicts = R.stream_submissions(stream, root, buckets=4)
    owner, want = {}, set()
    for r in sorted((r for b in batches for r in b), key=lambda r: (r[1], r[0])):
        first = owner.setdefault((r[2], r[3]), r)
        if first[4] != r[4]:
            want.add((r[2], r[3], r[4]))
    assert {(r.user_id, r.idempotency_key, r.request_id) for r in accepted.collect()} == {(u, k, r[0]) for (u, k), r in owner.items()}
    assert {(r.user_id, r.idempotency_key, r.document_id) for r in conflicts.collect()} == want
    assert accepted.count() == len(owner)


def test_login_blocks_in_many_batches(spark, tmp_path):
    """Each attempt once, by user or address, also where one of them is unknown, and across batches."""
    import random
    from datetime import datetime, timedelta

    rng, start = random.Random(7), datetime(2024, 1, 1)
    rows = [(k, rng.choice(["Ann", "ann", "Bob", None]), rng.choice(["1", "2", None]), rng.random() < 0.3, start + timedelta(seconds=40 * k + rng.choice([0, 0, 11]))) for k in range(120)]
    path = str(tmp_path / "in")
    schema = "attempt_id long, username string, ip string, success boolean, attempted_at timestamp"
    for k in range(0, 120, 30):
        spark.createDataFrame(rows[k : k + 30], schema).coalesce(1).write.mode("append").parquet(path)
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(path)
    got = {r.attempt_id: (r.failures, r.blocked) for r in R.stream_login_blocks(stream, str(tmp_path / "out")).collect()}
    low = lambda x: x and x.lower()
    for k, user, ip, _, at in rows:
        before = [r for r in rows if not r[3] and at - timedelta(minutes=15) < r[4] < at and (user and low(r[1]) == low(user) or ip and r[2] == ip)]
        if user or ip:
            assert got[k] == (len(before), len(before) >= 5)


def test_reports_once_per_document(spark, tmp_path):
    path, root = str(tmp_path / "in"), str(tmp_path / "root")
    docs = spark.range(20).select(F.col("id").alias("doc_id"), F.lit("text").alias("text"))
    made = lambda b: b.select("doc_id", F.col("doc_id").cast("string").alias("job_id"), F.col("text").alias("content"))

    def run():
        stream = spark.readStream.schema(docs.schema).option("maxFilesPerTrigger", 1).parquet(path)
        return R.stream_reports(stream, made, root)

    docs.where("doc_id < 10").coalesce(1).write.parquet(path)
    docs.where("doc_id >= 5").coalesce(1).write.mode("append").parquet(path)
    reports, intake = run()
    assert reports.count() == 20 and sorted((r.documents, r.fresh, r.repeats) for r in intake.collect()) == [(10, 10, 0), (15, 10, 5)]
    docs.coalesce(1).write.mode("append").parquet(path)
    reports, intake = run()
    assert reports.count() == 20 and intake.agg(F.sum("repeats")).first()[0] == 25


@pytest.mark.parametrize("files", [1, 3])
def test_streams_read_tables_that_are_folders(spark, tmp_path, files):
    """A table may be a folder of files: all of them come through the stream."""
    docs = [(i, "the the end. 晨雾", "web") for i in range(9)]
    spark.createDataFrame(docs, "doc_id bigint, text string, source string").repartition(files).write.parquet(str(tmp_path / "documents.parquet"))
    out = CATALOG["streamed_intake"](spark, str(tmp_path)).collect()
    assert sorted(r["doc_id"] for r in out) == list(range(9))


def test_intake_of_an_empty_stream_has_no_rows(spark, tmp_path):
    spark.createDataFrame([], "doc_id bigint, text string").write.parquet(str(tmp_path / "in"))
    (tmp_path / "none").mkdir()
    stream = spark.readStream.schema("doc_id bigint, text string").parquet(str(tmp_path / "none"))
    out = R.stream_intake(stream, lambda batch: batch.select("doc_id"), str(tmp_path / "out"))
    assert out.columns == ["doc_id"] and out.count() == 0


def test_batches_of_reports_follow_the_rows(spark, tmp_path, monkeypatch):
    """Documents in many files are still two files of the stream, as long as these are small."""
    from proofspark.catalog import streams as C

    docs = spark.range(30).select(F.col("id").alias("doc_id"), F.lit("s").alias("source"), F.lit("A word. Another one.").alias("text"))
    docs.repartition(6).write.parquet(str(tmp_path / "documents.parquet"))
    taken, stream_reports = [], C.R.stream_reports

    def noted(*args):
        reports, intake = stream_reports(*args)
        taken.extend(intake.collect())
        return reports, intake

    monkeypatch.setattr(C.R, "stream_reports", noted)
    got = C.streamed_reports(spark, str(tmp_path)).collect()
    assert len(got) == 30 and {r.repeats for r in got} == {10}
    assert [r.documents for r in sorted(taken, key=lambda r: r.batch_id)] == [20, 20] and len(taken) == 2
