"""Driving streams into tables, and the sinks that merge."""

from __future__ import annotations

import os
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery
from pyspark.sql.types import LongType, StructType

from proofspark.operators import lifecycle as L
from proofspark.session import scratch_dir
from proofspark.sources.store import KeyedStore
from proofspark.streaming.jobs import PRESSURE, pressure_of, stream_recent_failures


def read_batches(spark: SparkSession, path: str, schema: StructType) -> DataFrame:
    """Rows of all finished batches with their batch_id; none before the first batch has made the folder."""
    full = StructType([*schema.fields]).add("batch_id", LongType())
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    if not folder.getFileSystem(spark._jsc.hadoopConfiguration()).exists(folder):
        return spark.createDataFrame([], full)
    return spark.read.schema(full).option("basePath", path).parquet(path)


def write_batch(df: DataFrame, batch_id: int, path: str) -> None:
    """A batch owns its folder, so a repeated batch replaces itself."""
    df.write.mode("overwrite").parquet(os.path.join(path, f"batch_id={batch_id}"))


#: Batches of one run whose progress is kept.
_REMEMBERED = ("spark.sql.streaming.numRecentProgressUpdates", "100000")
_PROVIDER = "spark.sql.streaming.stateStore.providerClass"
_ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def run_available(stream: DataFrame, sink: Callable[[DataFrame, int], None], checkpoint: str, mode: str = "append") -> StreamingQuery:
    """Process what is there, then stop; progress is kept in ``checkpoint``, keyed state outside the heap."""
    conf = stream.sparkSession.conf
    before = conf.get(_PROVIDER)
    conf.set(_PROVIDER, _ROCKSDB)
    conf.set(*_REMEMBERED)
    try:
        query = (
            stream.writeStream.outputMode(mode).option("checkpointLocation", checkpoint).trigger(availableNow=True)
            .foreachBatch(sink).start()
        )
        query.awaitTermination()
    finally:
        conf.set(_PROVIDER, before)
    return query


def collect_stream(stream: DataFrame, name: str, mode: str = "append", keys: list[str] | None = None, root: str | None = None) -> DataFrame:
    """Run a stream over the available data into a table; with ``keys`` the last update of each key counts.

    How many rows of each batch came too late is kept below ``root``/progress.
    """
    spark = stream.sparkSession
    root = root or scratch_dir(spark, name)
    out = os.path.join(root, "rows")
    query = run_available(stream, lambda df, batch_id: write_batch(df, batch_id, out), os.path.join(root, "checkpoint"), mode)
    write_progress(spark, query, os.path.join(root, "progress"))
    rows = read_batches(spark, out, stream.schema)
    if not keys:
        return rows.drop("batch_id")
    values = [c for c in stream.columns if c not in keys]
    last = rows.groupBy(*keys).agg(F.max_by(F.struct(*values), "batch_id").alias("v"))
    return last.select(*keys, *[F.col(f"v.{c}").alias(c) for c in values]).select(*stream.columns)


class FirstRequests(StatefulProcessor):
    """The first request of every (user, key) of one bucket: a map in the state store, where only a batch's own keys are looked up."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.owners = handle.getMapState("owners", "user_id bigint, idempotency_key string", "asked string")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        keys, order = ["user_id", "idempotency_key"], ["ts", "request_id"]
        distinct = None  # one row per distinct request, however often it is repeated
        for part in rows:
            both = part if distinct is None else pd.concat([distinct, part], ignore_index=True)
            distinct = both.sort_values(order, kind="stable").drop_duplicates([*keys, "asked"])
        first = distinct.drop_duplicates(keys)
        owners, fresh = {}, []
        for name, asked in zip(zip(*(first[k].tolist() for k in keys)), first["asked"]):
            known = self.owners.containsKey(name)
            fresh.append(not known)
            owners[name] = self.owners.getValue(name)[0] if known else asked
            if not known:
                self.owners.updateValue(name, (asked,))
        other = distinct[[owners[n] != a for n, a in zip(zip(*(distinct[k].tolist() for k in keys)), distinct["asked"])]]
        columns = [c for c in distinct.columns if c not in ("bucket", "asked")]
        yield pd.concat([first.loc[fresh, columns].assign(accepted=True), other[columns].assign(accepted=False)], ignore_index=True)

    def close(self) -> None:
        pass


def stream_submissions(requests: DataFrame, root: str, buckets: int = 256) -> tuple[DataFrame, DataFrame]:
    """(accepted, conflicts): the first request of a (user, key) wins, repeats vanish, different ones are flagged.

    A key is remembered for ever. The memory is state in ``buckets`` buckets, their number fixed for the life of a
    checkpoint: a batch touches its own keys only, whatever came before. Requests without a user or key are left out.
    """
    spark = requests.sparkSession
    accepted_path, conflict_path = os.path.join(root, "accepted"), os.path.join(root, "conflicts")
    keys = ["user_id", "idempotency_key"]
    asked = ["document_id", "model_profile_id", "analysis_profile"]
    schema = StructType([requests.schema[c] for c in [*keys, *asked, "ts", "request_id"]])
    rows = requests.dropna(subset=keys).select(
        F.pmod(F.xxhash64(*keys), F.lit(buckets)).alias("bucket"), *schema.names, F.to_json(F.struct(*asked), {"ignoreNullFields": "false"}).alias("asked"))
    judged = rows.groupBy("bucket").transformWithStateInPandas(FirstRequests(), StructType([*schema.fields]).add("accepted", "boolean"), "append", "none")

    def sink(batch: DataFrame, batch_id: int) -> None:
        batch.persist()
        write_batch(batch.where("not accepted").select(*keys, *asked), batch_id, conflict_path)
        write_batch(batch.where("accepted").drop("accepted"), batch_id, accepted_path)
        batch.unpersist()

    run_available(judged, sink, os.path.join(root, "checkpoint"))
    conflict_schema = StructType([requests.schema[c] for c in [*keys, *asked]])
    return (read_batches(spark, accepted_path, schema).drop("batch_id"),
            read_batches(spark, conflict_path, conflict_schema).drop("batch_id").distinct())


def stream_login_blocks(attempts: DataFrame, root: str, limit: int = 5, window_minutes: int = 15, delay: str = "10 minutes", **slices: int) -> DataFrame:
    """Every attempt with the failures of its user or address before it, each counted once, and whether that blocks it.

    The rows that an attempt has under its keys come out of one batch, so the batch's sink combines them.
    """
    path = os.path.join(root, "pressure")
    counts = stream_recent_failures(attempts, delay, window_minutes, **slices)
    schema = pressure_of(attempts.sparkSession.createDataFrame([], PRESSURE), limit).schema
    run_available(counts, lambda df, batch_id: write_batch(pressure_of(df, limit), batch_id, path), os.path.join(root, "checkpoint"))
    return read_batches(attempts.sparkSession, path, schema).drop("batch_id")


def stream_feedback(feedback: DataFrame, root: str) -> DataFrame:
    """Latest verdict per (issue, user). Batches store their own latest rows; readers take the last over all batches."""
    keys = ["issue_id", "user_id"]
    values = ["updated_at", "verdict"]
    path = os.path.join(root, "feedback")

    def latest(df: DataFrame) -> DataFrame:
        last = df.groupBy(*keys).agg(F.max(F.struct(*values)).alias("v"))
        return last.select(*keys, *[F.col(f"v.{c}").alias(c) for c in values])

    run_available(feedback, lambda df, batch_id: write_batch(latest(df), batch_id, path), os.path.join(root, "checkpoint"))
    schema = StructType([feedback.schema[c] for c in [*keys, *values]])
    return latest(read_batches(feedback.sparkSession, path, schema))


def stream_intake(docs: DataFrame, transform: Callable[[DataFrame], DataFrame], root: str) -> DataFrame:
    """New documents to rows of ``transform``, exactly once per document batch."""
    path = os.path.join(root, "reports")
    holder: dict = {}

    def sink(batch: DataFrame, batch_id: int) -> None:
        out = transform(batch)
        holder["schema"] = out.schema
        write_batch(out, batch_id, path)

    run_available(docs, sink, os.path.join(root, "checkpoint"))
    if "schema" not in holder:  # no batch came: all was taken in before, or there is nothing
        holder["schema"] = transform(docs.sparkSession.createDataFrame([], docs.schema)).schema
    return read_batches(docs.sparkSession, path, holder["schema"]).drop("batch_id")


def stream_reports(docs: DataFrame, reports: Callable[[DataFrame], DataFrame], root: str) -> tuple[DataFrame, DataFrame]:
    """(reports, intake): new documents to stored reports, once per document, and what each batch took in.

    A doc_id that comes again, in whatever file and batch, is left out: ids are remembered in the state store. ``reports``
    makes (doc_id, job_id, content) from a batch; they go to the report store as a whole, so a batch that is repeated
    after a failure replaces its own reports. ``intake`` has batch_id, documents read, fresh ones and repeats.
    """
    spark = docs.sparkSession
    store = KeyedStore(spark, os.path.join(root, "reports"), "job_id")
    counts = os.path.join(root, "intake")

    def sink(batch: DataFrame, batch_id: int) -> None:
        batch = batch.persist()
        store.replace(reports(batch))
        write_batch(batch.agg(F.count(F.lit(1)).alias("fresh")), batch_id, counts)
        batch.unpersist()

    query = run_available(docs.dropDuplicates(["doc_id"]), sink, os.path.join(root, "checkpoint"))
    write_progress(spark, query, os.path.join(root, "progress"))
    fresh = read_batches(spark, counts, StructType().add("fresh", LongType()))
    read = read_progress(spark, os.path.join(root, "progress")).select("batch_id", F.col("input_rows").alias("documents"))
    intake = read.join(fresh, "batch_id").select("batch_id", "documents", "fresh", (F.col("documents") - F.col("fresh")).alias("repeats"))
    return store.read(), intake


_PROGRESS_ROWS = "batch_id bigint, input_rows bigint, late_rows bigint, state_rows bigint"


def write_progress(spark: SparkSession, query: StreamingQuery, path: str) -> None:
    """Add one row for each batch of this run: rows read, rows dropped behind the watermark, keys in the state."""
    rows: dict[int, tuple[int, int, int]] = {}
    for p in query.recentProgress:
        states = p["stateOperators"]
        late, held = sum(s["numRowsDroppedByWatermark"] for s in states), sum(s["numRowsTotal"] for s in states)
        if p["numInputRows"] or p["batchId"] not in rows:
            rows[p["batchId"]] = (p["numInputRows"], late, held)
    if rows:
        spark.createDataFrame([(b, *r) for b, r in rows.items()], _PROGRESS_ROWS).coalesce(1).write.mode("append").parquet(path)


def read_progress(spark: SparkSession, path: str) -> DataFrame:
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    if not folder.getFileSystem(spark._jsc.hadoopConfiguration()).exists(folder):
        return spark.createDataFrame([], _PROGRESS_ROWS)
    return spark.read.schema(_PROGRESS_ROWS).parquet(path).groupBy("batch_id").agg(
        *[F.max(c).alias(c) for c in ("input_rows", "late_rows", "state_rows")])


def sweep(jobs: DataFrame, docs: DataFrame, reports: DataFrame, as_of) -> dict[str, DataFrame]:
    """One retention pass: queue and lease deadlines, cancellations, inputs, reports. Run it on a schedule.

    Documents come back as heads; the texts of those without ``has_text``, and the chunks of ``purged_jobs``, are emptied
    in their own tables by ``purge_stored``.
    """
    jobs = L.recover_leases(L.expire_queued(jobs, as_of), as_of)
    jobs, docs, cancelled = L.finalize_cancelled(jobs, docs, as_of)
    docs, unread, targets = L.expire_inputs(docs, jobs, reports, as_of)
    reports, jobs, docs, expired = L.expire_reports(reports, jobs, docs, as_of)
    purged = cancelled.unionByName(unread).unionByName(expired).distinct()
    return {"jobs": jobs, "documents": docs, "purged_jobs": purged, "reports": reports, "cleanup": targets}
