"""Job telemetry streams: progress changes, lease watch, login pressure, figures. Keyed state lives in the state store, with
event-time timers that remove what is no longer needed."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from proofspark import constants as K

MINUTE = 60_000

PROGRESS = "job_id bigint, event_id bigint, ts timestamp, status string, stage string, progress int, completed_chunks int"
_FIELDS = ["status", "stage", "progress", "completed_chunks"]


def _gathered(rows: Iterator[pd.DataFrame], columns: list[str], order: list[str]) -> pd.DataFrame:
    """All rows of a key in this batch, in order."""
    return pd.concat([r[columns] for r in rows], ignore_index=True).sort_values(order, kind="stable", ignore_index=True)


class ProgressChanges(StatefulProcessor):
    """State of a job: what it showed last, and whether it has ended. An ended job is removed ``keep`` milliseconds later."""

    def __init__(self, keep: int) -> None:
        self.keep, self.terminal = keep, list(K.TERMINAL)

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.job = handle.getValueState("job", "shown string, ended boolean")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        shown, ended = self.job.get() if self.job.exists() else (None, False)
        if ended:
            return
        frame = _gathered(rows, ["job_id", "event_id", "ts", *_FIELDS, "shows"], ["ts", "event_id"])
        over = np.flatnonzero(frame["status"].isin(self.terminal))
        if len(over):
            frame = frame.iloc[: over[0] + 1]
            due = int(frame["ts"].iloc[-1].timestamp() * 1000) + self.keep
            self.handle.registerTimer(max(due, timerValues.getCurrentWatermarkInMs() + 1))
        self.job.update((frame["shows"].iloc[-1], bool(len(over))))
        changed = frame[frame["shows"] != frame["shows"].shift(fill_value=shown or "")]
        if len(changed):
            yield changed.drop(columns="shows")

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        self.job.clear()
        return iter(())

    def close(self) -> None:
        pass


def stream_progress(events: DataFrame, delay: str = "10 minutes", keep_minutes: int = 366 * 24 * 60) -> DataFrame:
    """Status events that differ from the job's last one; a job ends with its terminal status.

    An ended job is remembered for ``keep_minutes`` of event time, so that nothing behind its end comes out; then its
    state goes, and a job id that is used again starts anew.
    """
    shows = F.to_json(F.struct(*_FIELDS), {"ignoreNullFields": "false"})
    rows = events.withWatermark("ts", delay).select("job_id", "event_id", "ts", *_FIELDS, shows.alias("shows"))
    return rows.groupBy("job_id").transformWithStateInPandas(ProgressChanges(keep_minutes * MINUTE), PROGRESS, "append", "eventTime")


ALERTS = "job_id bigint, ts timestamp, alert string"


class LeaseWatch(StatefulProcessor):
    """State of a job that hasn't ended: when it was last seen, its status, its deadline; one timer at what comes next.

    Times are milliseconds. A run of a job begins with its first event, or the first one after an end or a passed
    deadline; within a run the deadline is fixed, so gaps and ends are found for all its events at once.
    """

    def __init__(self, lease: int, life: int) -> None:
        self.lease, self.life = lease, life
        self.running, self.terminal = list(K.RUNNING), list(K.TERMINAL)

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.job = handle.getValueState("job", "seen bigint, status string, deadline bigint")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        frame = _gathered(rows, ["ts", "event_id", "status"], ["ts", "event_id"])
        t = frame["ts"].astype("datetime64[ms]").astype("int64").to_numpy()
        status = frame["status"].to_numpy(object)
        deadline = int(t[0]) + self.life
        if self.job.exists():
            seen, was, deadline = self.job.get()
            t, status = np.concatenate([[seen], t]), np.concatenate([[was], status])
        running, over = np.isin(status, self.running), np.isin(status, self.terminal)
        silent = running[:-1] & (t[:-1] + self.lease < t[1:])
        alerts, n, at = [], len(t), 0
        while at < n:
            ends = np.flatnonzero(over[at:])
            end = at + int(ends[0]) if len(ends) else n
            late = at + 1 + int(np.searchsorted(t[at + 1 :], deadline))
            passed = late <= end and late < n
            stop = late if passed else min(end, n - 1)  # the last event that a gap of this run may lead to
            gaps = at + np.flatnonzero(silent[at:stop] & (t[at:stop] + self.lease < deadline))
            alerts += [(int(x) + self.lease, "lease_expired") for x in t[gaps]]
            if passed:
                alerts.append((deadline, "job_timeout"))
            if not passed and end >= n:
                break
            at = late if passed else end + 1
            if at < n:
                deadline = int(t[at]) + self.life
        if over[-1]:
            self._forget()
        else:
            self._arm(int(t[-1]), str(status[-1]), deadline, timerValues)
        if alerts:
            yield self._rows(key, alerts)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        if not self.job.exists():
            return
        (seen, status, deadline), now, alerts = self.job.get(), timerValues.getCurrentWatermarkInMs(), []
        if status in self.running and seen + self.lease < deadline:
            alerts.append((seen + self.lease, "lease_expired"))
            status = "queued"
        if deadline <= now:
            alerts.append((deadline, "job_timeout"))
            self.job.clear()
        else:
            self._arm(seen, status, deadline, timerValues, int(expiredTimerInfo.getExpiryTimeInMs()))
        yield self._rows(key, alerts)

    def _forget(self, but: int | None = None) -> None:
        for timer in list(self.handle.listTimers()):
            if timer != but:
                self.handle.deleteTimer(timer)
        self.job.clear()

    def _arm(self, seen: int, status: str, deadline: int, timerValues, fired: int | None = None) -> None:
        self._forget(fired)
        due = min(seen + self.lease, deadline) if status in self.running else deadline
        self.job.update((seen, status, deadline))
        self.handle.registerTimer(max(due, timerValues.getCurrentWatermarkInMs() + 1))

    @staticmethod
    def _rows(key, alerts) -> pd.DataFrame:
        return pd.DataFrame({"job_id": [key[0]] * len(alerts), "ts": pd.to_datetime([t for t, _ in alerts], unit="ms"), "alert": [a for _, a in alerts]})

    def close(self) -> None:
        pass


def stream_lease_watch(
    events: DataFrame, lease_minutes: int = K.LEASE_MINUTES, deadline_minutes: int = K.JOB_TIMEOUT_MINUTES,
    delay: str = "10 minutes",
) -> DataFrame:
    """`lease_expired` when a running job stays silent for a lease, `job_timeout` when it outlives its deadline.

    Event-time timers: one per job, at the nearer of lease end and deadline. Jobs that ended or timed out leave no state.
    """
    rows = events.withWatermark("ts", delay).select("job_id", "event_id", "ts", "status")
    return rows.groupBy("job_id").transformWithStateInPandas(LeaseWatch(lease_minutes * MINUTE, deadline_minutes * MINUTE), ALERTS, "append", "eventTime")


PRESSURE = "attempt_id bigint, username string, ip string, attempted_at timestamp, kind string, failures bigint"


class RecentFailures(StatefulProcessor):
    """Recent failures of a bucket of names in a slice of time, and how many each attempt of the slice has before it.

    Names and times of failures, in microseconds, are a list in the state that is cut to the window before the watermark
    with every batch; attempts of later batches find them there. A timer behind the end of the slice removes it.
    """

    def __init__(self, window: int, slice_: int) -> None:
        self.window, self.slice = window, slice_

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.failed = handle.getListState("failed", "name string, at bigint")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        frame = _gathered(rows, ["name", "attempt_id", "username", "ip", "attempted_at", "at", "own", "success"], ["at", "attempt_id"])
        known = list(self.failed.get()) if self.failed.exists() else []
        fresh = frame.loc[~frame["success"], ["name", "at"]]
        failures = pd.concat([pd.DataFrame(known, columns=["name", "at"]), fresh], ignore_index=True) if known else fresh
        now = timerValues.getCurrentWatermarkInMs() * 1000
        kept = failures[failures["at"] > now - self.window]
        if len(kept):
            self.failed.put(list(kept.itertuples(index=False, name=None)))
            if not known:
                over = ((int(key[2]) + 1) * self.slice + self.window) // 1000 + 1
                self.handle.registerTimer(max(over, timerValues.getCurrentWatermarkInMs() + 1))
        elif known:
            self.failed.clear()
        mine = frame[frame["own"]]
        if len(mine):
            yield mine[["attempt_id", "username", "ip", "attempted_at"]].assign(kind=key[0], failures=self._before(failures, mine))

    def _before(self, failures: pd.DataFrame, attempts: pd.DataFrame) -> np.ndarray:
        """Failures of the same name in the window strictly before each attempt: names lie far apart on one axis."""
        base = int(min(attempts["at"].min(), failures["at"].min() if len(failures) else attempts["at"].min())) - self.window
        reach = int(attempts["at"].max()) - base + self.window + 1
        codes, names = pd.factorize(pd.concat([failures["name"], attempts["name"]]))
        axis = codes.astype(np.int64) * reach + np.concatenate([failures["at"], attempts["at"]]).astype(np.int64) - base
        sorted_failures, own = np.sort(axis[: len(failures)]), axis[len(failures) :]
        return np.searchsorted(sorted_failures, own, "left") - np.searchsorted(sorted_failures, own - self.window + 1, "left")

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        self.failed.clear()
        return iter(())

    def close(self) -> None:
        pass


def stream_recent_failures(attempts: DataFrame, delay: str = "10 minutes", window_minutes: int = 15, slice_minutes: int = 60, buckets: int = 64) -> DataFrame:
    """Failures strictly within the window before each attempt, one row for each way to key it: user, address, both.

    Names share ``buckets`` buckets for each slice of time, so a hot user or address spreads over time, and quiet ones do
    not make a group each. A failure near the end of a slice also counts in the next one. Rows of one attempt are
    combined by ``pressure_of``. An attempt with neither user nor address has no rows.
    """
    window, slice_ = window_minutes * MINUTE * 1000, max(slice_minutes, window_minutes) * MINUTE * 1000
    user, at = F.lower("username"), F.unix_micros("attempted_at")
    pick = lambda kind, name: F.when(name.isNotNull(), F.struct(F.lit(kind).alias("kind"), name.alias("name")))
    ways = F.array_compact(F.array(pick("user", user), pick("ip", F.col("ip")), pick("both", F.concat(user, F.lit("@"), F.col("ip")))))
    own = F.floor(at / slice_)
    later = ~F.col("success") & (at + window >= (own + 1) * slice_)
    rows = attempts.withWatermark("attempted_at", delay).select(
        "attempt_id", "username", "ip", "attempted_at", "success", at.alias("at"), own.alias("mine"), F.explode(ways).alias("way"),
        F.when(later, F.array(own, own + 1)).otherwise(F.array(own)).alias("slices"))
    keyed = rows.select("*", F.explode("slices").alias("slice")).select(
        "attempt_id", "username", "ip", "attempted_at", "success", "at", (F.col("slice") == F.col("mine")).alias("own"), "way.kind", "way.name",
        F.pmod(F.xxhash64("way.name"), F.lit(buckets)).alias("bucket"), "slice")
    return keyed.groupBy("kind", "bucket", "slice").transformWithStateInPandas(RecentFailures(window, slice_), PRESSURE, "append", "eventTime")


def pressure_of(counts: DataFrame, limit: int = 5) -> DataFrame:
    """(attempt_id, username, ip, attempted_at, failures, blocked): failures of the same user or address, each counted once."""
    signed = F.when(F.col("kind") == "both", -F.col("failures")).otherwise(F.col("failures"))
    summed = counts.groupBy("attempt_id", "username", "ip", "attempted_at").agg(F.sum(signed).alias("failures"))
    return summed.withColumn("blocked", F.col("failures") >= limit)


def stream_login_pressure(attempts: DataFrame, delay: str = "10 minutes", window: str = "15 minutes", slide: str = "1 minute") -> DataFrame:
    """Failed logins per user in sliding windows: figures for a dashboard; ``stream_recent_failures`` is exact for each attempt."""
    return (
        attempts.where(~F.col("success")).withWatermark("attempted_at", delay)
        .groupBy(F.window("attempted_at", window, slide), F.lower("username").alias("username"))
        .agg(F.count(F.lit(1)).alias("failures"))
        .select("username", F.col("window.start").alias("window_start"), "failures")
    )


def stream_ops(events: DataFrame, delay: str = "10 minutes", window: str = "1 hour") -> DataFrame:
    """Starts, completions and failures per tumbling window."""
    return (
        events.withWatermark("ts", delay).groupBy(F.window("ts", window))
        .agg(F.count_if(F.col("status") == "queued").alias("starts"), F.count_if(F.col("status") == "completed").alias("completions"),
             F.count_if(F.col("status") == "failed").alias("failures"), F.count(F.lit(1)).alias("events"))
        .select(F.col("window.start").alias("window_start"), "starts", "completions", "failures", "events")
    )


def stream_usage(usage: DataFrame, delay: str = "10 minutes", window: str = "1 hour") -> DataFrame:
    """Calls, retries and duration per tumbling window and pass."""
    return (
        usage.withWatermark("ts", delay).groupBy(F.window("ts", window), "pass")
        .agg(F.count(F.lit(1)).alias("calls"), F.sum(F.greatest(F.col("attempt") - 1, F.lit(0))).alias("retries"),
             F.sum("duration_ms").alias("duration_ms"))
        .select(F.col("window.start").alias("window_start"), "pass", "calls", "retries", "duration_ms")
    )
