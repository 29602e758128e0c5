"""Deliveries as a stream: duplicate suppression, keyed cooldown, counters and incremental re-indexing.

Event time decides. A row waits in the state of its key until the watermark has passed it, and is then taken in the order of
its time, so micro-batches, restarts and rows that come out of order give what the batch form gives. A row whose time the
watermark has passed when it comes has the outcome "late" and moves nothing. Rows without key or time meet no gate: they are
dispatched, as in the batch form.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

PROVIDER = "spark.sql.streaming.stateStore.providerClass"
ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
COLUMNS = ["key", "id", "t", "outcome"]


class Admission(StatefulProcessor):
    """The gate of one key in state: the time of its last dispatch, its live jobs, and the rows that the watermark has not passed.

    Rows that come are appended to a list, which is rewritten only when the watermark passes some of them. One timer stands
    at the earliest waiting row, or else at the time when the last live job expires and nothing is left to remember.
    """

    def __init__(self, window_us: int, horizon_us: int):
        self.window_us, self.horizon_us = window_us, horizon_us

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.last = handle.getValueState("last", "t long")
        self.live = handle.getMapState("live", "job string", "t long")
        self.waiting = handle.getListState("waiting", "t long, id long, job string")

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        mark, fresh, late = timerValues.getCurrentWatermarkInMs() * 1000, [], []
        for b in rows:
            jobs = b["job"].where(b["job"].notna(), None)
            for t, i, job in zip(b["t"].astype("int64").tolist(), b["id"].astype("int64").tolist(), jobs.tolist(), strict=True):
                (fresh if t > mark else late).append((t, i, job))
        if fresh:
            self.waiting.appendList(fresh)
            self._timer(min(fresh)[0] // 1000)
        if late:
            yield pd.DataFrame([(key[0], i, t, "late") for t, i, _ in late], columns=COLUMNS)

    def handleExpiredTimer(self, key: tuple, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        mark = timerValues.getCurrentWatermarkInMs() * 1000
        waiting = [tuple(w) for w in self.waiting.get()] if self.waiting.exists() else []
        ready, later = sorted(w for w in waiting if w[0] <= mark), [w for w in waiting if w[0] > mark]
        if ready:
            out = self._judged(ready)
            self.waiting.clear()
            if later:
                self.waiting.appendList(later)
            yield pd.DataFrame([(key[0], i, t, o) for (t, i, _), o in zip(ready, out, strict=True)], columns=COLUMNS)
        for job, (t,) in [(j, v) for j, v in self.live.iterator()]:
            if mark - t >= self.horizon_us:
                self.live.removeKey(job)
        if later:
            self._timer(min(later)[0] // 1000)
        elif self.last.exists():
            over = self.last.get()[0] + max(self.window_us, self.horizon_us)
            if over <= mark:
                self.last.clear()
                self.live.clear()
            else:
                self._timer(over // 1000 + 1)

    def _judged(self, rows: list[tuple]) -> list[str]:
        """Cooldown first, then duplicates; only a dispatched job moves the gate."""
        last, out = self.last.get()[0] if self.last.exists() else None, []
        for t, _, job in rows:
            if last is not None and t - last < self.window_us:
                out.append("cooldown")
                continue
            if job is not None and self.live.containsKey((job,)) and t - self.live.getValue((job,))[0] < self.horizon_us:
                out.append("duplicate")
                continue
            last = t
            if job is not None:
                self.live.updateValue((job,), (t,))
            out.append("dispatched")
        if last is not None:
            self.last.update((last,))
        return out

    def _timer(self, ms: int) -> None:
        """One timer, at the earliest time asked for; a timer in the same millisecond as the watermark has its rows behind it."""
        timers = sorted(t for (t,) in map(self._ms, self.handle.listTimers()))
        if timers and timers[0] <= ms:
            return
        for t in timers:
            self.handle.deleteTimer(t)
        self.handle.registerTimer(ms)

    @staticmethod
    def _ms(timer: object) -> tuple[int]:
        return (timer if isinstance(timer, int) else timer[0],)

    def close(self) -> None:
        pass


def gated(stream: DataFrame, window_us: int, horizon_us: int, lateness: str) -> DataFrame:
    """(key, id, t, outcome) of a stream (key, id, job, ts), as the batch form gives it; the state lives in RocksDB."""
    stream.sparkSession.conf.set(PROVIDER, ROCKSDB)
    # the time that the gate sees is a column of its own, so that late rows come to it and get their outcome
    rows = stream.withWatermark("ts", lateness).select(F.lower("key").alias("key"), F.col("id").cast("long").alias("id"), F.col("job").cast("string").alias("job"), F.unix_micros("ts").alias("t"))
    loose = F.col("key").isNull() | F.col("t").isNull()
    gate = rows.where(~loose).groupBy("key").transformWithStateInPandas(Admission(window_us, horizon_us), "key string, id long, t long, outcome string", "Append", "EventTime")
    return gate.unionByName(rows.where(loose).select("key", "id", "t", F.lit("dispatched").alias("outcome")))


def cooldown(stream: DataFrame, window_seconds: float = 60.0, lateness: str = "10 minutes") -> DataFrame:
    """(key, id, t) of the accepted rows of a stream (key, id, ts)."""
    rows = stream.select("key", "id", "ts", F.lit(None).cast("string").alias("job"))
    return gated(rows, int(window_seconds * 1e6), 0, lateness).where("outcome = 'dispatched'").select("key", "id", "t")


def dedupe_jobs(stream: DataFrame, horizon_seconds: float, lateness: str = "10 minutes") -> DataFrame:
    """(delivery_id, job_id) of a stream of jobs (delivery_id, job_id, ts) that come at least the horizon after the last one kept with their id."""
    kept = cooldown(stream.select(F.col("job_id").alias("key"), F.col("delivery_id").alias("id"), "ts"), horizon_seconds, lateness)
    return kept.select(F.col("id").alias("delivery_id"), F.col("key").alias("job_id"))


def admit(stream: DataFrame, window_seconds: float = 60.0, horizon_seconds: float = 3600.0, lateness: str = "10 minutes") -> DataFrame:
    """(delivery_id, outcome) of a stream of jobs (delivery_id, repo_key, job_id, ts)."""
    rows = stream.select(F.col("repo_key").alias("key"), F.col("delivery_id").alias("id"), F.col("job_id").alias("job"), "ts")
    return gated(rows, int(window_seconds * 1e6), int(horizon_seconds * 1e6), lateness).select(F.col("id").alias("delivery_id"), "outcome")


def delivery_stats(stream: DataFrame, status: str, lateness: str = "10 minutes", window: str = "1 hour") -> DataFrame:
    return stream.withWatermark("ts", lateness).groupBy(F.window("ts", window), status).agg(F.count("*").alias("n"))
