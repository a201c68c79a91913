"""Stateful streams that need a key's rows in order of time: rows wait until the watermark passes them, then a timer takes them in order.

Keys share BUCKETS groups by their hash, so that calls, frames and messages to the state server are a bucket's and not a key's; each key
has a state of its own in its bucket. What waits for a bucket is bounded by the watermark's delay and the rows of one micro-batch.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor

from quire.operators.health import HEALTH_SCHEMA, ServiceState, Window_

PROVIDER = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
#: Groups of keys, whatever the number of keys; part of what a checkpoint rests on. Rows of an output frame.
BUCKETS, OUT_ROWS = 1024, 50_000


class InOrder(StatefulProcessor):
    """Keeps rows until they are due, as packed chunks of numbers. Subclasses say what a row is (`columns` behind its key, the first two
    its time in microseconds and its id), what a key's state is, and what a row does to it."""

    #: Columns of a waiting row, DDL of a key's state, and the names of the output's columns.
    columns: list[str]
    state: str
    names: list[str]

    def init(self, handle) -> None:
        self.handle = handle
        self.waiting = handle.getListState("waiting", "chunk binary")
        self.now = handle.getMapState("now", "key bigint, none boolean", self.state)

    def start(self, saved: tuple | None):
        raise NotImplementedError

    def take(self, running, row: tuple) -> tuple:
        raise NotImplementedError

    def saved(self, running) -> tuple:
        raise NotImplementedError

    #: Whether a key's state ends.
    ending = False

    def ends(self, running) -> int:
        """The microsecond after which the key's state is as if there were none."""
        raise NotImplementedError

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        first = None
        for frame in rows:
            frame = frame[["key", "none", *self.columns]]
            if frame.isna().to_numpy().any():
                raise ValueError(f"a row without one of {self.columns}")
            chunk = np.stack([frame[c].to_numpy().astype("<i8") for c in frame])
            self.waiting.appendValue((chunk.tobytes(),))
            least = int(chunk[2].min())
            first = least if first is None else min(first, least)
        if first is not None:
            self.handle.registerTimer(first // 1000)
        return iter([])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        mark = timerValues.getCurrentWatermarkInMs()
        width = 2 + len(self.columns)
        held = [np.frombuffer(c[0], "<i8").reshape(width, -1) for c in self.waiting.get()] if self.waiting.exists() else []
        rows = np.concatenate(held, axis=1) if held else np.zeros((width, 0), np.int64)
        is_due = rows[2] // 1000 <= mark
        if is_due.any():
            left = rows[:, ~is_due]
            if left.size:
                self.waiting.put([(left.tobytes(),)])
                self.handle.registerTimer(int(left[2].min()) // 1000)
            else:
                self.waiting.clear()
        due = rows[:, is_due]
        due = due[:, np.lexsort(due[::-1])]
        cuts = np.flatnonzero(np.r_[True, (due[:2, 1:] != due[:2, :-1]).any(axis=0)]) if due.size else np.zeros(0, np.int64)
        out: list[tuple] = []
        for a, b in zip(cuts.tolist(), [*cuts[1:].tolist(), due.shape[1]]):
            which = int(due[0, a]), bool(due[1, a])
            saved = self.now.getValue(which)
            running = self.start(tuple(saved) if saved is not None else None)
            name = None if which[1] else which[0]
            out += [(name, r[1], *self.take(running, r)) for r in zip(*due[2:, a:b].tolist())]
            self.now.updateValue(which, self.saved(running))
            if len(out) >= OUT_ROWS:
                yield self.frame(out)
                out = []
        self.sweep(mark)
        if out:
            yield self.frame(out)

    def frame(self, out: list[tuple]) -> pd.DataFrame:
        made = pd.DataFrame(out, columns=self.names)
        return made.astype({self.names[0]: "Int64"})

    def sweep(self, mark: int) -> None:
        """Drops the states of keys that have ended; a timer wakes the bucket when the next one ends."""
        if not self.ending:
            return
        ends = [(self.ends(self.start(tuple(value))) // 1000, tuple(which)) for which, value in self.now.iterator()]
        for at, which in ends:
            if at < mark:
                self.now.removeKey(which)
        later = [at for at, _ in ends if at >= mark]
        if later:
            self.handle.registerTimer(min(later) + 1)

    def close(self) -> None:
        pass


class QuotaInOrder(InOrder):
    columns, state, names = ["at", "event_id"], "end bigint, count bigint", ["key", "event_id", "allowed"]
    ending = True

    def __init__(self, limit: int, seconds: int):
        self.limit, self.seconds = limit, seconds

    def start(self, saved):
        return Window_(self.limit, self.seconds * 1_000_000, *(saved or ()))

    def take(self, running, row):
        return (running.allow(row[0]),)

    def saved(self, running):
        return int(running.end), int(running.count)

    def ends(self, running):
        return running.end


class HealthInOrder(InOrder):
    columns, state = ["at", "event_id", "healthy", "duration_ms"], "avg bigint, errors bigint, healthy boolean, enabled boolean"
    names = ["service", "event_id", "avg_ms", "errors", "flipped", "enabled"]

    def start(self, saved):
        return ServiceState(*(saved or ()))

    def take(self, running, row):
        return running.take(bool(row[2]), int(row[3]))

    def saved(self, running):
        return running.avg, running.errors, running.healthy, running.enabled


def in_order(rows: DataFrame, key: str, processor: InOrder, shape: str, delay: str) -> DataFrame:
    """rows with a time `ts` through a processor; those later than `delay` behind the newest one are dropped. A null key is a key too."""
    timed = rows.withColumn("ts", F.col("ts").cast("timestamp")).withColumn("at", F.unix_micros("ts")).withWatermark("ts", delay)
    rows.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", PROVIDER)  # the state of timers needs it
    bucket = F.pmod(F.xxhash64(key), F.lit(BUCKETS)).cast("int").alias("bucket")
    dealt = timed.select(bucket, "ts", F.coalesce(key, F.lit(0)).alias("key"), F.col(key).isNull().alias("none"), *processor.columns)
    return dealt.groupBy("bucket").transformWithStateInPandas(processor, shape, "append", "EventTime")


def quota(requests: DataFrame, limit: int, seconds: int, delay: str = "0 seconds") -> DataFrame:
    """(key, event_id, ts) -> key, event_id, allowed; a key's window opens at its first request and leaves the state at its end."""
    return in_order(requests.select("key", "event_id", "ts"), "key", QuotaInOrder(limit, seconds), "key long, event_id long, allowed boolean", delay)


def health(checks: DataFrame, delay: str = "0 seconds") -> DataFrame:
    """(service, event_id, ts, healthy, duration_ms) -> the state after each check, per service."""
    return in_order(checks.select("service", "event_id", "ts", F.coalesce("healthy", F.lit(False)).alias("healthy"), "duration_ms"), "service", HealthInOrder(), HEALTH_SCHEMA, delay)
