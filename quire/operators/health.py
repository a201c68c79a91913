"""Service health over ordered checks, and request quotas."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

#: Consecutive errors at which a service that flips to unhealthy is disabled.
ERROR_LIMIT = 3


def service_metrics(checks: DataFrame) -> DataFrame:
    """(service, event_id, ts, healthy, duration_ms) -> totals, success rate, last check and last error's id, average of successes."""
    return checks.groupBy("service").agg(
        F.count(F.lit(1)).alias("total_checks"),
        F.count_if("healthy").alias("success_count"),
        (F.count_if("healthy") * 100.0 / F.count(F.lit(1))).alias("success_rate"),
        F.max_by("event_id", F.struct("ts", "event_id")).alias("last_check"),
        F.max_by(F.when(~F.col("healthy"), F.col("event_id")), F.when(~F.col("healthy"), F.struct("ts", "event_id"))).alias("last_error"),
        F.avg(F.when(F.col("healthy"), F.col("duration_ms"))).alias("avg_ms"),
    )


def health_runs(checks: DataFrame) -> DataFrame:
    """Adds errors (consecutive ones, reset by a success) and flipped (the state changed; services start healthy)."""
    line = W.partitionBy("service").orderBy("ts", "event_id")
    island = F.sum(F.col("healthy").cast("long")).over(line.rowsBetween(W.unboundedPreceding, 0))
    marked = checks.withColumn("island_", island).withColumn("flipped", F.coalesce(F.lag("healthy").over(line), F.lit(True)) != F.col("healthy"))
    errors = F.sum((~F.col("healthy")).cast("long")).over(W.partitionBy("service", "island_").orderBy("ts", "event_id").rowsBetween(W.unboundedPreceding, 0))
    return marked.withColumn("errors", errors).drop("island_")


class ServiceState:
    """One service's running state; the integer average makes it recursive, so rows are taken in order."""

    def __init__(self, avg: int = 0, errors: int = 0, healthy: bool = True, enabled: bool = True):
        self.avg, self.errors, self.healthy, self.enabled = avg, errors, healthy, enabled

    def take(self, healthy: bool, ms: int) -> tuple[int, int, bool, bool]:
        if healthy:
            self.errors = 0
            self.avg = (self.avg * 9 + ms) // 10 if self.avg else ms
        else:
            self.errors += 1
        flipped, self.healthy = healthy != self.healthy, healthy
        if flipped and self.errors >= ERROR_LIMIT:
            self.enabled = False
        return self.avg, self.errors, flipped, self.enabled


HEALTH_SCHEMA = "service long, event_id long, avg_ms long, errors long, flipped boolean, enabled boolean"


def health_ema(checks: DataFrame) -> DataFrame:
    """The state after each check; a service's checks are read in order, batch by batch, within one sorted partition."""

    def scan(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        service, state = None, ServiceState()
        for frame in frames:
            rows = []
            for s, e, h, ms in zip(frame.service, frame.event_id, frame.healthy, frame.duration_ms):
                if s != service:
                    service, state = s, ServiceState()
                rows.append((s, e, *state.take(bool(h), int(ms))))
            yield pd.DataFrame(rows, columns=["service", "event_id", "avg_ms", "errors", "flipped", "enabled"])

    ordered = checks.select("service", "event_id", "ts", "healthy", "duration_ms").repartition("service").sortWithinPartitions("service", "ts", "event_id")
    return ordered.mapInPandas(scan, HEALTH_SCHEMA)


class Window_:
    """A fixed window that opens at a key's first request; the next request after its end opens a new one."""

    def __init__(self, limit: int, seconds: int, end: float | None = None, count: int = 0):
        self.limit, self.seconds, self.end, self.count = limit, seconds, end, count

    def allow(self, at: float) -> bool:
        if self.end is None or at > self.end:
            self.end, self.count = at + self.seconds, 1
            return True
        if self.count >= self.limit:
            return False
        self.count += 1
        return True


def quota(requests: DataFrame, limit: int, seconds: int) -> DataFrame:
    """(key, event_id, ts) -> key, event_id, allowed: at most `limit` in each window of a key."""

    def scan(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        key, window = None, Window_(limit, seconds)
        for frame in frames:
            rows = []
            for k, e, at in zip(frame.key, frame.event_id, frame["at"]):
                if k != key:
                    key, window = k, Window_(limit, seconds)
                rows.append((k, e, window.allow(at)))
            yield pd.DataFrame(rows, columns=["key", "event_id", "allowed"])

    at = F.unix_micros(F.col("ts").cast("timestamp")) / 1e6
    ordered = requests.select("key", "event_id", at.alias("at")).repartition("key").sortWithinPartitions("key", "at", "event_id")
    return ordered.mapInPandas(scan, "key long, event_id long, allowed boolean")
