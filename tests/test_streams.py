"""Streams over several runs: what state they keep, and that they end with the rows of their batch twins."""

import datetime as dt

import pandas as pd
from pyspark.sql import functions as F

from quire.operators import health
from quire.streaming import ingest, jobs, ordered

START = dt.datetime(2024, 1, 1)


def run(spark, stream, base, key="rows"):
    """Runs a stream over what is there; returns the number of its rows of state at the end."""
    query = stream.writeStream.outputMode("append").format("parquet").option("path", f"{base}/{key}").option("checkpointLocation", f"{base}/state-{key}").trigger(availableNow=True).start()
    query.awaitTermination()
    return sum(o["numRowsTotal"] for o in (query.lastProgress or {}).get("stateOperators", []))


def test_ingest_takes_each_content_once_and_forgets_old_ones(spark, tmp_path):
    source, base = tmp_path / "in", f"file://{tmp_path}/out"
    source.mkdir()
    texts = {"甲-书.txt": "第一段。\n\n&lt;二&gt;\n".encode(), "b.txt": "你好\n".encode("gbk") + "世界".encode(), "c.TXT": b"same", "d.txt": b"same", "e.md": b"no"}
    for name, body in texts.items():
        (source / name).write_bytes(body)
    ingest.ingest(ingest.arriving(spark, str(source)), base)
    assert ingest.catalogue(spark, base).count() == 3
    got = {(r.idx, r.text) for r in ingest.stored_paragraphs(spark, base).collect()}
    assert got == {(0, "第一段。"), (1, "<二>"), (0, "你好"), (1, "世界"), (0, "same")}
    # A second run: old contents under new names, and one new; nothing old comes again, though the stream's own state may have forgotten it.
    (source / "again.txt").write_bytes(texts["甲-书.txt"])
    (source / "new.txt").write_bytes(b"new words")
    ingest.ingest(ingest.arriving(spark, str(source)), base)
    rows = ingest.catalogue(spark, base)
    assert rows.count() == rows.select("md5").distinct().count() == 4
    batch = spark.createDataFrame([(bytes(b),) for n, b in {**texts, "new.txt": b"new words"}.items() if n != "e.md"], "content binary").withColumn("md5", F.md5("content")).dropDuplicates(["md5"])
    want = {tuple(r) for r in ingest.paragraphs_of(batch).collect()}
    assert {tuple(r) for r in ingest.stored_paragraphs(spark, base).collect()} == want


def events(key, minutes, first=0):
    return [(key, first + i, START + dt.timedelta(minutes=m)) for i, m in enumerate(minutes)]


def test_quota_state_is_empty_after_the_last_window(spark, tmp_path):
    shape, path = "key long, event_id long, ts timestamp", str(tmp_path / "in")
    one = events(1, [0, 1, 2, 3, 50, 61, 62]) + events(2, [5, 6, 64], 100)
    spark.createDataFrame(one, shape).repartition(3).write.mode("append").parquet(path)
    stream = lambda: ordered.quota(spark.readStream.schema(shape).parquet(path), 2, 3600)
    base = f"file://{tmp_path}/out"
    run(spark, stream(), base)
    got = lambda: sorted(map(tuple, spark.read.parquet(f"{base}/rows").collect()))
    assert got() == sorted(map(tuple, health.quota(spark.createDataFrame(one, shape), 2, 3600).collect()))
    # Days later another key: the idle ones' windows are over, and their state goes.
    two = events(3, [10_000], 200)
    spark.createDataFrame(two, shape).write.mode("append").parquet(path)
    run(spark, stream(), base)
    three = events(4, [20_000, 20_061], 300)
    spark.createDataFrame(three, shape).write.mode("append").parquet(path)
    left = run(spark, stream(), base)
    assert got() == sorted(map(tuple, health.quota(spark.createDataFrame(one + two + three, shape), 2, 3600).collect()))
    assert left <= 2  # the newest key's window and its timer


def test_health_goes_on_from_run_to_run(spark, tmp_path):
    shape, path, base = "service long, event_id long, ts timestamp, healthy boolean, duration_ms long", str(tmp_path / "in"), f"file://{tmp_path}/out"
    rows = [(i % 3, i, START + dt.timedelta(minutes=i * 7 % 60 + 60 * (i // 60)), i % 5 > 1, i * 13 % 100) for i in range(180)]
    for part in range(3):
        spark.createDataFrame(rows[part * 60 : part * 60 + 60], shape).repartition(2).write.mode("append").parquet(path)
        run(spark, ordered.health(spark.readStream.schema(shape).parquet(path)), base)
    want = sorted(map(tuple, health.health_ema(spark.createDataFrame(rows, shape)).collect()))
    assert sorted(map(tuple, spark.read.parquet(f"{base}/rows").collect())) == want


def test_a_finished_stream_has_all_rows(spark, sf_dir):
    assert jobs.finished(jobs.stream_of(spark, sf_dir, "events").select("event_id")).count() == spark.read.parquet(f"{sf_dir}/events.parquet").count()


class Held:
    """A state store in memory that counts the messages that a processor would send."""

    def __init__(self):
        self.list, self.map, self.timers, self.sent = [], {}, set(), 0

    getListState = getMapState = lambda self, name, *shape: self

    def registerTimer(self, at):
        self.sent, self.timers = self.sent + 1, self.timers | {at}

    def appendValue(self, value):
        self.sent, self.list = self.sent + 1, [*self.list, value]

    def exists(self):
        return bool(self.list)

    def get(self):
        return list(self.list)

    def clear(self):
        self.list = []

    def getValue(self, key):
        return self.map.get(key)

    def updateValue(self, key, value):
        self.map[key] = value


class Mark:
    def getCurrentWatermarkInMs(self):
        return 1 << 40


def test_keys_of_a_bucket_share_frames_and_messages():
    """Rows of 600 keys wait with two messages and come back in one frame, each key in its own order, a null one too."""
    held, processor = Held(), ordered.HealthInOrder()
    processor.init(held)
    rows = [(k % 599, k % 600 == 7, t, 600 * t + k, (k + t) % 4 > 0, k * t % 50) for t in (2, 0, 1) for k in range(600)]
    list(processor.handleInputRows((0,), iter([pd.DataFrame(rows, columns=["key", "none", "at", "event_id", "healthy", "duration_ms"])]), Mark()))
    assert held.sent == 2
    (frame,) = processor.handleExpiredTimer((0,), Mark(), None)
    want, states = [], {}
    for key, none, _, event, healthy, ms in sorted(rows, key=lambda r: r[:4]):
        state = states.setdefault((key, none), health.ServiceState())
        want.append((None if none else key, event, *state.take(healthy, ms)))
    got = [(None if pd.isna(k) else k, *r) for k, *r in frame.itertuples(index=False)]
    assert sorted(got, key=lambda r: r[1]) == sorted(want, key=lambda r: r[1])
    assert held.list == [] and len(held.map) == len(states)
