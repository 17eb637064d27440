"""Streams run to the end of what is there, against the same work in batch."""

import time
import uuid
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from quadrel.plans.fixtures import tile_requests
from quadrel.streaming import streams as S

ROCKS = {"spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"}


@pytest.fixture
def request_stream(spark, sf_dir, tmp_path):
    batch = tile_requests(spark, sf_dir)
    batch.write.parquet(str(tmp_path / "in"))
    return batch, spark.readStream.schema(batch.schema).parquet(str(tmp_path / "in"))


def drain(df, mode="append", folder=None):
    name = "t" + uuid.uuid4().hex
    q = df.writeStream.format("memory").queryName(name).outputMode(mode).trigger(availableNow=True).option("checkpointLocation", str(folder)).start()
    q.awaitTermination(120)
    assert not q.isActive
    return df.sparkSession.table(name)


def test_windows(request_stream, tmp_path):
    batch, stream = request_stream
    got = drain(S.request_windows(stream), "update", tmp_path / "c").groupBy("window_start", "info_hash").agg(F.max("requests").alias("requests"), F.max("bytes").alias("bytes"))
    want = S.request_windows(batch)
    assert got.exceptAll(want).count() == 0 and want.exceptAll(got).count() == 0


def test_items_once(spark, tmp_path):
    t = datetime(2024, 1, 1)
    rows = [(i % 5, t + timedelta(minutes=i)) for i in range(20)]
    df = spark.createDataFrame(rows, "info_hash long, at timestamp")
    df.write.parquet(str(tmp_path / "in"))
    out = drain(S.new_items(spark.readStream.schema(df.schema).parquet(str(tmp_path / "in"))), "append", tmp_path / "c")
    assert sorted(x.info_hash for x in out.collect()) == [0, 1, 2, 3, 4]


def test_recent_percentiles(spark, request_stream, tmp_path):
    from quadrel.operators.requests import recent_percentiles

    batch, stream = request_stream
    for k, v in ROCKS.items():
        spark.conf.set(k, v)
    got = drain(S.recent_percentiles(stream), "update", tmp_path / "c")
    want = recent_percentiles(batch, {"p50": 0.5, "p95": 0.95})
    last = {x.info_hash: x for x in got.orderBy("samples").collect()}
    assert {k: (v.samples, v.p50) for k, v in last.items()} == {x.info_hash: (x.samples, x.p50) for x in want.collect()}


def test_seeding_clock(spark, tmp_path):
    t = datetime(2024, 1, 1)
    rows = [(1, t, 0.5, 0.0), (1, t + timedelta(minutes=1), 1.0, 0.1), (1, t + timedelta(minutes=40), 1.0, 0.2), (2, t, 1.0, 3.0), (3, t, 1.0, 0.0), (3, t + timedelta(minutes=5), 1.0, 0.0), (4, t + timedelta(minutes=35), 1.0, 0.0), (5, t + timedelta(minutes=70), 0.5, 0.0)]
    df = spark.createDataFrame(rows, "info_hash long, at timestamp, progress double, ratio double")
    df.write.parquet(str(tmp_path / "in"))
    for k, v in ROCKS.items():
        spark.conf.set(k, v)
    out = drain(S.seeding_ends(spark.readStream.schema(df.schema).parquet(str(tmp_path / "in")), 30, 2.0), "append", tmp_path / "c")
    assert {(x.info_hash, x.reason) for x in out.collect()} == {(1, "time"), (2, "ratio"), (3, "time")}  # 3 by the timer, for the watermark is at 60 minutes; 4 has five minutes left



def test_seeding_clock_over_triggers(spark, tmp_path):
    """An end by a later trigger's row takes the timer back; another entry's timer waits for the watermark."""
    t, folder = datetime(2024, 1, 1), str(tmp_path / "in")
    schema = "info_hash long, at timestamp, progress double, ratio double"
    for rows in ([(1, t, 1.0, 0.0), (2, t, 1.0, 0.0)], [(1, t + timedelta(minutes=5), 1.0, 3.0)], [(9, t + timedelta(hours=3), 0.0, 0.0)]):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(folder)
        time.sleep(1.1)
    for k, v in ROCKS.items():
        spark.conf.set(k, v)
    out = drain(S.seeding_ends(spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(folder), 30, 2.0), "append", tmp_path / "c")
    assert sorted((x.info_hash, x.reason) for x in out.collect()) == [(1, "ratio"), (2, "time")]

def test_settled_files(spark, tmp_path):
    """A file that changes within the time is passed on once, at its last size."""
    t = datetime(2024, 1, 1)
    schema, folder = "path string, length long, modified timestamp", str(tmp_path / "in")
    spark.createDataFrame([("a", 1, t), ("b", 5, t)], schema).coalesce(1).write.parquet(folder)
    for k, v in ROCKS.items():
        spark.conf.set(k, v)
    files = S.settled_files(spark.readStream.schema(schema).parquet(folder), 6)
    q = files.writeStream.format("memory").queryName("settled").outputMode("append").trigger(processingTime="500 milliseconds").option("checkpointLocation", str(tmp_path / "c")).start()
    try:
        until = time.time() + 60
        while not q.lastProgress and time.time() < until:
            time.sleep(0.1)
        spark.createDataFrame([("a", 2, t + timedelta(seconds=1)), ("b", 5, t)], schema).coalesce(1).write.mode("append").parquet(folder)
        while spark.table("settled").count() < 2 and time.time() < until:
            time.sleep(0.5)
        time.sleep(2)
        assert sorted(tuple(x) for x in spark.table("settled").collect()) == [("a", 2), ("b", 5)]
    finally:
        q.stop()


def test_throughput_of_instants(spark):
    """Archives are summed at each instant before the mean is taken."""
    t = datetime(2024, 1, 1)
    rows = [(1, t, 10, 1), (2, t, 30, 3), (1, t + timedelta(seconds=15), 20, 2), (1, t + timedelta(minutes=59, seconds=45), 3, 0), (1, t + timedelta(minutes=60), 8, 8)]
    samples = spark.createDataFrame(rows, "info_hash long, at timestamp, down long, up long")
    got = sorted(tuple(x) for x in S.throughput_windows(samples).collect())
    assert got == [(t, 21, 2, 3), (t + timedelta(hours=1), 8, 8, 1)]
    assert sorted(tuple(x)[1:] for x in S.traffic_windows(samples).collect()) == [(1, 8, 8, 1), (1, 11, 1, 3), (2, 30, 3, 1)]
