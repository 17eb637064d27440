"""The timers and counters of a tile service on Structured Streaming. Event times carry a watermark; rows later than it are dropped."""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from ..functions.rules import round_half_up


def request_windows(requests: DataFrame, width: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """Requests and bytes by archive in tumbling windows."""
    w = requests.withWatermark("at", late).groupBy(F.window("at", width), "info_hash").agg(F.count(F.lit(1)).alias("requests"), F.sum("bytes").alias("bytes"))
    return w.select(F.col("window.start").alias("window_start"), "info_hash", "requests", "bytes")


def traffic_windows(samples: DataFrame, width: str = "1 hour", late: str = "10 minutes", slide: str | None = None) -> DataFrame:
    """Mean rates of each archive in tumbling or sliding windows."""
    w = samples.withWatermark("at", late).groupBy(_window("at", width, slide), "info_hash").agg(*_means())
    return w.select(F.col("window.start").alias("window_start"), "info_hash", "down", "up", "samples")


def throughput_windows(samples: DataFrame, width: str = "1 hour", late: str = "10 minutes", slide: str | None = None, interval: str = "15 seconds") -> DataFrame:
    """Mean rates of the whole node in tumbling or sliding windows: rates are summed over all archives at each instant, a multiple of the interval, before they are averaged."""
    instants = samples.withWatermark("at", late).groupBy(F.window("at", interval).alias("instant")).agg(F.sum("down").alias("down"), F.sum("up").alias("up"))
    w = instants.groupBy(_window("instant", width, slide)).agg(*_means())
    return w.select(F.col("window.start").alias("window_start"), "down", "up", "samples")


def _window(at: str, width: str, slide: str | None) -> Column:
    return (F.window(at, width, slide) if slide else F.window(at, width)).alias("window")


def _means() -> list[Column]:
    return [*(round_half_up(F.avg(c)).cast("long").alias(c) for c in ("down", "up")), F.count(F.lit(1)).alias("samples")]


def client_sessions(requests: DataFrame, gap: str = "30 minutes", late: str = "10 minutes") -> DataFrame:
    """Sessions of a client: requests with less than a gap between them."""
    base = requests.withWatermark("at", late) if requests.isStreaming else requests
    s = base.groupBy(F.session_window("at", gap).alias("w"), "ip").agg(F.count(F.lit(1)).alias("requests"), F.sum("bytes").alias("bytes"))
    return s.select("ip", F.col("w.start").alias("session_start"), F.col("w.end").alias("session_end"), "requests", "bytes")


def new_items(items: DataFrame, remember: str = "7 days") -> DataFrame:
    """Each feed item once, within the time that keys are remembered."""
    return items.withWatermark("at", remember).dropDuplicatesWithinWatermark(["info_hash"])


class RecentDurations(StatefulProcessor):
    """The latest durations of an archive and their nearest-rank percentiles."""

    def __init__(self, last: int = 512):
        self.last = last

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.kept = handle.getValueState("kept", "ms array<double>")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        kept, new = list(self.kept.get()[0]) if self.kept.exists() else [], None
        for frame in rows:  # a trigger's rows come in several frames, in no order among them
            frame = frame.loc[frame["ms"].notna(), ["at", "seq", "ms"]]
            new = (frame if new is None else pd.concat([new, frame])).sort_values(["at", "seq"]).tail(self.last)
        kept = (kept + [float(x) for x in new["ms"]] if new is not None else kept)[-self.last :]
        self.kept.update((kept,))
        if kept:
            s = sorted(kept)
            rank = lambda f: s[max(0, -(-int(f * 1000 * len(s)) // 1000) - 1)]
            yield pd.DataFrame({"info_hash": [key[0]], "samples": [len(s)], "p50": [rank(0.5)], "p95": [rank(0.95)]})

    def close(self) -> None:
        pass


def recent_percentiles(requests: DataFrame, last: int = 512) -> DataFrame:
    return requests.groupBy("info_hash").transformWithStateInPandas(RecentDurations(last), "info_hash long, samples long, p50 double, p95 double", "update", "none")


class SettledFiles(StatefulProcessor):
    """A file is passed on once its size and time have stood still for some seconds."""

    def __init__(self, seconds: int):
        self.seconds = seconds

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle, self.seen = handle, handle.getValueState("seen", "length long, modified timestamp")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        now = max((r.modified.to_pydatetime(), int(r.length)) for frame in rows for r in frame.itertuples())[::-1]
        if not self.seen.exists() or tuple(self.seen.get()) != now:
            for t in list(self.handle.listTimers()):
                self.handle.deleteTimer(t)
            self.seen.update(now)
            self.handle.registerTimer(timerValues.getCurrentProcessingTimeInMs() + self.seconds * 1000)
        return iter(())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        length, _ = self.seen.get()
        yield pd.DataFrame({"path": [key[0]], "length": [length]})

    def close(self) -> None:
        pass


def settled_files(files: DataFrame, seconds: int = 5) -> DataFrame:
    """files: (path, length, modified) observations."""
    return files.groupBy("path").transformWithStateInPandas(SettledFiles(seconds), "path string, length long", "append", "processingTime")


class StoodStill(StatefulProcessor):
    """A file is passed on, once, when a listing sees it unchanged for some seconds, or when the watermark has passed them without another listing of it."""

    def __init__(self, seconds: float):
        self.wait = int(seconds * 1_000_000)

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle, self.seen = handle, handle.getValueState("seen", "length long, modified long, since long, done boolean")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        state = self.seen.get() if self.seen.exists() else None
        if state is not None and state[3]:
            return
        began = state and state[2]
        for row in pd.concat(list(rows)).sort_values(["us", "modified", "length"]).itertuples():
            if state is not None and int(row.us) - state[2] >= self.wait:
                break
            if state is None or state[:2] != (int(row.length), int(row.modified)):
                state = (int(row.length), int(row.modified), int(row.us), False)
        else:
            if state[2] != began:
                for t in list(self.handle.listTimers()):
                    self.handle.deleteTimer(t)
                self.handle.registerTimer((state[2] + self.wait) // 1000)
            self.seen.update(state)
            return
        for t in list(self.handle.listTimers()):
            self.handle.deleteTimer(t)
        self.seen.update((*state[:3], True))
        yield pd.DataFrame({"path": [key[0]], "length": [state[0]]})

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        state = self.seen.get()
        if not state[3]:
            self.seen.update((*state[:3], True))
            yield pd.DataFrame({"path": [key[0]], "length": [state[0]]})

    def close(self) -> None:
        pass


def stood_still(listed: DataFrame, seconds: float = 5, late: str = "1 minute") -> DataFrame:
    """listed: (path, length, modified, at) of listings that carry their time, as logged ones do. settled_files by the listings' clock in place of the machine's.

    What stood still long enough before its next change counts as settled even if that change comes in the same trigger. Null paths, lengths or times take no part. Late listings are dropped by the watermark.
    """
    timed = listed.filter("path is not null and length is not null and modified is not null and at is not null").withWatermark("at", late)
    rows = timed.select("path", "at", F.unix_micros("at").alias("us"), "length", F.unix_micros("modified").alias("modified"))
    return rows.groupBy("path").transformWithStateInPandas(StoodStill(seconds), "path string, length long", "append", "eventTime")


class SeedingClock(StatefulProcessor):
    """Starts when progress first reaches 1; fires once, at the first row that reaches the ratio or the minutes, or when the watermark has passed the minutes without one."""

    def __init__(self, minutes: float, ratio: float):
        self.minutes, self.ratio = minutes, ratio

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle, self.since = handle, handle.getValueState("since", "us long, done boolean")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        since, done = self.since.get() if self.since.exists() else (None, False)
        frames, began = list(rows) if not done else [], since  # one archive's status rows of one trigger
        for row in pd.concat(frames).sort_values("us").itertuples() if frames else ():
            if since is None and row.progress >= 1:
                since = int(row.us)
            if since is not None and not done:
                by_ratio, by_time = row.ratio >= self.ratio, row.us - since >= self.minutes * 60_000_000
                if by_ratio or by_time:
                    done = True
                    yield pd.DataFrame({"info_hash": [key[0]], "reason": ["ratio" if by_ratio else "time"]})
        if since is not None:
            self.since.update((since, done))
            if done and began is not None:
                for t in list(self.handle.listTimers()):
                    self.handle.deleteTimer(t)
            elif not done and began is None:
                self.handle.registerTimer(int(since / 1000 + self.minutes * 60_000))

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        since, done = self.since.get()
        if not done:
            self.since.update((since, True))
            yield pd.DataFrame({"info_hash": [key[0]], "reason": ["time"]})

    def close(self) -> None:
        pass


def seeding_ends(status: DataFrame, minutes: float, ratio: float, late: str = "10 minutes") -> DataFrame:
    """status: (info_hash, at, progress, ratio) rows."""
    timed = status.withWatermark("at", late).select("info_hash", "at", F.unix_micros("at").alias("us"), "progress", "ratio")
    return timed.groupBy("info_hash").transformWithStateInPandas(SeedingClock(minutes, ratio), "info_hash long, reason string", "append", "eventTime")


STORE, ROCKS = "spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def read_stream(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table's files as a stream. The pattern names the one table; a plain path would have to be a folder."""
    return spark.readStream.schema(spark.read.parquet(f"{sf_dir}/{name}.parquet").schema).parquet(f"{sf_dir}/{name}.parque[t]")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share; where the session names none, a temporary one, on a single machine only."""
    shared = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not shared and not re.match(r"local(\[|$)", spark.sparkContext.master):
        raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
    return (shared or tempfile.mkdtemp(prefix="quadrel-")).rstrip("/")


def drained(stream: DataFrame, mode: str = "append") -> DataFrame:
    """What the stream gives for all that is there, with the number of its trigger.

    Each trigger's rows are written under their number in the shared folder, so that a trigger that is run again replaces its own rows.
    """
    spark = stream.sparkSession
    folder, before = f"{shared_dir(spark)}/stream-{uuid.uuid4().hex}", spark.conf.get(STORE)

    def keep(rows: DataFrame, trigger: int) -> None:
        rows.write.mode("overwrite").parquet(f"{folder}/out/trigger={trigger}")

    spark.conf.set(STORE, ROCKS)
    try:
        stream.writeStream.foreachBatch(keep).outputMode(mode).trigger(availableNow=True).option("checkpointLocation", f"{folder}/state").start().awaitTermination()
    finally:
        spark.conf.set(STORE, before)
    return spark.read.schema(f"{', '.join(f'`{n}` {t}' for n, t in stream.dtypes)}, trigger int").option("basePath", f"{folder}/out").parquet(f"{folder}/out")
