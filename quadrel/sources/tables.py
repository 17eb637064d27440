"""Stored tables whose parts appear by a rename: whole, or not at all. Work that is broken off leaves nothing that is read, and work that is done again finds its part there.

Parts: named parts, each written once (the ranges of a bake). History: rows by hour and trigger, appended by streams and pruned by
hours. Buckets: rows by a hash of their key, upserted in place by rewriting the buckets that a batch touches.
"""

from __future__ import annotations

import re
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..streaming.streams import shared_dir


def stored(df: DataFrame, what: str) -> DataFrame:
    """df, written to the shared folder and read back: for what is used several times, and to cut a long plan."""
    path = f"{shared_dir(df.sparkSession)}/{what}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


class Folder:
    """A folder in the store that Spark's paths name."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")
        self._hadoop = spark._jvm.org.apache.hadoop.fs
        self._fs = self._at().getFileSystem(spark._jsc.hadoopConfiguration())
        self._fs.mkdirs(self._at())

    def _at(self, *names: str):
        return self._hadoop.Path("/".join((self.path, *names)))

    def names(self, *within: str) -> list[str]:
        """Folders in there; what begins with "_" is not one of them."""
        at = self._at(*within)
        return sorted(x.getPath().getName() for x in self._fs.listStatus(at) if not x.getPath().getName().startswith(("_", "."))) if self._fs.exists(at) else []

    def has(self, *names: str) -> bool:
        return self._fs.exists(self._at(*names))

    def aside(self) -> str:
        """Where something may be written before it is moved to its name."""
        return f"{self.path}/_aside/{uuid.uuid4().hex}"

    def move(self, source: str, *names: str) -> bool:
        """Rename to a name that isn't there yet; false if it is."""
        to = self._at(*names)
        self._fs.mkdirs(to.getParent())
        if self._fs.exists(to):
            return False
        return self._fs.rename(self._hadoop.Path(source), to)

    def drop(self, *names: str) -> None:
        self._fs.delete(self._at(*names), True)


def _plain(name: str) -> str:
    if not re.fullmatch(r"[A-Za-z0-9][\w.=-]*", name):
        raise ValueError(f"not a name of a part: {name!r}")
    return name


class Parts:
    def __init__(self, spark: SparkSession, path: str, schema: str):
        self.folder, self.schema = Folder(spark, path), schema

    def names(self) -> list[str]:
        return self.folder.names()

    def put(self, name: str, rows: DataFrame) -> bool:
        """Write rows as the part of that name; nothing is done, nor rows computed, if it is there."""
        if self.folder.has(_plain(name)):
            return False
        aside = self.folder.aside()
        rows.write.parquet(aside)
        moved = self.folder.move(aside, name)
        self.folder.drop("_aside")
        return moved

    def rows(self) -> DataFrame:
        return self.folder.spark.read.schema(self.schema).parquet(*(f"{self.folder.path}/{n}" for n in self.names())) if self.names() else self.folder.spark.createDataFrame([], self.schema)

    def clear(self) -> None:
        for name in self.names():
            self.folder.drop(name)


class History:
    """Rows with a time in seconds (column `at`), in folders of an hour and in them of the trigger that brought them."""

    def __init__(self, spark: SparkSession, path: str, schema: str, seconds: int = 3600):
        self.folder, self.schema, self.seconds = Folder(spark, path), schema, seconds

    def append(self, rows: DataFrame, trigger: int) -> None:
        """A trigger that comes again brings nothing new: its hours are there, or the rest of them are added."""
        aside = self.folder.aside()
        rows.withColumn("hour", F.floor(F.col("at") / self.seconds).cast("long")).write.partitionBy("hour").parquet(aside)
        own = Folder(self.folder.spark, aside)
        for hour in own.names():
            self.folder.move(f"{aside}/{hour}", hour, f"trigger={int(trigger)}")
        self.folder.drop("_aside")

    def sink(self, stream: DataFrame, checkpoint: str, **trigger):
        """Append a stream's triggers as they come."""
        return stream.writeStream.foreachBatch(lambda rows, n: self.append(rows, n)).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()

    def _since(self) -> int:
        return max((int(n.removeprefix("since-")) for n in self.folder.names("_since")), default=-(2**62))

    def prune(self, since: int) -> list[str]:
        """Forget rows before `since`: hours that are past go as folders, and of the hour that it cuts the rows before it are no longer read. The hours dropped."""
        if since > self._since():
            Folder(self.folder.spark, f"{self.folder.path}/_since/since-{int(since)}")
        past = [h for h in self.folder.names() if (int(h.removeprefix("hour=")) + 1) * self.seconds <= self._since()]
        for hour in past:
            self.folder.drop(hour)
        return past

    def rows(self) -> DataFrame:
        if not self.folder.names():
            return self.folder.spark.createDataFrame([], self.schema)
        stored = self.folder.spark.read.schema(f"{self.schema}, hour long, trigger long").parquet(self.folder.path)
        since = self._since()
        return stored.filter((F.col("at") >= since) & (F.col("hour") >= since // self.seconds)).drop("hour", "trigger")


class Buckets:
    """Rows by key in `n` buckets. A batch writes new versions of the buckets that it touches, then one commit makes all of them the latest; others' files stay as they are."""

    def __init__(self, spark: SparkSession, path: str, schema: str, key: str, n: int = 64):
        self.folder, self.schema, self.key, self.n = Folder(spark, path), schema, key, n

    def _commits(self) -> dict[str, int]:
        return {n.split("-", 1)[1]: int(n.split("-", 1)[0]) for n in self.folder.names("_commits")}

    def _bucket(self) -> Column:
        return F.pmod(F.xxhash64(self.key), F.lit(self.n)).cast("int")

    def latest(self) -> dict[str, str]:
        """Of each bucket the folder of its last version that was committed."""
        done, out = set(self._commits().values()), {}
        for bucket in self.folder.names():
            versions = [int(v.removeprefix("version=")) for v in self.folder.names(bucket)]
            if own := [v for v in versions if v in done]:
                out[bucket] = f"{self.folder.path}/{bucket}/version={max(own)}"
        return out

    def rows(self, buckets: list[str] | None = None) -> DataFrame:
        paths = [p for b, p in self.latest().items() if buckets is None or b in buckets]
        return self.folder.spark.read.schema(self.schema).parquet(*paths) if paths else self.folder.spark.createDataFrame([], self.schema)

    def merge(self, batch: str, new: DataFrame, merged) -> list[str]:
        """merged(old, new) gives what is kept of the touched buckets' old rows and the batch's. A batch that was committed changes nothing. The buckets written."""
        done = self._commits()
        if _plain(batch) in done:
            return []
        version = max(done.values(), default=0) + 1
        touched = [f"bucket={r.b}" for r in new.select(self._bucket().alias("b")).distinct().collect()]  # at most n
        aside = self.folder.aside()
        if touched:
            merged(self.rows(touched), new).withColumn("bucket", self._bucket()).write.partitionBy("bucket").parquet(aside)
        for bucket in Folder(self.folder.spark, aside).names():
            self.folder.drop(bucket, f"version={version}")  # of a batch that was broken off
            self.folder.move(f"{aside}/{bucket}", bucket, f"version={version}")
        Folder(self.folder.spark, f"{self.folder.path}/_commits/{version:012d}-{batch}")
        self.folder.drop("_aside")
        for bucket in touched:  # readers of the version before may still be at work; older ones are not
            for v in self.folder.names(bucket):
                if int(v.removeprefix("version=")) < version and v not in sorted(self.folder.names(bucket))[-2:]:
                    self.folder.drop(bucket, v)
        return touched
