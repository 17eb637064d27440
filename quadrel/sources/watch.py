"""Watched folders as a stream of listings.

Spark's file source gives each path once, so it never sees a file grow. This source lists its folders at every trigger, in a task for each, and gives
all files that are there with their length and time: the observations that `settled_files` waits on. The offset is the time of the listing, so a
restart goes on with new ones. Folders must be seen by all executors.
"""

from __future__ import annotations

import fnmatch
import json
import os
import time
from datetime import UTC, datetime

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceStreamReader, InputPartition

from ..functions.rules import glob_regex
from ..streaming.streams import settled_files

LISTING = "folder string, path string, length long, modified timestamp"


class _Folder(InputPartition):
    def __init__(self, folder: str):
        super().__init__(folder)
        self.folder = folder


class _Lister(DataSourceStreamReader):
    def __init__(self, options: dict):
        self.folders, self.pattern = json.loads(options["folders"]), options.get("pattern", "*")
        self.deep = options.get("recursive", "true").lower() == "true"

    def initialOffset(self) -> dict:  # noqa: N802
        return {"listed": 0}

    def latestOffset(self) -> dict:  # noqa: N802
        return {"listed": time.time_ns() // 1000}

    def partitions(self, start: dict, end: dict) -> list[_Folder]:
        return [_Folder(f) for f in self.folders]

    def read(self, part: _Folder):
        for at, _, names in os.walk(part.folder):
            for name in names:
                path = os.path.join(at, name)
                if fnmatch.fnmatchcase(name.lower(), self.pattern.lower()):
                    try:
                        s = os.stat(path)
                    except FileNotFoundError:  # gone since it was listed
                        continue
                    yield part.folder, path, s.st_size, datetime.fromtimestamp(s.st_mtime, UTC)
            if not self.deep:
                break


class WatchSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "watched"

    def schema(self) -> str:
        return LISTING

    def streamReader(self, schema) -> DataSourceStreamReader:  # noqa: N802
        return _Lister(self.options)


def listings(spark: SparkSession, folders: list[str], pattern: str = "*.pmtiles", recursive: bool = True) -> DataFrame:
    """The files of the folders at each trigger."""
    spark.dataSource.register(WatchSource)
    own = sorted({f.rstrip("/") for f in folders})
    return spark.readStream.format("watched").option("folders", json.dumps(own)).option("pattern", pattern).option("recursive", str(recursive)).load()


def first_rule(rules: list[dict]) -> Column:
    """Of (folder, name, match: a glob or none, latest: a name that is none of the builds) entries the first of the file's folder that takes its base name, by the entries' order."""
    base, cases = F.regexp_extract("path", r"([^/]*)$", 1), []
    for r in rules:
        takes = F.col("folder") == F.lit(r["folder"].rstrip("/"))
        if r.get("match"):
            takes &= base.rlike(glob_regex(r["match"]))
        if r.get("latest"):
            takes &= base != F.lit(os.path.basename(r["latest"]))
        cases.append(F.when(takes, F.lit(r["name"])))
    return F.coalesce(*cases)


def arrivals(spark: SparkSession, rules: list[dict], seconds: int = 30) -> DataFrame:
    """(path, length, rule) of files that have stood still: each once, by the first rule of its folder; the longest wait that a folder's rules ask for holds for all."""
    wait = max([r.get("seconds", seconds) for r in rules], default=seconds)
    files = settled_files(listings(spark, [r["folder"] for r in rules]), wait)
    folders = sorted({r["folder"].rstrip("/") for r in rules}, key=len, reverse=True)
    folder = F.coalesce(*(F.when(F.col("path").startswith(f + "/"), F.lit(f)) for f in folders))
    return files.withColumn("folder", folder).withColumn("rule", first_rule(rules)).filter("rule is not null").select("path", "length", "rule")
