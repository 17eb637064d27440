"""MBTiles databases as a Spark data source: partitions by zoom and range of columns; rows flipped from TMS to XYZ.

A folder of databases is scanned in two stages: tasks open them and give their zooms' ranges of columns, which are dealt evenly and read.
Databases are opened without locks, for shared mounts often have none: they must not change while they are read.
"""

from __future__ import annotations

import os
import sqlite3
import uuid
from collections.abc import Iterator
from pathlib import Path

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition


TILES = "database string, z int, x long, y long, content binary"
#: Largest bytes of content and number of rows that a task hands over at once.
BATCH_BYTES, BATCH_ROWS = 16 << 20, 10_000


def _open(path: str, mode: str = "ro") -> sqlite3.Connection:
    return sqlite3.connect(f"{Path(path).absolute().as_uri()}?mode={mode}&vfs=unix-none", uri=True)


class _Part(InputPartition):
    def __init__(self, z: int, low: int, high: int):
        super().__init__(z)
        self.z, self.low, self.high = z, low, high


class _Reader(DataSourceReader):
    def __init__(self, path: str, view: str, columns: int):
        self.path, self.view, self.columns = path, view, columns

    def _rows(self, sql: str, *args):
        db = _open(self.path)
        try:
            yield from db.execute(sql, args)
        finally:
            db.close()

    def partitions(self):
        if self.view == "metadata":
            return [_Part(0, 0, 0)]
        out = []
        for z, low, high in self._rows("SELECT zoom_level, min(tile_column), max(tile_column) FROM tiles GROUP BY zoom_level"):
            out += [_Part(z, x, min(high, x + self.columns - 1)) for x in range(low, high + 1, self.columns)]
        return out

    def read(self, part: _Part):
        if self.view == "metadata":
            yield from self._rows("SELECT name, value FROM metadata")
            return
        for z, x, y, data in self._rows("SELECT zoom_level, tile_column, tile_row, tile_data FROM tiles WHERE zoom_level = ? AND tile_column BETWEEN ? AND ?", part.z, part.low, part.high):
            yield z, x, (1 << z) - 1 - y, data


class MBTilesSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "mbtiles"

    def schema(self) -> str:
        return "name string, value string" if self.options.get("view") == "metadata" else "z int, x long, y long, content binary"

    def reader(self, schema) -> DataSourceReader:
        return _Reader(self.options["path"], self.options.get("view", "tiles"), int(self.options.get("columns", 256)))


def scan(spark: SparkSession, path: str, view: str = "tiles") -> DataFrame:
    spark.dataSource.register(MBTilesSource)
    return spark.read.format("mbtiles").option("view", view).load(path)


def _listed(spark: SparkSession, folder: str, files: int) -> DataFrame:
    names = sorted(x for x in os.listdir(folder) if x.endswith(".mbtiles"))
    return spark.createDataFrame([(os.path.join(folder, x),) for x in names], "path string").repartition(max(1, -(-len(names) // files)))


def folder_ranges(spark: SparkSession, folder: str, tiles: int = 50_000, files: int = 64) -> DataFrame:
    """(path, z, low, high, tiles) of all databases of a folder: ranges of columns that hold some `tiles` tiles each, or one column. The driver lists names only; no content is read."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path in batch.column(0).to_pylist():
                parts: list[list] = []
                for z, x, n in _Reader(path, "tiles", 0)._rows("SELECT zoom_level, tile_column, count(*) FROM tiles GROUP BY zoom_level, tile_column ORDER BY zoom_level, tile_column"):
                    if parts and parts[-1][1] == z and parts[-1][4] + n <= tiles:
                        parts[-1][3:] = x, parts[-1][4] + n
                    else:
                        parts.append([path, z, x, x, n])
                cells = list(zip(*parts, strict=True)) or [[]] * 5
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.string() if i == 0 else pa.int64()) for i, c in enumerate(cells)], names=["path", "z", "low", "high", "tiles"])

    return _listed(spark, folder, files).mapInArrow(run, "path string, z long, low long, high long, tiles long")


def scan_folder(spark: SparkSession, folder: str, tiles: int = 50_000, files: int = 64, tasks: int | None = None) -> DataFrame:
    """(database, z, x, y, content) of all databases of a folder, by ranges of columns that follow where the tiles are."""

    def pack(name: str, rows: list[tuple]) -> pa.RecordBatch:
        z, x, y, data = zip(*rows, strict=True)
        return pa.RecordBatch.from_arrays([pa.array([name] * len(rows)), pa.array(z, pa.int32()), pa.array(x, pa.int64()), pa.array(y, pa.int64()), pa.array(data, pa.binary())], names=["database", "z", "x", "y", "content"])

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in batch.to_pylist():
                name, rows, size = os.path.basename(part["path"]), [], 0
                for row in _Reader(part["path"], "tiles", 0).read(_Part(part["z"], part["low"], part["high"])):
                    rows.append(row)
                    size += len(row[3] or b"")
                    if size >= BATCH_BYTES or len(rows) >= BATCH_ROWS:
                        yield pack(name, rows)
                        rows, size = [], 0
                if rows:
                    yield pack(name, rows)

    n = tasks or int(spark.conf.get("spark.sql.shuffle.partitions"))
    return folder_ranges(spark, folder, tiles, files).repartition(n).mapInArrow(read, TILES)


def folder_metadata(spark: SparkSession, folder: str, files: int = 64) -> DataFrame:
    """(database, name, value) of all databases of a folder, read in tasks; a database without metadata has none."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path in batch.column(0).to_pylist():
                rows = list(_Reader(path, "metadata", 0).read(_Part(0, 0, 0)))
                yield pa.RecordBatch.from_arrays([pa.array([os.path.basename(path)] * len(rows), pa.string()), *(pa.array([r[k] for r in rows], pa.string()) for k in (0, 1))], names=["database", "name", "value"])

    return _listed(spark, folder, files).mapInArrow(run, "database string, name string, value string")


def zoom_ranges(metadata: DataFrame, tiles: DataFrame) -> DataFrame:
    """Of each database what zoom_range gives of one. tiles: (database, z) rows, of tiles or of ranges of them."""
    named = metadata.groupBy("database").agg(*(F.max(F.when(F.col("name") == n, F.col("value").try_cast("int"))).alias(n) for n in ("minzoom", "maxzoom")))
    held = tiles.groupBy("database").agg(F.min("z").alias("_a"), F.max("z").alias("_b"))
    return held.join(named, "database", "full").select("database", F.coalesce("minzoom", "_a").alias("min_zoom"), F.coalesce("maxzoom", "_b").alias("max_zoom"))


def write_databases(tiles: DataFrame, folder: str, metadata: DataFrame | None = None) -> int:
    """Databases of (database, z, x, y, content) tiles, each by the one task that its format asks for, row by row; metadata: (database, name, value). Gives their number.

    A database is written under a name of its own and renamed when it is whole, so a task that runs again replaces it. Split a large tile set over several databases.
    """
    blank = lambda kinds: [F.lit(None).cast(k).alias(n) for n, k in kinds]
    rows = tiles.select("database", F.col("z").cast("int").alias("z"), F.col("x").cast("long").alias("x"), F.col("y").cast("long").alias("y"), F.col("content").cast("binary").alias("content"), *blank((("name", "string"), ("value", "string"))))
    if metadata is not None:
        rows = rows.unionByName(metadata.select("database", *blank((("z", "int"), ("x", "long"), ("y", "long"), ("content", "binary"))), "name", "value"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        name, db, aside, done = None, None, None, []

        def close() -> None:
            if db is not None:
                db.execute("CREATE UNIQUE INDEX tile_index ON tiles (zoom_level, tile_column, tile_row)")
                db.commit()
                db.close()
                os.replace(aside, os.path.join(folder, name))
                done.append(name)

        for batch in batches:
            for row in batch.to_pylist():
                if row["database"] != name:
                    close()
                    name = row["database"]
                    aside = os.path.join(folder, f".{uuid.uuid4().hex}")
                    db = _open(aside, "rwc")
                    db.execute("PRAGMA journal_mode = OFF")
                    db.execute("CREATE TABLE metadata (name TEXT, value TEXT)")
                    db.execute("CREATE TABLE tiles (zoom_level INTEGER, tile_column INTEGER, tile_row INTEGER, tile_data BLOB)")
                if row["name"] is not None:
                    db.execute("INSERT INTO metadata VALUES (?, ?)", (row["name"], row["value"]))
                else:
                    db.execute("INSERT INTO tiles VALUES (?, ?, ?, ?)", (row["z"], row["x"], (1 << row["z"]) - 1 - row["y"], row["content"]))
        close()
        yield pa.RecordBatch.from_arrays([pa.array(done, pa.string())], names=["database"])

    os.makedirs(folder, exist_ok=True)
    ordered = rows.repartition("database").sortWithinPartitions("database", "z", "x", "y")
    return ordered.mapInArrow(run, "database string").count()


def zoom_range(metadata: DataFrame, tiles: DataFrame) -> DataFrame:
    """min_zoom and max_zoom of the metadata, else of the tiles."""
    named = metadata.agg(*(F.max(F.when(F.col("name") == n, F.col("value").try_cast("int"))).alias(n) for n in ("minzoom", "maxzoom")))
    held = tiles.agg(F.min("z").alias("_a"), F.max("z").alias("_b"))
    return named.crossJoin(held).select(F.coalesce("minzoom", "_a").alias("min_zoom"), F.coalesce("maxzoom", "_b").alias("max_zoom"))  # one row on either side
