"""Tile archives (PMTiles version 3) as a Spark data source and sink.

Reading: `spark.read.format("pmtiles").load(folder or file)` gives directory entries, with option view=headers one summary row for
each archive. Each leaf directory is a partition of its own, and filters on tile_id skip leaves. Files are read where the task
runs, so the path must be one that all executors see (a shared mount). `read_tiles` adds payloads by ranged reads.

Writing: `write_archive` stores each distinct content once, in order of its first tile, and lays out header, directories and data.
"""

from __future__ import annotations

import gzip
import hashlib
import json
import os
import struct
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, GreaterThan, GreaterThanOrEqual, InputPartition, LessThan, LessThanOrEqual

from ..operators.tiles import content_dedup, tile_offsets, tile_runs

#: Fixed values of the format: header size, largest header and root directory together, entries in a leaf.
HEADER, ROOT_LIMIT, LEAF = 127, 16384, 4096
LAYOUT = struct.Struct("<7sB11Q6BiiiiBii")
FIELDS = (
    "root_offset root_length metadata_offset metadata_length leaf_offset leaf_length data_offset data_length addressed entries contents "
    "clustered internal_compression tile_compression tile_type min_zoom max_zoom west south east north center_zoom center_lon center_lat"
).split()
TYPES = {0: "unknown", 1: "mvt", 2: "png", 3: "jpeg", 4: "webp", 5: "avif"}
ENTRIES = "archive string, tile_id long, offset long, length int, run_length int"
HEADERS = "archive string, format string, min_zoom int, max_zoom int, west double, south double, east double, north double, center_lon double, center_lat double, center_zoom int, addressed long, entries long, contents long, clustered boolean, metadata string"


def _varint(n: int) -> bytes:
    out = bytearray()
    while n > 127:
        out.append(n & 127 | 128)
        n >>= 7
    out.append(n)
    return bytes(out)


def _varints(data: bytes) -> Iterator[int]:
    n = shift = 0
    for b in data:
        n |= (b & 127) << shift
        shift += 7
        if b < 128:
            yield n
            n = shift = 0


def encode_directory(entries: list[tuple[int, int, int, int]]) -> bytes:
    """(tile_id, offset, length, run_length) entries, ascending: ids as gaps, and an offset that follows the entry before as 0."""
    out = [_varint(len(entries))]
    out += [_varint(e[0] - p) for e, p in zip(entries, [0, *(e[0] for e in entries)], strict=False)]
    out += [_varint(e[3]) for e in entries] + [_varint(e[2]) for e in entries]
    end = None
    for e in entries:
        out.append(_varint(0 if e[1] == end else e[1] + 1))
        end = e[1] + e[2]
    return gzip.compress(b"".join(out), mtime=0)


def decode_directory(data: bytes, compression: int = 2) -> list[tuple[int, int, int, int]]:
    v = _varints(gzip.decompress(data) if compression == 2 else data)
    n = next(v)
    ids, at = [], 0
    for _ in range(n):
        at += next(v)
        ids.append(at)
    runs, lengths = [next(v) for _ in range(n)], [next(v) for _ in range(n)]
    offsets: list[int] = []
    for i in range(n):
        o = next(v)
        offsets.append(offsets[-1] + lengths[i - 1] if o == 0 and i else o - 1)
    return list(zip(ids, offsets, lengths, runs, strict=True))


def read_header(f) -> dict:
    f.seek(0)
    magic, version, *values = LAYOUT.unpack(f.read(HEADER))
    if magic != b"PMTiles" or version != 3:
        raise ValueError("not a PMTiles version 3 archive")
    return dict(zip(FIELDS, values, strict=True))


def _range(f, offset: int, length: int) -> bytes:
    f.seek(offset)
    return f.read(length)


class _Leaf(InputPartition):
    def __init__(self, path: str, offset: int, length: int, low: int, high: int):
        super().__init__(offset)
        self.path, self.offset, self.length, self.low, self.high = path, offset, length, low, high


class _Reader(DataSourceReader):
    def __init__(self, path: str, view: str):
        self.files = sorted(os.path.join(path, x) for x in os.listdir(path) if x.endswith(".pmtiles")) if os.path.isdir(path) else [path]
        self.view, self.low, self.high = view, 0, 1 << 62

    def pushFilters(self, filters):  # noqa: N802
        """Bounds on tile_id choose leaves; Spark still tests each row."""
        for x in filters:
            if getattr(x, "attribute", None) == ("tile_id",) and self.view == "entries":
                if isinstance(x, (EqualTo, GreaterThan, GreaterThanOrEqual)):
                    self.low = max(self.low, x.value)
                if isinstance(x, (EqualTo, LessThan, LessThanOrEqual)):
                    self.high = min(self.high, x.value)
            yield x

    def partitions(self):
        out = []
        for path in self.files:
            with open(path, "rb") as f:
                h = read_header(f)
                if self.view == "headers":
                    out.append(_Leaf(path, 0, 0, 0, 0))
                    continue
                root = decode_directory(_range(f, h["root_offset"], h["root_length"]), h["internal_compression"])
                leaves = [e for e in root if e[3] == 0]
                if len(leaves) < len(root):
                    out.append(_Leaf(path, h["root_offset"], h["root_length"], self.low, self.high))
                for e, after in zip(leaves, [*(x[0] for x in leaves[1:]), 1 << 62], strict=False):
                    if e[0] <= self.high and after > self.low:
                        out.append(_Leaf(path, h["leaf_offset"] + e[1], e[2], self.low, self.high))
        return out

    def read(self, part: _Leaf):
        with open(part.path, "rb") as f:
            h = read_header(f)
            name = os.path.basename(part.path)
            if self.view == "headers":
                raw = _range(f, h["metadata_offset"], h["metadata_length"])
                text = (gzip.decompress(raw) if h["internal_compression"] == 2 else raw).decode()
                e7 = [h[k] / 1e7 for k in ("west", "south", "east", "north", "center_lon", "center_lat")]
                yield (name, TYPES.get(h["tile_type"], "unknown"), h["min_zoom"], h["max_zoom"], *e7, h["center_zoom"], h["addressed"], h["entries"], h["contents"], bool(h["clustered"]), text)
                return
            for tile_id, offset, length, run in decode_directory(_range(f, part.offset, part.length), h["internal_compression"]):
                if run and tile_id <= part.high and tile_id + run > part.low:
                    yield name, tile_id, h["data_offset"] + offset, length, run


class PMTilesSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "pmtiles"

    def schema(self) -> str:
        return HEADERS if self.options.get("view") == "headers" else ENTRIES

    def reader(self, schema) -> DataSourceReader:
        return _Reader(self.options["path"], self.options.get("view", "entries"))


def register(spark: SparkSession) -> None:
    spark.dataSource.register(PMTilesSource)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")


def scan(spark: SparkSession, path: str, view: str = "entries") -> DataFrame:
    register(spark)
    return spark.read.format("pmtiles").option("view", view).load(path)


def scan_folder(spark: SparkSession, folder: str, low: int = 0, high: int = 1 << 62, files: int = 64, tasks: int | None = None) -> DataFrame:
    """Directory entries of all archives of a folder in two stages, for many archives: the driver only lists names; headers and root directories are read in tasks of about `files` archives, and the leaves that hold ids from low to high are rows, dealt evenly to the tasks that read them."""
    names = sorted(x for x in os.listdir(folder) if x.endswith(".pmtiles"))
    listed = spark.createDataFrame([(os.path.join(folder, x),) for x in names], "path string").repartition(max(1, -(-len(names) // files)))

    def roots(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for path in batch.column(0).to_pylist():
                with open(path, "rb") as f:
                    h = read_header(f)
                    root = decode_directory(_range(f, h["root_offset"], h["root_length"]), h["internal_compression"])
                leaves = [e for e in root if e[3] == 0]
                if len(leaves) < len(root):
                    out.append((path, h["root_offset"], h["root_length"], h["data_offset"], h["internal_compression"]))
                for e, after in zip(leaves, [*(x[0] for x in leaves[1:]), 1 << 62], strict=False):
                    if e[0] <= high and after > low:
                        out.append((path, h["leaf_offset"] + e[1], e[2], h["data_offset"], h["internal_compression"]))
            columns = list(zip(*out, strict=True)) or [[]] * 5
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.string() if i == 0 else pa.int64()) for i, c in enumerate(columns)], names=["path", "at", "length", "data", "compression"])

    def entries(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                with open(row["path"], "rb") as f:
                    found = [e for e in decode_directory(_range(f, row["at"], row["length"]), row["compression"]) if e[3] and e[0] <= high and e[0] + e[3] > low]
                ids, offsets, lengths, counts = zip(*found, strict=True) if found else ([],) * 4
                kinds = pa.schema([("archive", pa.string()), ("tile_id", pa.int64()), ("offset", pa.int64()), ("length", pa.int32()), ("run_length", pa.int32())])
                yield pa.RecordBatch.from_pydict({"archive": [os.path.basename(row["path"])] * len(found), "tile_id": ids, "offset": [row["data"] + o for o in offsets], "length": lengths, "run_length": counts}, kinds)

    n = tasks or int(spark.conf.get("spark.sql.shuffle.partitions"))
    leaves = listed.mapInArrow(roots, "path string, at long, length long, data long, compression long").repartition(n)
    return leaves.mapInArrow(entries, ENTRIES)


def tile_ids(entries: DataFrame) -> DataFrame:
    """One row for each tile: runs opened."""
    return entries.select("archive", F.explode(F.sequence("tile_id", F.col("tile_id") + F.col("run_length") - 1)).alias("tile_id"), "offset", "length")


def read_tiles(entries: DataFrame, folder: str) -> DataFrame:
    """Entries with their payload, read in order of archive and offset."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        name, f = None, None
        for batch in batches:
            out = []
            for row in batch.to_pylist():
                if row["archive"] != name:
                    if f:
                        f.close()
                    name, f = row["archive"], open(os.path.join(folder, row["archive"]), "rb")  # noqa: SIM115
                out.append(_range(f, row["offset"], row["length"]))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(out, pa.binary())], names=[*batch.schema.names, "content"])
        if f:
            f.close()

    ordered = entries.repartitionByRange("archive", "offset").sortWithinPartitions("archive", "offset")
    return ordered.mapInArrow(run, ", ".join(f"{n} {t}" for n, t in entries.dtypes) + ", content binary")


def _leaves(entries: DataFrame, size: int, partitions: int) -> DataFrame:
    """(first, entries, blob): leaf directories of up to `size` entries within ranges of tile ids, each encoded in a task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[int, int, int, int]] = []

        def out(part: list[tuple[int, int, int, int]]) -> pa.RecordBatch:
            return pa.RecordBatch.from_pydict({"first": [part[0][0]], "entries": [len(part)], "blob": [encode_directory(part)]}, pa.schema([("first", pa.int64()), ("entries", pa.int64()), ("blob", pa.binary())]))

        for batch in batches:
            held += zip(*(batch.column(n).to_pylist() for n in ("tile_id", "offset", "length", "run_length")), strict=True)
            while len(held) >= size:
                yield out(held[:size])
                held = held[size:]
        if held:
            yield out(held)

    return entries.select("tile_id", "offset", "length", "run_length").repartitionByRange(partitions, "tile_id").sortWithinPartitions("tile_id").mapInArrow(run, "first long, entries long, blob binary")


def _put(blobs: DataFrame, path: str, base: int) -> int:
    """Each blob (offset, blob) at its place in a file that is there at its full size: tasks write their own ranges, and one that runs again writes the same bytes. How many bytes were written."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        done = 0
        with open(path, "r+b") as f:
            for batch in batches:
                for offset, blob in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                    data = blob.as_buffer()
                    f.seek(base + offset)
                    done += f.write(data)
            f.flush()
            os.fsync(f.fileno())
        yield pa.RecordBatch.from_pydict({"n": [done]})

    return blobs.select("offset", "blob").mapInArrow(run, "n long").agg(F.sum("n")).first()[0] or 0


def write_archive(payloads: DataFrame, destination: str, header: dict | None = None, metadata: dict | None = None, scratch: str | None = None, partitions: int | None = None) -> dict:
    """Write (tile_id, content) rows as one archive on a shared mount.

    Spark finds the distinct contents, their offsets (tile_offsets) and the runs of tiles (tile_runs), and encodes leaf directories in tasks.
    All offsets are known before a byte is written, so the driver lays out header and root directory (of one row for each leaf: its first id and size) and
    tasks write leaves and contents into their own ranges of the one file that the format asks for. It gets its name when all bytes are there.
    """
    spark = payloads.sparkSession
    n = partitions or int(spark.conf.get("spark.sql.shuffle.partitions"))
    scratch = f"{scratch or destination + '.parts'}/{uuid.uuid4().hex}"
    rows = payloads.select(F.col("tile_id").cast("long").alias("tile_id"), F.col("content").cast("binary").alias("content"))

    def kept(df: DataFrame, name: str) -> DataFrame:
        df.write.parquet(f"{scratch}/{name}")
        return spark.read.schema(df.schema).parquet(f"{scratch}/{name}")

    contents = kept(tile_offsets(content_dedup(rows)).select("digest", "tile_id", "length", "offset"), "contents")
    entries = kept(tile_runs(rows).join(contents.select("digest", "length", "offset"), "digest").select("tile_id", "offset", "length", "run_length"), "entries")
    totals = entries.agg(F.count(F.lit(1)).alias("entries"), F.coalesce(F.sum("run_length"), F.lit(0)).alias("addressed")).first()
    held = contents.agg(F.count(F.lit(1)).alias("contents"), F.coalesce(F.sum("length"), F.lit(0)).alias("bytes")).first()
    leaves, leaf_bytes, size = None, 0, LEAF
    root = encode_directory([tuple(r) for r in entries.orderBy("tile_id").collect()]) if totals.entries <= LEAF else b""
    if not root or len(root) > ROOT_LIMIT - HEADER:
        while True:
            leaves = kept(_leaves(entries, size, n), f"leaves-{size}")
            top, at = [], 0  # first id, offset, length
            for r in leaves.select("first", F.octet_length("blob").alias("n")).orderBy("first").collect():  # a row for each leaf of thousands of entries
                top.append((r.first, at, r.n, 0))
                at += r.n
            root, leaf_bytes = encode_directory(top), at
            if len(root) <= ROOT_LIMIT - HEADER:
                break
            size, n = size * 2, max(1, n // 2)
    meta = gzip.compress(json.dumps(metadata or {}).encode(), mtime=0)
    h = dict.fromkeys(FIELDS, 0) | {"internal_compression": 2, "tile_compression": 1} | (header or {})
    h |= {"root_offset": HEADER, "root_length": len(root), "metadata_offset": HEADER + len(root), "metadata_length": len(meta)}
    h |= {"leaf_offset": h["metadata_offset"] + len(meta), "leaf_length": leaf_bytes}
    h |= {"data_offset": h["leaf_offset"] + leaf_bytes, "data_length": held.bytes, "addressed": totals.addressed, "entries": totals.entries, "contents": held.contents, "clustered": 1}
    path = f"{destination}.{uuid.uuid4().hex}"
    with open(path, "wb") as out:
        out.write(LAYOUT.pack(b"PMTiles", 3, *(h[k] for k in FIELDS)) + root + meta)
        out.truncate(h["data_offset"] + held.bytes)
    written = 0
    if leaves is not None:
        places = spark.createDataFrame([(first, offset) for first, offset, _, _ in top], "first long, offset long")
        written += _put(leaves.join(places, "first"), path, h["leaf_offset"])
    owners = contents.select("tile_id", "offset")  # each content where its first tile has it
    written += _put(rows.join(owners, "tile_id").select("offset", F.col("content").alias("blob")), path, h["data_offset"])
    if written != leaf_bytes + held.bytes:
        raise OSError(f"{destination}: {written} bytes were written of {leaf_bytes + held.bytes}")
    os.replace(path, destination)
    return {"addressed": totals.addressed, "entries": totals.entries, "contents": held.contents, "bytes": held.bytes, "sha1": hashlib.sha1(root).hexdigest()}
