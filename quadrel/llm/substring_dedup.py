"""Operator 1. Substring dedup with a Count-min prefilter.

Pass 1 counts every window of words in Count-min sketches, one for each piece of a partition. A sketch is kept as bitmaps
of cells seen once and at least twice, cut into shards; shards are merged by a shuffle, so no task holds all pieces.
The merged sketch has a fixed largest size (`max_log2_cells`), which bounds what is broadcast; a window's cells say twice
whenever the window occurs twice, so none is lost, and beyond that size only more windows are estimated repeated.
Pass 2 groups exactly (by 96 bits of a hash of the window's bytes) the windows estimated repeated. Within a batch of
documents only the earliest occurrence can be the first of all, so the others are removed there and then, and each batch
sends one entry for each window at most, whatever the number of copies. Entries travel packed by bucket of their hash; the
number of buckets follows the input, so that one bucket fits in a task.

Each row is cut by its own windows: rows that share a doc_id are told apart by a 128-bit hash of their text, so rows of one
name have the same text and the same cuts. Where rows share a doc_id, a window is earlier by its start alone, and of equal starts none is
earlier. A null doc_id ranks before all others; among rows without one the hash of their text decides. Null texts have no
words. Repeated rows are each cut alike. Empty tables give empty results; other columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import BATCH_BYTES, NULL_KEY, WindowHash, flat, key_of, stored, text_batches

#: Rows of the sketch, bits of a shard, windows of which one piece of a sketch is made, and windows of a bucket.
DEPTH, SHARD_BITS, PIECE, BUCKET = 2, 21, 6_000_000, 1_000_000
#: Shared ids up to which they are broadcast.
BROADCAST_IDS = 4_000_000
MULTIPLIERS = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93)


def _cells(h: np.ndarray, row: int, bits: int) -> np.ndarray:
    return ((h * np.uint64(MULTIPLIERS[row])) >> np.uint64(64 - bits)).astype(np.int64)


def _gaps(cells: np.ndarray) -> bytes:
    """Ascending cells as one byte a gap; 255 stands for 255 cells without a hit."""
    gaps = np.diff(cells, prepend=-1)
    skips = gaps // 255
    out = np.full(len(gaps) + int(skips.sum()), 255, np.uint8)
    out[np.arange(len(gaps)) + np.cumsum(skips)] = gaps % 255
    return out.tobytes()


def _hits(gaps: bytes) -> np.ndarray:
    g = np.frombuffer(gaps, np.uint8)
    return (np.cumsum(g, dtype=np.int64) - 1)[g < 255]


def _piece(hashes: list[np.ndarray], bits: int) -> Iterator[tuple]:
    h, shard_bits = np.concatenate(hashes), min(bits, SHARD_BITS)
    for row in range(DEPTH):
        cells = np.sort(_cells(h, row, bits))
        repeat = np.concatenate([[False], cells[1:] == cells[:-1]])
        again, cells = np.unique(cells[repeat]), cells[~repeat]
        bounds = np.arange((1 << (bits - shard_bits)) + 1) << shard_bits
        at, at2 = np.searchsorted(cells, bounds), np.searchsorted(again, bounds)
        for shard in range(len(bounds) - 1):
            if at[shard] < at[shard + 1]:
                yield row, shard, _gaps(cells[at[shard] : at[shard + 1]] - bounds[shard]), _gaps(again[at2[shard] : at2[shard + 1]] - bounds[shard])


def _sketcher(width: int, bits: int):
    def sketch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher, held, n = WindowHash(width), [], 0

        def out() -> Iterator[pa.RecordBatch]:
            for x in _piece(held, bits):
                yield pa.RecordBatch.from_pydict({k: [v] for k, v in zip(("row", "shard", "once", "twice"), x, strict=True)}, SKETCH)

        for table in text_batches(batches):
            for text in table["text"]:
                h = hasher(flat(text.as_py()))[2]
                held.append(h)
                n += len(h)
                if n >= PIECE:
                    yield from out()
                    held, n = [], 0
        if n:
            yield from out()

    return sketch


SKETCH = pa.schema([("row", pa.int32()), ("shard", pa.int32()), ("once", pa.binary()), ("twice", pa.binary())])


def _merger(bits: int):
    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Pieces arrive sorted by row and shard; two bitmaps at a time are held."""
        packer, key, size = zstandard.ZstdCompressor(level=3), None, 1 << min(bits, SHARD_BITS)
        once, twice = np.zeros(size, bool), np.zeros(size, bool)

        def out() -> pa.RecordBatch:
            blob = packer.compress(np.packbits(twice, bitorder="little").tobytes())
            return pa.RecordBatch.from_pydict({"row": [key[0]], "shard": [key[1]], "twice": [blob]}, pa.schema([SKETCH.field(0), SKETCH.field(1), SKETCH.field(3)]))

        for batch in batches:
            for row, shard, a, b in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if key != (row, shard):
                    if key is not None:
                        yield out()
                    key = (row, shard)
                    once[:] = twice[:] = False
                hits = _hits(a)
                twice[hits[once[hits]]] = True
                twice[_hits(b)] = True
                once[hits] = True
        if key is not None:
            yield out()

    return merge


#: A blob holds what a batch sends to a bucket of hashes; a row without one is a run of words to remove for sure. `doc` and the two hashes of the text name a row.
PLACE = [("doc", pa.int64()), ("row", pa.int64()), ("row2", pa.int64()), ("start", pa.int32()), ("stop", pa.int32())]
FOUND = pa.schema([("bucket", pa.int64()), ("blob", pa.binary()), *PLACE])
LATE = pa.schema(PLACE)
LATE_SQL = "doc long, row long, row2 long, start int, stop int"


def _digests(words: bytes, starts: np.ndarray, ends: np.ndarray) -> bytes:
    digest = xxhash.xxh3_128_digest
    return b"".join([digest(words[a:b])[:12] for a, b in zip(starts.tolist(), ends.tolist(), strict=True)])


def _numbered(names: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Names (doc, row, row2) sorted and once each, the number of each given name among them, and their ranks: names of one doc are equal, those without a doc are not."""
    names, number = np.unique(names, axis=0, return_inverse=True)
    new = np.concatenate([[True], (names[1:, 0] != names[:-1, 0]) | (names[1:, 0] == NULL_KEY)])[: len(names)]
    return names, number.reshape(-1).astype(np.int32), np.cumsum(new, dtype=np.int32)


class _Windows:
    """Columns of windows: two hashes of their words, the number of their row in `names`, and their start."""

    __slots__ = ("h1", "h2", "row", "start", "names", "ranks")

    def __init__(self, h1: np.ndarray, h2: np.ndarray, row: np.ndarray, start: np.ndarray, names: np.ndarray, ranks: np.ndarray):
        self.h1, self.h2, self.row, self.start, self.names, self.ranks = h1, h2, row, start, names, ranks

    def __len__(self) -> int:
        return len(self.row)

    def take(self, at) -> _Windows:
        return _Windows(self.h1[at], self.h2[at], self.row[at], self.start[at], self.names, self.ranks)

    def pack(self) -> bytes:
        """Windows in order of place, so that their rows and starts pack to little beside the hashes."""
        new = np.flatnonzero(np.concatenate([[True], self.row[1:] != self.row[:-1]]))
        counts = np.diff(new, append=len(self)).astype(np.int32)
        places = self.names[self.row[new]].tobytes() + counts.tobytes() + np.diff(self.start, prepend=np.int32(0)).tobytes()
        return len(self).to_bytes(8, "little") + len(new).to_bytes(8, "little") + self.h1.tobytes() + self.h2.tobytes() + zstandard.ZstdCompressor(level=3).compress(places)

    @staticmethod
    def unpack(blobs: list[bytes]) -> _Windows:
        h1, h2, names, counts, starts = [], [], [], [], []
        for blob in blobs:
            n, k = (int.from_bytes(blob[i : i + 8], "little") for i in (0, 8))
            places = zstandard.ZstdDecompressor().decompress(blob[16 + 12 * n :])
            h1.append(np.frombuffer(blob, np.uint64, n, 16))
            h2.append(np.frombuffer(blob, np.uint32, n, 16 + 8 * n))
            names.append(np.frombuffer(places, np.int64, 3 * k).reshape(k, 3))
            counts.append(np.frombuffer(places, np.int32, k, 24 * k))
            starts.append(np.cumsum(np.frombuffer(places, np.int32, n, 28 * k), dtype=np.int32))
        own, number, ranks = _numbered(np.concatenate(names))
        return _Windows(np.concatenate(h1), np.concatenate(h2), np.repeat(number, np.concatenate(counts)), np.concatenate(starts), own, ranks)

    def runs(self, width: int) -> tuple[np.ndarray, ...]:
        """The words that these windows cover, as runs for each row: doc, row, row2, start, stop."""
        order = np.lexsort((self.start, self.row))
        row, start = self.row[order], self.start[order]
        new = np.concatenate([[True], (row[1:] != row[:-1]) | (start[1:] > start[:-1] + width)])
        last = np.concatenate([np.flatnonzero(new)[1:], [len(row)]]) - 1
        return *map(np.ascontiguousarray, self.names[row[new]].T), start[new], (start[last] + width).astype(np.int32)

    def split(self) -> tuple[_Windows, _Windows]:
        """(windows that none of these precedes, once for each place; those that start later than an equal one)."""
        order = np.lexsort((self.row, self.start, self.ranks[self.row], self.h2, self.h1))
        w = self.take(order)
        rank = self.ranks[w.row]
        equal = (w.h1[1:] == w.h1[:-1]) & (w.h2[1:] == w.h2[:-1])
        of = np.maximum.accumulate(np.where(np.concatenate([[True], ~equal]), np.arange(len(w)), 0))
        late = (rank != rank[of]) | (w.start != w.start[of])
        again = np.concatenate([[False], equal & (w.row[1:] == w.row[:-1]) & (w.start[1:] == w.start[:-1])])
        return w.take(~late & ~again), w.take(late)


def _finder(width: int, bits: int, bucket_bits: int, sketch):
    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        opener, shard_bits, hasher = zstandard.ZstdDecompressor(), min(bits, SHARD_BITS), WindowHash(width)
        rows = [np.zeros(1 << max(0, bits - 3), np.uint8) for _ in range(DEPTH)]
        for row, shard, blob in sketch.value:
            part = np.frombuffer(opener.decompress(blob), np.uint8)
            rows[row][shard * (1 << (shard_bits - 3)) :][: len(part)] = part
        for table in text_batches(batches, limit=BATCH_BYTES * 3 // 4):
            digests, places, starts = [], [], []
            for *place, text in zip(*(table[c].to_pylist() for c in ("_key", "row", "row2")), table["text"], strict=True):
                words = flat(text.as_py())
                first, ends, h = hasher(words)
                maybe = np.ones(len(h), bool)
                for row, bitmap in enumerate(rows):
                    c = _cells(h, row, bits)
                    maybe &= (bitmap[c >> 3] >> (c & 7).astype(np.uint8)) & 1 > 0
                at = np.flatnonzero(maybe)
                if len(at):
                    digests.append(_digests(words, first[at], ends[at + width - 1]))
                    places.append(place)
                    starts.append(at)
            if not digests:
                continue
            parts = np.frombuffer(b"".join(digests), np.dtype([("a", "<u8"), ("b", "<u4")]))
            digests.clear()
            names, number, ranks = _numbered(np.array(places, np.int64))
            found = _Windows(parts["a"].copy(), parts["b"].copy(), np.repeat(number, [len(x) for x in starts]), np.concatenate(starts).astype(np.int32), names, ranks)
            del parts
            starts.clear()
            own, late = found.split()
            del found
            if len(late):
                runs = late.runs(width)
                n = len(runs[0])
                yield pa.RecordBatch.from_arrays([pa.array((runs[0] ^ runs[1]) & ((1 << bucket_bits) - 1)), pa.nulls(n, pa.binary()), *map(pa.array, runs)], schema=FOUND)
            del late
            own = own.take(np.lexsort((own.start, own.row, own.h1 >> np.uint64(64 - bucket_bits))))
            bucket = (own.h1 >> np.uint64(64 - bucket_bits)).astype(np.int64)
            cuts = np.concatenate([[0], np.flatnonzero(bucket[1:] != bucket[:-1]) + 1, [len(own)]])
            for i, j in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True):
                yield pa.RecordBatch.from_pydict({"bucket": [int(bucket[i])], "blob": [own.take(slice(i, j)).pack()]} | {n: [None] for n, _ in PLACE}, FOUND)

    return find


def _resolver(width: int):
    def resolve(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows arrive sorted by bucket; one bucket's blobs at a time are held."""
        at, held = None, []

        def out() -> Iterator[pa.RecordBatch]:
            if held:
                late = _Windows.unpack(held).split()[1]
                if len(late):
                    yield pa.RecordBatch.from_arrays([pa.array(x) for x in late.runs(width)], schema=LATE)

        for batch in batches:
            sure = batch.filter(pc.is_null(batch.column(1)))
            if sure.num_rows:
                yield pa.RecordBatch.from_arrays([sure.column(k).cast(LATE.field(k - 2).type) for k in range(2, 7)], schema=LATE)
            rest = batch.filter(pc.is_valid(batch.column(1)))
            for bucket, blob in zip(rest.column(0).to_pylist(), rest.column(1).to_pylist(), strict=True):
                if bucket != at:
                    yield from out()
                    at, held = bucket, []
                held.append(blob)
        yield from out()

    return resolve


def _cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for table in text_batches(batches):
        ids, out = table["doc_id"].to_pylist(), {"doc_id": [], "n_words": [], "n_removed": [], "kept_text": []}
        for doc_id, text, cuts in zip(ids, table["text"], table["cuts"].to_pylist(), strict=True):
            words, kept, at = flat(text.as_py()).split(), [], 0
            for x in sorted(cuts or (), key=lambda x: x["start"]):
                if x["start"] > at:
                    kept += words[at : x["start"]]
                at = max(at, x["stop"])
            kept += words[at:]
            for k, v in zip(out, (doc_id, len(words), len(words) - len(kept), b" ".join(kept).decode("utf-8", "surrogatepass")), strict=True):
                out[k].append(v)
        yield pa.RecordBatch.from_pydict(out, pa.schema([("doc_id", pa.int64()), ("n_words", pa.int64()), ("n_removed", pa.int64()), ("kept_text", pa.string())]))


def remove_repeats(docs: DataFrame, width: int = 20, max_log2_cells: int = 29) -> DataFrame:
    """Remove each word that is covered by a window of `width` words which also starts earlier. Gives doc_id, n_words, n_removed, kept_text."""
    spark = docs.sparkSession
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    chars = docs.agg(F.sum(F.length("text"))).first()[0] or 0
    bits = min(max_log2_cells, max(12, math.ceil(math.log2(max(1, chars / 6) * 2.5))))
    bucket_bits = min(40, max(3, math.ceil(math.log2(max(1, chars / 6) / BUCKET))))
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    pieces = docs.select("text").mapInArrow(_sketcher(width, bits), "row int, shard int, once binary, twice binary")
    merged = pieces.repartition("row", "shard").sortWithinPartitions("row", "shard").mapInArrow(_merger(bits), "row int, shard int, twice binary")
    rows = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    try:  # pieces are large rows
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "64")
        sketch = spark.sparkContext.broadcast([(x.row, x.shard, bytes(x.twice)) for x in merged.collect()])  # 2**max_log2_cells bits a row at most
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", rows)
    keyed = docs.select("doc_id", key_of("doc_id").alias("_key"), "text")
    shared = stored(keyed.groupBy("_key").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select("_key"), "shared-ids")
    # Where an id names one row, no more is sent. With very many shared ids all rows are named by their texts, which costs bytes only.
    few = shared.count() <= BROADCAST_IDS
    twice = F.col("_twice").isNotNull() if few else F.lit(True)
    keyed = keyed.join(F.broadcast(shared.withColumn("_twice", F.lit(True))), "_key", "left") if few else keyed
    named = keyed.select("doc_id", "_key", F.when(twice, F.xxhash64("text")).otherwise(0).alias("row"), F.when(twice, F.xxhash64("text", "text")).otherwise(0).alias("row2"), "text")
    found = named.drop("doc_id").mapInArrow(_finder(width, bits, bucket_bits, sketch), f"bucket long, blob binary, {LATE_SQL}")
    late = found.repartition(max(n, (1 << bucket_bits) // 8), "bucket").sortWithinPartitions("bucket").mapInArrow(_resolver(width), LATE_SQL)
    cuts = late.groupBy(F.col("doc").alias("_key"), "row", "row2").agg(F.collect_set(F.struct("start", "stop")).alias("cuts"))
    return named.join(cuts, ["_key", "row", "row2"], "left").select("doc_id", "text", "cuts").mapInArrow(_cut, "doc_id long, n_words long, n_removed long, kept_text string")
