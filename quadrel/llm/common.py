"""Helpers that the corpus operators share: shared storage, word scanning and rolling window hashes."""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: The white space that separates words, as a class for Spark's and Python's regular expressions.
SPACE = r"[\x20\x09-\x0D]"
WORD = r"[^\x20\x09-\x0D]+"
#: Stands for a null key; it ranks before every real doc_id.
NULL_KEY = -(2**63)
#: Bytes of text that a Python task handles at once.
BATCH_BYTES = 24 << 20


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share. The session names it; only where it names none on a single machine (tests) a temporary one is set."""
    where = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not where:
        if not re.match(r"local(\[|$)", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        where = tempfile.mkdtemp(prefix="quadrel-")
        spark.sparkContext.setCheckpointDir(where)
    return where.rstrip("/")


def stored(df: DataFrame, what: str) -> DataFrame:
    """df, written as Parquet to the shared folder and read back: cuts the lineage and outlives executors."""
    path = f"{shared_dir(df.sparkSession)}/{what}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def key_of(column: str) -> Column:
    return F.coalesce(F.col(column).cast("long"), F.lit(NULL_KEY))


def flat(text: str | None) -> bytes:
    """The words of a text in UTF-8, joined by one space. bytes.split() splits at exactly the white space of SPACE."""
    return b" ".join((text or "").encode("utf-8", "surrogatepass").split())


def text_batches(batches: Iterator[pa.RecordBatch], column: str = "text", limit: int = BATCH_BYTES) -> Iterator[pa.Table]:
    """Arrow batches joined or cut to about `limit` bytes of `column` each, so that a task's memory doesn't depend on the length of texts."""
    held: list[pa.RecordBatch] = []
    size = 0
    for batch in batches:
        while batch.num_rows:
            lengths = pc.fill_null(pc.binary_length(batch.column(batch.schema.get_field_index(column))), 0)
            ends = np.cumsum(lengths.to_numpy(zero_copy_only=False).astype(np.int64)) + size
            n = max(1, int(np.searchsorted(ends, limit, "right")))
            held.append(batch.slice(0, n))
            size = int(ends[min(n, len(ends)) - 1])
            batch = batch.slice(n)
            if batch.num_rows or size >= limit:
                yield pa.Table.from_batches(held)
                held, size = [], 0
    if held:
        yield pa.Table.from_batches(held)


class WindowHash:
    """64-bit polynomial hashes of windows of words, by prefix sums modulo 2**64."""

    def __init__(self, width: int, seed: int = 7):
        self.width = width
        self.table = np.random.default_rng(seed).integers(0, 2**64, 256, dtype=np.uint64) | np.uint64(1)
        self.base = 0x9E3779B97F4A7C15
        self._grow(1 << 16)

    def _grow(self, n: int) -> None:
        with np.errstate(over="ignore"):
            self.powers, self.inverse = (np.cumprod(np.concatenate([np.ones(1, np.uint64), np.full(n, b, np.uint64)]), dtype=np.uint64) for b in (self.base, pow(self.base, -1, 2**64)))

    def __call__(self, words: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Starts and ends in bytes of each word of a flat text, and the hash of the window that begins at each word (shorter by width - 1)."""
        if not words:
            return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.uint64)
        if len(words) >= len(self.powers):
            self._grow(2 * len(words))
        b = np.frombuffer(words, np.uint8)
        gaps = np.flatnonzero(b == 32)
        starts, ends = np.concatenate([[0], gaps + 1]), np.concatenate([gaps, [len(b)]])
        if len(starts) < self.width:
            return starts, ends, np.zeros(0, np.uint64)
        total = np.zeros(len(b) + 1, np.uint64)
        np.cumsum(self.table[b] * self.powers[: len(b)], out=total[1:])
        first = starts[: len(starts) - self.width + 1]
        h = (total[ends[self.width - 1 :]] - total[first]) * self.inverse[first]
        h ^= h >> np.uint64(31)
        h *= np.uint64(0xBF58476D1CE4E5B9)
        h ^= h >> np.uint64(29)
        return starts, ends, h
