"""Operator 5. Benchmark decontamination by greedy string tiling.

Words are lower-cased, with ASCII punctuation as white space. Items and documents are joined on shared seeds (runs of
`least` words, by rolling hashes); items whose words under shared seeds don't reach the threshold can't reach it by tiles
either and are dropped. For the rest the longest matches are marked again and again, found by Karp-Rabin hashes
of all runs of a length and compared word by word, without overlap: the longest length that still matches is found by
bisection, for a match of s words holds one of s - 1. The share of the item's words under tiles is its coverage; order doesn't
matter, so passages whose sentences were moved are caught. An item of fewer than `least` words has no seed; it matches
where all its words stand together in the document, as one tile.

The benchmark is held in blocks of about `block_chars` characters (some 25 bytes a character in each task); a larger one takes
more scans, each with a broadcast of that size. Seeds of a document are looked up once each, and a tiling takes memory in
proportion to the document and the item, also where words repeat without end.

Null and empty texts and items match nothing. Equal items are reported one by one, repeated documents and documents that
share an id likewise; null ids stay null. Without matches the result is empty. Other columns are ignored by contaminated()
and kept, whatever their names, by uncontaminated().
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import WindowHash, text_batches

BASE = np.uint64(0x9E3779B97F4A7C15)
INVERSE = np.uint64(pow(int(BASE), -1, 2**64))
PLAIN = bytes(b if b > 127 or chr(b).isalnum() else 32 for b in range(256))


def plain(text: str | None) -> bytes:
    return b" ".join((text or "").lower().encode("utf-8", "surrogatepass").translate(PLAIN).split())


class _Side:
    """The words of one side as numbers, which of them are used up, and hashes of its free runs."""

    def __init__(self, words: np.ndarray, used: np.ndarray):
        self.words, self.used = words, used
        with np.errstate(over="ignore"):
            powers, self.inverse = (np.cumprod(np.concatenate([np.ones(1, np.uint64), np.full(len(words), b, np.uint64)]), dtype=np.uint64) for b in (BASE, INVERSE))
            mixed = (words.astype(np.uint64) + np.uint64(1)) * np.uint64(0xD6E8FEB86659FD93)
            mixed ^= mixed >> np.uint64(32)
            self.total = np.concatenate([np.zeros(1, np.uint64), np.cumsum(mixed * powers[:-1], dtype=np.uint64)])

    def runs(self, s: int) -> tuple[np.ndarray, np.ndarray]:
        """(places, hashes) of the runs of s free words."""
        if len(self.words) < s:
            return np.zeros(0, np.int64), np.zeros(0, np.uint64)
        taken = np.concatenate([[0], np.cumsum(self.used)])
        at = np.flatnonzero(taken[s:] == taken[:-s])
        with np.errstate(over="ignore"):
            return at, (self.total[at + s] - self.total[at]) * self.inverse[at]

    def longest_run(self) -> int:
        edges = np.flatnonzero(np.concatenate([[1], self.used, [1]]))
        return int(np.diff(edges).max()) - 1


def tiles(item: list, text: list, least: int) -> list[tuple[int, int, int]]:
    """(length, place in item, place in text) of the tiles of a greedy string tiling: always the longest match left, of equal ones the first in the item, then in the text. None in `text` matches nothing."""
    ids: dict = {}
    one = _Side(np.array([ids.setdefault(w, len(ids)) for w in item], np.int64), np.zeros(len(item), bool))
    two = _Side(np.array([-1 if w is None else ids.get(w, -1) for w in text], np.int64), np.array([w is None or w not in ids for w in text], bool))
    out: list[tuple[int, int, int]] = []

    def shared(s: int) -> bool:
        return bool(np.isin(one.runs(s)[1], two.runs(s)[1]).any())

    high = min(one.longest_run(), two.longest_run()) if len(item) and len(text) else 0
    while high >= least and shared(least):
        low = least
        while low < high:
            middle = (low + high + 1) // 2
            low, high = (middle, high) if shared(middle) else (low, middle - 1)
        (at, h), (at2, h2) = one.runs(low), two.runs(low)
        keep, keep2 = np.isin(h, h2), np.isin(h2, h)
        places: dict[int, list[int]] = {}
        for j, x in zip(at2[keep2].tolist()[::-1], h2[keep2].tolist()[::-1], strict=True):
            places.setdefault(x, []).append(j)
        for i, x in zip(at[keep].tolist(), h[keep].tolist(), strict=True):
            if one.used[i : i + low].any():
                continue
            rest, unequal = places[x], []
            while rest:
                j = rest.pop()
                if two.used[j : j + low].any():
                    continue
                if (one.words[i : i + low] == two.words[j : j + low]).all():
                    one.used[i : i + low] = two.used[j : j + low] = True
                    out.append((low, i, j))
                    break
                unequal.append(j)
            rest += unequal[::-1]
        high = min(low - 1, one.longest_run(), two.longest_run())  # no match of this length is left
    return out


class _Seeds:
    """Items by the hashes of their seeds; short ones by the hash of all their words."""

    def __init__(self, items: list[tuple[int, str]], least: int):
        self.least = least
        self.items = [(i, words) for i, t in items if (words := plain(t).split())]
        self.hashers, self.tables = {}, {}
        lengths = [min(least, len(w)) for _, w in self.items]
        for n in sorted(set(lengths)):
            self.hashers[n] = WindowHash(n)
            own = [k for k, x in enumerate(lengths) if x == n]
            parts = [self.hashers[n](b" ".join(self.items[k][1]))[2] for k in own]
            h, item, place = np.concatenate(parts), np.repeat(np.array(own, np.int32), [len(x) for x in parts]), np.concatenate([np.arange(len(x), dtype=np.int32) for x in parts])
            order = np.argsort(h, kind="stable")
            bits = max(10, math.ceil(math.log2(len(h) * 8)))
            maybe = np.zeros(1 << bits, bool)
            maybe[h >> np.uint64(64 - bits)] = True
            self.tables[n] = h[order], item[order], place[order], maybe, np.uint64(64 - bits)

    def _matches(self, words: bytes, n: int, threshold: float) -> Iterator[tuple[int, float, int]]:
        h = self.hashers[n](words)[2]
        seeds, item, place, maybe, shift = self.tables[n]
        at = np.flatnonzero(maybe[h >> shift])
        own = np.unique(h[at])
        low, high = np.searchsorted(seeds, own, "left"), np.searchsorted(seeds, own, "right")
        low, n_hits = low[high > low], (high - low)[high > low]
        if not len(low):
            return
        x = np.repeat(low - np.concatenate([[0], np.cumsum(n_hits)[:-1]]), n_hits) + np.arange(n_hits.sum())
        x = x[np.lexsort((place[x], item[x]))]
        tokens = words.split()
        for part in np.split(x, np.flatnonzero(np.diff(item[x])) + 1):
            item_id, mine = self.items[item[part[0]]]
            if len(mine) < self.least:
                if (hit := next((j for j in at[np.isin(h[at], seeds[part])].tolist() if tokens[j : j + n] == mine), None)) is not None:
                    yield item_id, 1.0, 1
                continue
            if self._under(place[part], len(mine)) < threshold * len(mine):
                continue
            js = at[np.isin(h[at], seeds[part])]
            covered = np.zeros(len(tokens) + 1, np.int64)
            np.add.at(covered, js, 1)
            np.add.at(covered, js + n, -1)
            near = np.flatnonzero(np.cumsum(covered)[:-1])
            held: list = []
            for run in np.split(near, np.flatnonzero(np.diff(near) > 1) + 1):
                held += [*tokens[run[0] : run[-1] + 1], None]
            marked = tiles(mine, held, n)
            coverage = sum(t[0] for t in marked) / len(mine)
            if coverage >= threshold:
                yield item_id, coverage, len(marked)

    def _under(self, places: np.ndarray, n: int) -> int:
        covered = np.zeros(n + 1, np.int64)
        np.add.at(covered, places, 1)
        np.add.at(covered, places + self.least, -1)
        return int((np.cumsum(covered) > 0).sum())

    def matches(self, text: str | None, threshold: float) -> Iterator[tuple[int, float, int]]:
        words = plain(text)
        if words:
            for n in self.tables:
                yield from self._matches(words, n, threshold)


def _blocks(benchmark: DataFrame, block_chars: int) -> Iterator[list[tuple[int, str]]]:
    """Items in lists of about block_chars characters, one list at a time on the driver."""
    items = benchmark.select(F.col("item_id").cast("long").alias("item_id"), F.col("text").cast("string").alias("text")).filter("text is not null")
    blocks = max(1, math.ceil((items.agg(F.sum(F.length("text"))).first()[0] or 0) / block_chars))
    for block in range(blocks):
        yield [tuple(x) for x in (items.filter(F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)) == block) if blocks > 1 else items).collect()]


def _scans(docs: DataFrame, benchmark: DataFrame, block_chars: int, least: int) -> Iterator[Callable[[], _Seeds]]:
    for items in _blocks(benchmark, block_chars):
        held = docs.sparkSession.sparkContext.broadcast(items)
        yield lambda held=held: _Seeds(held.value, least)


def contaminated(docs: DataFrame, benchmark: DataFrame, least: int = 5, threshold: float = 0.6, block_chars: int = 8 << 20) -> DataFrame:
    """(doc_id, item_id, coverage, n_tiles) of each document and benchmark item whose words it covers to the threshold."""
    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))

    def scan(seeds_of: Callable[[], _Seeds]) -> DataFrame:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            seeds = seeds_of()
            for table in text_batches(batches):
                found = [(d, *m) for d, t in zip(table["doc_id"].to_pylist(), table["text"], strict=True) for m in seeds.matches(t.as_py(), threshold)]
                if found:
                    yield pa.RecordBatch.from_arrays([pa.array(c, kind) for c, kind in zip(zip(*found, strict=True), (pa.int64(), pa.int64(), pa.float64(), pa.int64()), strict=True)], names=["doc_id", "item_id", "coverage", "n_tiles"])

        return own.mapInArrow(run, "doc_id long, item_id long, coverage double, n_tiles long")

    return reduce(DataFrame.unionByName, map(scan, _scans(docs, benchmark, block_chars, least)))


def uncontaminated(docs: DataFrame, benchmark: DataFrame, least: int = 5, threshold: float = 0.6, block_chars: int = 8 << 20) -> DataFrame:
    """The rows of docs that hold no item, with all their columns. Rows are judged one by one where they are read, so nothing is shuffled and ids play no part."""
    at = docs.columns.index("text")

    def drop(rows: DataFrame, seeds_of: Callable[[], _Seeds]) -> DataFrame:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            seeds = seeds_of()
            for table in text_batches(batches):
                clean = [next(seeds.matches(t.as_py(), threshold), None) is None for t in table.column(at)]
                yield from table.filter(pa.array(clean, pa.bool_())).combine_chunks().to_batches()

        return rows.mapInArrow(run, docs.schema)

    return reduce(drop, _scans(docs, benchmark, block_chars, least), docs)
