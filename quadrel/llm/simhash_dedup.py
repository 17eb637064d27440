"""Operator 4. SimHash near-dedup with BK-trees.

Equal fingerprints are merged first, so copies cost one row each and no pairs. Two fingerprints that differ in at most 2 of
64 bits agree in at least two of four 16-bit blocks, so each distinct fingerprint goes to the six shards named by a pair of
blocks and their values, and every link lies within a shard. A shard's BK-tree has children keyed by the integer Hamming
distance to their parent; all fingerprints of the shard descend it together and follow only edges within the radius. A
shard over `tree_size` is cut again by blocks of the bits left, in the same way, before a tree is built. The trees of all
fingerprints have no size bound, so they are not broadcast whole: each meets its queries in the shard's own task.
A shard gives links to the smallest fingerprint of each of its components, never all pairs.

near_copies() links 64-bit fingerprints. similar_texts() finds texts whose sets of five-word shingles are similar at 0.8 or more: such
texts lie some 10 of 64 bits apart, too near chance for so short a fingerprint, so there it has 512 bits, and shards are named by twelve
pairs of least shingle hashes (a pair of texts misses all of them with a probability of 5e-6 at 0.8, less above). A shard's BK-tree only
proposes: its radius is 4.5 standard deviations beyond the mean of texts at the threshold, and the groups that it links are named by
their members, so that a group found in several shards is tested once. In a group each proposed pair is tested by the exact
similarity of the shingle sets (as 64-bit hashes) before it joins a component. Pairs that are in one component by then aren't
tested, so a tight group of copies costs one pass. Shards and groups with too many rows are dealt in blocks, and each two blocks meet in a task.

Null and empty texts have fingerprint zero and link like any other. A null doc_id ranks before all others. Repeated rows have
equal fingerprints. An empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from functools import cache
from itertools import combinations, islice

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BinaryType, LongType, StringType, StructField, StructType

from .common import BATCH_BYTES, NULL_KEY, WindowHash, flat, key_of, stored, text_batches
from .graph import components

BLOCKS = 4
SEED = 42
#: One bit of each byte, and the shifts that bring a byte's other bits there.
LANES, SHIFTS = np.uint64(0x0101010101010101), np.arange(8, dtype=np.uint64)[:, None]


def bit_counts(h: np.ndarray) -> np.ndarray:
    """How many of the hashes along the last axis have each of their 64 bits set. Bytes count up to 255 hashes side by side."""
    out = np.zeros((*h.shape[:-1], 8, 8), np.int64)
    for at in range(0, h.shape[-1], 255 * 16):
        bits = (h[..., None, at : at + 255 * 16] >> SHIFTS) & LANES
        sums = np.add.reduceat(bits, np.arange(0, bits.shape[-1], 255), axis=-1)
        out += sums.view(np.uint8).reshape(*sums.shape, 8).sum(axis=-2, dtype=np.int64)
    return out.swapaxes(-1, -2).reshape(*h.shape[:-1], 64)


def fingerprint(text: str | None, width: int = 3) -> int:
    words = flat(text).lower()  # of bytes: A-Z only
    if not words:
        return 0
    b = np.frombuffer(words, np.uint8)
    gaps = np.flatnonzero(b == 32)
    starts, ends = [0, *(gaps + 1).tolist()], [*gaps.tolist(), len(b)]
    if len(starts) <= width:
        return xxhash.xxh64_intdigest(words, SEED)
    counts, h64 = np.zeros(64, np.int64), xxhash.xxh64_intdigest
    n = len(starts) - width + 1
    for at in range(0, n, 1 << 18):
        to = min(n, at + (1 << 18))
        h = np.array([h64(words[i:j], SEED) for i, j in zip(starts[at:to], ends[at + width - 1 : to + width - 1], strict=True)], np.uint64)
        counts += bit_counts(h)
    return int(np.packbits(counts * 2 > n, bitorder="little").view(np.uint64)[0])


def fingerprints(docs: DataFrame, width: int = 3) -> DataFrame:
    """(doc_id, fp): fp holds the fingerprint's 64 bits as a long."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in text_batches(batches):
            fp = np.array([fingerprint(t.as_py(), width) for t in table["text"]], np.uint64)
            yield pa.RecordBatch.from_arrays([table["doc_id"].combine_chunks(), pa.array(fp.view(np.int64))], names=["doc_id", "fp"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, "doc_id long, fp long")


def tree_links(fps: np.ndarray, radius: int, tree_size: int = 4096, bits: tuple[int, ...] = tuple(range(64))) -> set[tuple[int, int]]:
    """Links within the radius among distinct fingerprints (uint64), by BK-trees; of a large set by blocks of its bits first."""
    out: set[tuple[int, int]] = set()
    if len(fps) > tree_size and len(bits) > radius + 1:
        for part in np.array_split(np.array(bits), radius + 1):  # one of radius + 1 blocks is the same on both sides
            mask = np.uint64(sum(1 << int(b) for b in part))
            order = np.argsort(fps & mask, kind="stable")
            value = (fps & mask)[order]
            cuts = np.flatnonzero(value[1:] != value[:-1]) + 1
            rest = tuple(b for b in bits if b not in set(part.tolist()))
            for group in np.split(fps[order], cuts):
                if len(group) > 1:
                    out |= tree_links(group, radius, tree_size, rest)
        return out
    todo = [(fps, fps)]
    while todo:
        nodes, queries = todo.pop()
        root = nodes[0]
        to_nodes, to_queries = np.bitwise_count(nodes ^ root), np.bitwise_count(queries ^ root)
        out.update((max(q, int(root)), min(q, int(root))) for q in queries[(to_queries <= radius) & (queries != root)].tolist())
        for edge in np.unique(to_nodes):
            if edge:
                near = queries[np.abs(to_queries.astype(np.int16) - int(edge)) <= radius]
                if len(near):
                    todo.append((nodes[to_nodes == edge], near))
    return out


def tree_stars(fps: np.ndarray, radius: int, tree_size: int = 4096, bits: tuple[int, ...] = tuple(range(64))) -> Iterator[tuple[int, int]]:
    """Links of each distinct fingerprint to the first of its component: as tree_links(), but links within a component that is known already are neither kept nor given."""
    if len(fps) > tree_size and len(bits) > radius + 1:
        for part in np.array_split(np.array(bits), radius + 1):
            mask = np.uint64(sum(1 << int(b) for b in part))
            order = np.argsort(fps & mask, kind="stable")
            value = (fps & mask)[order]
            rest = tuple(b for b in bits if b not in set(part.tolist()))
            for group in np.split(fps[order], np.flatnonzero(value[1:] != value[:-1]) + 1):
                if len(group) > 1:
                    yield from tree_stars(group, radius, tree_size, rest)
        return
    for a, b in tree_components(fps[:, None], radius):
        yield int(fps[a]), int(fps[b])


def _stars(links: Iterator[tuple[int, int]]) -> Iterator[tuple[int, int]]:
    root: dict[int, int] = {}

    def find(x: int) -> int:
        while root.setdefault(x, x) != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    for a, b in links:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    for x in list(root):
        if (r := find(x)) != x:
            yield x, r


def _linker(radius: int):
    def link(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows arrive sorted by shard; one shard at a time is held."""
        held_key, held = None, []

        def out() -> Iterator[pa.RecordBatch]:
            fps = np.unique(np.concatenate(held)) if held else np.zeros(0, np.uint64)
            if len(fps) > 1 and (pairs := list(_stars(tree_stars(fps, radius)))):
                a, b = np.array(pairs, np.uint64).view(np.int64).T
                yield pa.RecordBatch.from_arrays([pa.array(np.ascontiguousarray(a)), pa.array(np.ascontiguousarray(b))], names=["a", "b"])

        for batch in batches:
            if not batch.num_rows:
                continue
            pair, value, fp = (batch.column(i).to_numpy(zero_copy_only=False) for i in range(3))
            fp = fp.view(np.uint64)
            cuts = np.concatenate([[0], np.flatnonzero((pair[1:] != pair[:-1]) | (value[1:] != value[:-1])) + 1, [len(fp)]])
            for i, j in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True):
                key = (pair[i], value[i])
                if key != held_key:
                    if len(held) > 1 or held and len(held[0]) > 1:
                        yield from out()
                    held_key, held = key, []
                held.append(fp[i:j])
        yield from out()

    return link


def near_copies(docs: DataFrame, width: int = 3, radius: int = 2) -> DataFrame:
    """One row for each document: doc_id, fingerprint (16 hex digits), component_id."""
    if radius > BLOCKS - 2:
        raise ValueError("shards by pairs of four blocks serve a radius of 2 at most")
    each = stored(fingerprints(docs, width).withColumn("key", key_of("doc_id")), "fingerprints")
    low = each.groupBy("fp").agg(F.min("key").alias("low"))
    block = [F.shiftrightunsigned("fp", 16 * i).bitwiseAND(F.lit(0xFFFF)) for i in range(BLOCKS)]
    shards = F.explode(F.array(*(F.struct(F.lit(n).alias("pair"), (block[i] * 65536 + block[j]).alias("value")) for n, (i, j) in enumerate(combinations(range(BLOCKS), 2)))))
    by_shard = low.select("fp", shards.alias("s")).select("s.pair", "s.value", "fp").repartition("pair", "value").sortWithinPartitions("pair", "value")
    links = by_shard.mapInArrow(_linker(radius), "a long, b long")
    member = components(links)
    # Components hang on fingerprints; their ids are the smallest documents in them.
    named = low.join(member, low["fp"] == member["node"], "left").select("fp", "low", F.coalesce("root", "fp").alias("root"))
    ids = named.groupBy("root").agg(F.min("low").alias("component"))
    of = named.select("fp", "root").join(ids, "root").select("fp", "component")
    return each.join(of, "fp").select(
        "doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), F.when(F.col("component") != F.lit(NULL_KEY), F.col("component")).alias("component_id")
    )


#: Bytes of shingle sets and packed texts of a block of a group; two blocks meet in a task.
GROUP_BYTES = 128 << 20
#: Hash words of a wide fingerprint, and how many pairs of least hashes name a text's shards.
WORDS = 8
PAIRS = 12


def _mixed(h: np.ndarray, salt: int | np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        h = h + (np.asarray(salt, np.uint64) + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15)
        h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def shingle_set(text: str | None, hasher: WindowHash) -> np.ndarray:
    """The set of a text's shingles as sorted 64-bit hashes; of fewer words than a shingle has, the whole sequence; of none, nothing."""
    words = flat(text).lower()
    h = np.unique(hasher(words)[2])
    return h if len(h) or not words else np.array([xxhash.xxh64_intdigest(words, SEED)], np.uint64)


def wide_fingerprint(h: np.ndarray) -> tuple[bytes, list[int], int]:
    """512 bits of SimHash over a set of shingles, the set's shards and its name (signed 64-bit)."""
    name = int(np.uint64(xxhash.xxh64_intdigest(h.tobytes(), SEED)).view(np.int64))
    if not len(h):
        return bytes(8 * WORDS), [0], name
    counts, least = np.zeros((WORDS, 64), np.int64), np.full(2 * PAIRS, 2**64 - 1, np.uint64)
    for at in range(0, len(h), 1 << 13):
        u = _mixed(h[at : at + (1 << 13)], np.arange(2 * PAIRS)[:, None])
        counts += bit_counts(u[:WORDS])
        least = np.minimum(least, u.min(axis=1))
    shards = _mixed(_mixed(least[::2], 0) ^ least[1::2], 1) + np.arange(PAIRS, dtype=np.uint64)
    return np.packbits(counts * 2 > len(h), axis=1, bitorder="little").tobytes(), shards.view(np.int64).tolist(), name


def bit_differs(common: int, a: int, b: int) -> float:
    """The probability that a bit of the fingerprints differs, for sets with so many common and own members."""
    of = [[math.comb(n, k) / 2**n for k in range(n + 1)] for n in (common, a, b)]
    out = 0.0
    for k, p in enumerate(of[0]):
        one, other = (sum(q for i, q in enumerate(x) if 2 * (k + i) > common + len(x) - 1) for x in of[1:])
        out += p * (one * (1 - other) + other * (1 - one))
    return out


@cache
def radius_of(similarity: float, bits: int = 64 * WORDS, sure: float = 4.5) -> int:
    """Bits by which fingerprints of sets of that Jaccard similarity differ, and `sure` standard deviations more. Ties make small sets differ in more bits than large ones: sizes up to 24 are counted out."""
    p = math.acos(2 * similarity / (1 + similarity)) / math.pi
    for union in range(1, 25):
        own = union - math.ceil(similarity * union - 1e-9)
        p = max(p, *(bit_differs(union - own, a, own - a) for a in range(own // 2 + 1)), 0)
    return int(bits * p + sure * math.sqrt(bits * p * (1 - p)))


def tree_components(fps: np.ndarray, radius: int, similar: Callable[[int, np.ndarray], np.ndarray] | None = None) -> Iterator[tuple[int, int]]:
    """(index, index of its component's first) of rows of uint64 words that links within the radius join, by a BK-tree.

    similar(i, others) tells which of the links from i hold; without it all do.
    """
    everything = np.arange(len(fps))
    of, members = everything.copy(), [[x] for x in everything.tolist()]

    def join(a: int, b: int) -> None:
        a, b = sorted((int(of[a]), int(of[b])), key=lambda c: len(members[c]))
        if a != b:
            of[members[a]] = b
            members[b] += members[a]
            members[a] = []

    todo = [(everything, everything)]
    while todo:
        nodes, queries = todo.pop()
        root, own = int(nodes[0]), of[nodes[0]]
        if (of[nodes] == own).all():
            queries = queries[of[queries] != own]
            if not len(queries):
                continue
        to_nodes, to_queries = (np.bitwise_count(fps[x] ^ fps[root]).sum(axis=1, dtype=np.int32) for x in (nodes, queries))
        near = queries[(to_queries <= radius) & (of[queries] != own) & (queries > root)]  # a pair is met from both ends
        if len(near) and similar:
            near = near[similar(root, near)]
        for q in near.tolist():
            join(root, q)
        own = of[root]
        for edge in np.unique(to_nodes[1:]).tolist():
            below, close = nodes[1:][to_nodes[1:] == edge], queries[np.abs(to_queries - edge) <= radius]
            ours = of[below] == own
            for part, against in ((below[~ours], close), (below[ours], close[of[close] != own])):
                if len(part) and len(against):
                    todo.append((part, against))
    first = np.full(len(fps), len(fps))
    np.minimum.at(first, of, everything)
    for x in np.flatnonzero(first[of] != everything).tolist():
        yield x, int(first[of[x]])


def _similar_sets(sets: list[np.ndarray], similarity: float) -> Callable[[int, np.ndarray], np.ndarray]:
    """Exact Jaccard similarity of sorted sets, one against several."""
    size = np.array([len(s) for s in sets])

    def similar(i: int, others: np.ndarray) -> np.ndarray:
        out, mine = np.zeros(len(others), bool), sets[i]
        small, large = np.minimum(size[others], size[i]), np.maximum(size[others], size[i])
        able = np.flatnonzero((large == 0) | (small >= similarity * large * (1 - 1e-9)))
        for part in np.split(able, np.flatnonzero(np.diff(np.cumsum(size[others[able]]) >> 20)) + 1):  # some 8 MB at once
            if len(part):
                whose, theirs = np.repeat(part, size[others[part]]), np.concatenate([sets[x] for x in others[part]])
                at = np.searchsorted(mine, theirs)
                shared = np.bincount(whose[mine[np.minimum(at, len(mine) - 1)] == theirs] if len(mine) else [], minlength=len(others))[part]
                union = size[others[part]] + size[i] - shared
                out[part] = (union == 0) | (shared / np.maximum(union, 1) >= similarity)
        return out

    return similar


def _runs(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[np.ndarray, np.ndarray, list[list]]]:
    """Rows (key, node, fp, ...) arrive sorted by key: nodes, fingerprints and other columns of one key at a time, where it has several nodes."""
    held_key, nodes, held = None, [], []

    def out() -> Iterator[tuple[np.ndarray, np.ndarray, list[list]]]:
        ids = np.concatenate(nodes) if nodes else np.zeros(0, np.int64)
        if len(ids) > 1:
            yield ids, np.frombuffer(b"".join(held[0]), np.uint64).reshape(len(ids), WORDS), held[1:]

    for batch in batches:
        key, node = (batch.column(i).to_numpy(zero_copy_only=False) for i in range(2))
        cuts = np.concatenate([[0], np.flatnonzero(key[1:] != key[:-1]) + 1, [len(key)]]).tolist() if len(key) else [0]
        for i, j in zip(cuts[:-1], cuts[1:], strict=True):
            if key[i] != held_key:
                yield from out()
                held_key, nodes, held = key[i], [], [[] for _ in batch.columns[2:]]
            nodes.append(node[i:j])
            for to, column in zip(held, batch.columns[2:], strict=True):
                to += column.slice(i, j - i).to_pylist()
    yield from out()


def _batches(rows: Iterator[tuple[int, int]], names: list[str], most: int = 1 << 16) -> Iterator[pa.RecordBatch]:
    while part := list(islice(rows, most)):
        yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in zip(*part, strict=True)], names=names)


def _proposer(radius: int):
    def found(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, int]]:
        for ids, fps, _ in _runs(batches):
            groups: dict[int, list[int]] = {}
            for a, b in tree_components(fps, radius):
                groups.setdefault(b, [b]).append(a)
            for group in groups.values():
                nodes = np.unique(ids[group])
                name = int(np.uint64(xxhash.xxh64_intdigest(nodes.tobytes(), SEED)).view(np.int64))
                for node in nodes.tolist():
                    yield name, node

    return lambda batches: _batches(found(batches), ["group", "node"])


def _tester(radius: int, similarity: float, width: int):
    def found(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, int]]:
        hasher, opener = WindowHash(width), zstandard.ZstdDecompressor()
        for ids, fps, (texts,) in _runs(batches):
            sets = [shingle_set(_unpacked(x, opener), hasher) for x in texts]
            for a, b in tree_components(fps, radius, _similar_sets(sets, similarity)):
                yield int(ids[a]), int(ids[b])

    return lambda batches: _batches(found(batches), ["a", "b"])


def _dealt(rows: DataFrame, key: str, most: int, most_bytes: int | None = None) -> DataFrame:
    """rows (key, node, ...); those of a key with more than `most` rows, or of more than `most_bytes` by their column `bytes`, are dealt in blocks, and each two blocks have a key of their own."""
    share = F.count(F.lit(1)) / most
    if most_bytes:
        share = F.greatest(share, F.sum("bytes") / most_bytes)
    crowded = stored(rows.groupBy(key).agg(share.alias("share")).filter("share > 1"), "crowded")
    if crowded.isEmpty():
        return rows
    blocks = crowded.select(key, (F.floor("share") + 1).cast("int").alias("blocks"))
    own, other = F.pmod("node", "blocks"), F.explode(F.sequence(F.lit(0), F.coalesce("blocks", F.lit(1)) - 1)).alias("other")
    met = rows.join(blocks, key, "left").select(*rows.columns, F.coalesce(own, F.lit(0)).alias("own"), "blocks", other)
    name = F.when(F.col("blocks").isNull(), F.col(key)).otherwise(F.xxhash64(key, F.least("own", "other"), F.greatest("own", "other")))
    return met.select(name.alias(key), *(c for c in rows.columns if c != key))


def _unpacked(packed: bytes | None, opener: zstandard.ZstdDecompressor) -> str | None:
    return None if packed is None else opener.decompress(packed).decode("utf-8", "surrogatepass")


def _sketches(docs: DataFrame, width: int, keep: bool) -> DataFrame:
    """Written rows with own (the columns of docs but text, if kept), row, key, node, fp, shards, the bytes that its shingles and its text take, and the text, compressed. Row numbers are given once, where the rows are written."""
    rows = docs.select(F.struct(*(F.col(c).alias(f"c{k}") for k, c in enumerate(docs.columns) if keep and c != "text"), F.col("doc_id").cast("long").alias("doc_id")).alias("own"), F.col("text").cast("string").alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher, packer = WindowHash(width), zstandard.ZstdCompressor(level=3)
        for table in text_batches(batches):
            texts = [t.as_py() for t in table["text"]]
            fp, shards, node, size = zip(*((*wide_fingerprint(h), len(h)) for h in (shingle_set(t, hasher) for t in texts)), strict=True)
            packed = [None if t is None else packer.compress(t.encode("utf-8", "surrogatepass")) for t in texts]
            held = [8 * n + len(p or b"") for n, p in zip(size, packed, strict=True)]
            table = table.drop_columns(["text"])
            for name, column in (("fp", pa.array(fp, pa.binary())), ("shards", pa.array(shards, pa.list_(pa.int64()))), ("node", pa.array(node, pa.int64())), ("bytes", pa.array(held, pa.int64())), ("packed", pa.array(packed, pa.binary()))):
                table = table.append_column(name, column)
            yield from table.combine_chunks().to_batches()

    sketched = rows.mapInArrow(run, StructType([rows.schema["own"], StructField("fp", BinaryType()), StructField("shards", ArrayType(LongType())), StructField("node", LongType()), StructField("bytes", LongType()), StructField("packed", BinaryType())]))
    return stored(sketched.withColumns({"row": F.monotonically_increasing_id(), "key": F.coalesce("own.doc_id", F.lit(NULL_KEY))}), "sketches")


def _similar(each: DataFrame, width: int, similarity: float, shard_rows: int, group_rows: int, group_bytes: int) -> DataFrame:
    """(node, root) of the sets of shingles that links of that similarity join. Texts travel compressed and are shingled anew where they are compared: hashes of shingles would be several times their size. A group's sets and texts are held together, so it is bounded in rows and in bytes."""
    radius = radius_of(similarity)
    by_shard = _dealt(each.select(F.explode("shards").alias("shard"), "node", "fp").distinct(), "shard", shard_rows)
    proposed = by_shard.repartition("shard").sortWithinPartitions("shard").mapInArrow(_proposer(radius), "group long, node long")
    found = stored(proposed.distinct(), "groups")
    wanted = each.join(found.select("node").distinct(), "node", "left_semi")
    held = each.select("node", "bytes").join(found.select("node").distinct(), "node", "left_semi").groupBy("node").agg(F.max("bytes").alias("bytes"))
    groups = _dealt(stored(found.join(held, "node"), "sized-groups"), "group", group_rows, group_bytes)
    by_group = groups.select("group", "node").join(wanted.select("node", "fp", "packed").dropDuplicates(["node"]), "node").select("group", "node", "fp", "packed")
    return components(by_group.repartition("group").sortWithinPartitions("group").mapInArrow(_tester(radius, similarity, width), "a long, b long"))


def similar_texts(docs: DataFrame, width: int = 5, similarity: float = 0.8, shard_rows: int = 200_000, group_rows: int = 20_000, group_bytes: int = GROUP_BYTES) -> DataFrame:
    """One row for each document: doc_id, component_id (smallest doc_id of the texts that links reach). Sets of shingles are named by 64-bit hashes in the links."""
    each = _sketches(docs, width, keep=False)
    member = _similar(each, width, similarity, shard_rows, group_rows, group_bytes)
    low = each.groupBy("node").agg(F.min("key").alias("low"))
    named = low.join(member, "node", "left").select("node", "low", F.coalesce("root", "node").alias("root"))
    ids = stored(named.groupBy("root").agg(F.min("low").alias("component")), "ids")  # written, so that the join below may split a large component
    of = named.select("node", "root").join(ids, "root").select("node", "component")
    return each.select("own.doc_id", "node").join(of, "node").select("doc_id", F.when(F.col("component") != F.lit(NULL_KEY), F.col("component")).alias("component_id"))


def first_of_similar(docs: DataFrame, width: int = 5, similarity: float = 0.8, shard_rows: int = 200_000, group_rows: int = 20_000, group_bytes: int = GROUP_BYTES) -> DataFrame:
    """The rows of docs, with all their columns, that are the first of their similar texts: by doc_id (null first), of equal ids any one. Rows are told apart by numbers of their own, not by ids."""
    each = _sketches(docs, width, keep=True)
    member = _similar(each, width, similarity, shard_rows, group_rows, group_bytes)
    low = each.groupBy("node").agg(F.min(F.struct("key", "row")).alias("low"))
    first = low.join(member, "node", "left").groupBy(F.coalesce("root", "node")).agg(F.min("low").alias("low"))
    kept = each.join(first.select(F.col("low.row").alias("row")), "row", "left_semi").select("own", "packed")
    text = docs.schema["text"]

    def opened(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        opener = zstandard.ZstdDecompressor()
        for table in text_batches(batches, "packed", BATCH_BYTES // 4):
            texts = pa.array([_unpacked(x.as_py(), opener) for x in table["packed"]], pa.string())
            yield from table.drop_columns(["packed"]).append_column("text", texts).combine_chunks().to_batches()

    whole = kept.mapInArrow(opened, StructType([kept.schema["own"], StructField("text", StringType())]))
    return whole.select(*(F.col("text").cast(text.dataType).alias(c) if c == "text" else F.col(f"own.c{k}").alias(c) for k, c in enumerate(docs.columns)))
