"""Operator 11. Hard-negative mining by shared lists of anchor clusters.

Vectors are whole numbers (floor of `scale` times each component) and scores are exact inner products. Anchors are clustered by
direction. For each cluster the candidates of a block are sorted once by an upper bound of their inner product with any unit
vector of the cluster: the candidate's length times the cosine of its angle to the centre less the cluster's widest angle. Every
member walks that list, in steps that all members still walking share as one matrix product, until the bound times its own
length is below the score that the last of its wanted rows has: then no row further on can enter. A first search finds each
anchor's positives among the rows of its label; a second finds, for each positive, the best rows of other labels within its band.

Candidates stay where they are, and tasks pack them into blocks; anchors, the stated queries, are sent in blocks of `anchor_rows`.
Each search goes over one candidate in `first_share` first, chosen by a hash, and then over all others with the scores that were found
as thresholds, so that tasks give few rows for each anchor however many blocks there are. The cluster centres are fitted on
at most `sample` anchors; everything else takes every row.

Rows with a null vec_id, label, vector or component, or with one that isn't finite, take no part. Shorter vectors count as ended by zeros,
an empty one scores 0 with all. Rows are told apart by row: of repeated rows each is a candidate and, where it is an anchor, an
anchor with the others as possible positives; ties go to the smaller vec_id. Anchors without positives, positives without rows in
their band, and empty tables give no rows. Scores beyond 64 bits raise an error. Other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import stored, text_batches

#: Members of a cluster, and bytes of vectors in a block of candidates.
MEMBERS = 256
BLOCK_BYTES = 8 << 20
#: What rounding may take from a bound, as a share of both lengths.
MARGIN = 1e-6


def whole_vectors(rows: DataFrame, is_anchor: Column, scale: int = 256) -> DataFrame:
    """Written rows that take part: row, vec_id, label, anchor, vector (32-bit whole numbers) and its squared length."""
    wanted = rows.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("label").cast("long").alias("label"), F.coalesce(is_anchor, F.lit(False)).alias("anchor"), F.col("embedding").cast("array<double>").alias("embedding"))
    wanted = wanted.filter("vec_id is not null and label is not null and embedding is not null and not exists(embedding, x -> x is null or isnan(x) or abs(x) = double('infinity'))")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column(3)
            q = np.floor(scale * np.asarray(pc.list_flatten(lists), np.float64))
            if len(q) and np.abs(q).max() >= 2**31:
                raise ValueError("a component is beyond what 64-bit scores can hold")
            cuts = np.concatenate([[0], np.cumsum(pc.list_value_length(lists).to_numpy(zero_copy_only=False))]).astype(np.int64)
            whole, square = q.astype(np.int32).tobytes(), np.concatenate([[0], np.cumsum(q * q)])
            v = pa.array([whole[4 * i : 4 * j] for i, j in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True)], pa.binary())
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], v, pa.array(square[cuts[1:]] - square[cuts[:-1]])], names=["vec_id", "label", "anchor", "v", "square"])

    made = wanted.mapInArrow(run, "vec_id long, label long, anchor boolean, v binary, square double")
    return stored(made.withColumn("row", F.monotonically_increasing_id()), "vectors")


def matrix(column: pa.ChunkedArray, dims: int, kind: type) -> np.ndarray:
    flat = b"".join(x.ljust(4 * dims, b"\0") for x in column.to_pylist())
    return np.frombuffer(flat, np.int32).reshape(len(column), dims).astype(kind)


def kind_for(square: float) -> type:
    """Numbers that hold all sums of products of vectors up to that squared length exactly."""
    if square >= 2**62:
        raise ValueError("scores don't fit into 64 bits")
    return np.float32 if square < 2**24 else np.float64 if square < 2**53 else np.int64


def centres(sample: np.ndarray, n: int, rounds: int = 6) -> np.ndarray:
    """Unit centres of directions by k-means, from the first n rows of the sample."""
    x = sample / np.maximum(np.linalg.norm(sample, axis=1, keepdims=True), 1e-12)
    c = x[:n].copy()
    for _ in range(rounds):
        of = (x @ c.T).argmax(axis=1)
        sums = np.zeros_like(c)
        np.add.at(sums, of, x)
        length = np.linalg.norm(sums, axis=1, keepdims=True)
        c = np.where(length > 1e-9, sums / np.maximum(length, 1e-9), c)
    return c


class Cluster:
    """Up to MEMBERS anchors near one centre, with what each of them has asked for."""

    def __init__(self, centre: np.ndarray, rows: np.ndarray, labels: np.ndarray, vectors: np.ndarray, low: np.ndarray, high: np.ndarray):
        self.centre, self.rows, self.labels, self.vectors = centre, rows, labels, vectors
        self.low, self.high = low, high  # for each member and wish: scores that count
        own = vectors.astype(np.float64)
        self.length = np.linalg.norm(own, axis=1)
        cosine = np.where(self.length > 0, own @ centre / np.maximum(self.length, 1e-12), 1)
        self.widest = float(np.arccos(np.clip(cosine, -1, 1)).max())

    def bounds(self, vectors: np.ndarray, length: np.ndarray) -> np.ndarray:
        """For each candidate the most that its inner product with a unit vector of this cluster can be."""
        cosine = np.where(length > 0, vectors @ self.centre / np.maximum(length, 1e-12), 0)
        return length * (np.cos(np.maximum(0, np.arccos(np.clip(cosine, -1, 1)) - self.widest)) + MARGIN)


def first_rows(order: tuple[np.ndarray, ...], group: np.ndarray, most: int) -> np.ndarray:
    """Indices of the first `most` of each group, in order."""
    at = np.lexsort((*reversed(order), group))
    g = group[at]
    start = np.concatenate([[0], np.flatnonzero(g[1:] != g[:-1]) + 1]) if len(g) else np.zeros(0, np.int64)
    nth = np.arange(len(g)) - np.repeat(start, np.diff(np.append(start, len(g))))
    return at[nth < most]


def walk(cluster: Cluster, block: dict[str, np.ndarray], most: int, same: bool, step: int = 256) -> tuple[np.ndarray, np.ndarray, np.ndarray, int]:
    """(member * wishes + wish, index in the block, score) of the best rows within each wish, and how many candidates were walked."""
    bound = cluster.bounds(block["exact"], block["length"])
    order = np.argsort(-bound, kind="stable")
    bound = bound[order]
    low, high = cluster.low.copy(), cluster.high
    wishes = low.shape[1]
    active = np.arange(len(low))
    group, index, score = (np.zeros(0, np.int64) for _ in range(3))
    at = walked = 0
    while at < len(order):
        active = active[bound[at] * cluster.length[active] + MARGIN >= low[active].min(axis=1)]
        if not len(active):
            break
        part = order[at : at + step]
        s = cluster.vectors[active] @ block["vectors"][part].T
        walked += s.size
        fits = (block["label"][part] == cluster.labels[active][:, None]) == same
        fits &= block["row"][part] != cluster.rows[active][:, None]
        m, w, k = np.nonzero(fits[:, None] & (s[:, None] >= low[active][:, :, None]) & (s[:, None] <= high[active][:, :, None]))
        if len(m):
            group = np.concatenate([group, active[m] * wishes + w])
            index = np.concatenate([index, part[k]])
            score = np.concatenate([score, s[m, k].astype(np.int64)])
            keep = first_rows((-score, block["vec_id"][index], block["row"][index]), group, most)
            group, index, score = group[keep], index[keep], score[keep]
            full, n = np.unique(group, return_counts=True)
            last = np.cumsum(n)[n == most] - 1
            low.reshape(-1)[full[n == most]] = score[last]
        at += step
        step = min(2 * step, 4096)
    return group, index, score, walked


def clusters(anchors: pa.Table, held: np.ndarray, dims: int, kind: type, same: bool) -> list[Cluster]:
    """anchors: row, label, cluster, v, low and high (lists of equal length). Members of one cluster share a label where they look for it."""
    rows, labels, of = (anchors[c].to_numpy() for c in ("row", "label", "cluster"))
    vectors = matrix(anchors["v"], dims, kind)
    low, high = (np.array(anchors[c].to_pylist(), np.float64 if kind != np.int64 else np.int64).reshape(len(rows), -1) for c in ("low", "high"))
    length = np.linalg.norm(vectors.astype(np.float64), axis=1)
    cosine = (vectors.astype(np.float64) * held[of]).sum(axis=1) / np.maximum(length, 1e-12)
    key = labels if same else np.zeros_like(labels)
    order = np.lexsort((-cosine, key, of))
    cuts = np.flatnonzero((of[order][1:] != of[order][:-1]) | (key[order][1:] != key[order][:-1])) + 1
    out = []
    for group in np.split(order, cuts):
        for i in range(0, len(group), MEMBERS):
            g = group[i : i + MEMBERS]
            out.append(Cluster(held[of[g[0]]], rows[g], labels[g], vectors[g], low[g], high[g]))
    return out


def _searcher(sent, most: int, same: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        anchors, held, dims, kind = sent.value
        lists = clusters(anchors, held, dims, kind, same)
        for table in text_batches(batches, "v", BLOCK_BYTES):
            block = {c: table[c].to_numpy() for c in ("row", "vec_id", "label")}
            block["vectors"] = matrix(table["v"], dims, kind)
            block["exact"] = block["vectors"].astype(np.float64)
            block["length"] = np.linalg.norm(block["exact"], axis=1)
            by_label = dict(_by_label(block)) if same else {}
            for cluster in lists:
                part = by_label.get(int(cluster.labels[0])) if same else block
                if part is None:
                    continue
                group, index, score, _ = walk(cluster, part, most, same)
                member, wish = np.divmod(group, cluster.low.shape[1])
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in (cluster.rows[member], wish, part["row"][index], part["vec_id"][index], score)], names=["anchor", "wish", "row", "vec_id", "score"])

    return run


def _by_label(block: dict[str, np.ndarray]) -> Iterator[tuple[int, dict[str, np.ndarray]]]:
    order = np.argsort(block["label"], kind="stable")
    label = block["label"][order]
    for part in np.split(order, np.flatnonzero(label[1:] != label[:-1]) + 1):
        if len(part):
            yield int(block["label"][part[0]]), {c: x[part] for c, x in block.items()}


FOUND = "anchor long, wish long, row long, vec_id long, score long"


def _best(found: DataFrame, most: int) -> DataFrame:
    rank = F.row_number().over(Window.partitionBy("anchor", "wish").orderBy(F.desc("score"), "vec_id", "row"))
    return found.withColumn("rank", rank).filter(F.col("rank") <= most)


def _search(vectors: DataFrame, asked: DataFrame, held: np.ndarray, dims: int, kind: type, most: int, same: bool, anchor_rows: int, first_share: int) -> DataFrame:
    """asked: row, label, cluster, v, low and high (arrays, one number a wish). The best rows of each wish, with their rank."""
    n_blocks = max(1, -(-asked.count() // anchor_rows))
    chosen = F.pmod(F.xxhash64("row", F.lit("first")), F.lit(first_share)) == 0
    context = vectors.sparkSession.sparkContext

    def over(rows: DataFrame, asked: DataFrame) -> DataFrame:
        parts = []
        for i in range(n_blocks):
            own = asked.filter(F.pmod(F.xxhash64("row", F.lit("block")), F.lit(n_blocks)) == i).toArrow()
            if own.num_rows:
                found = rows.select("row", "vec_id", "label", "v").mapInArrow(_searcher(context.broadcast((own, held, dims, kind)), most, same), FOUND)
                parts.append(found if n_blocks == 1 else stored(found, "found"))
        return reduce(DataFrame.unionByName, parts) if parts else rows.sparkSession.createDataFrame([], FOUND)

    first = stored(_best(over(vectors.filter(chosen), asked), most), "first-found")
    # A full wish needs only what is as good as its last row.
    last = first.filter(F.col("rank") == most).groupBy("anchor").agg(F.map_from_entries(F.collect_list(F.struct("wish", "score"))).alias("last"))
    raised = F.transform("low", lambda x, i: F.coalesce(F.greatest(x, F.element_at("last", i.cast("long"))), x))
    tighter = asked.join(last, asked["row"] == last["anchor"], "left").withColumn("low", F.when(F.col("last").isNull(), F.col("low")).otherwise(raised)).select(*asked.columns)
    rest = over(vectors.filter(~chosen), stored(tighter, "asked"))
    return stored(_best(rest.unionByName(first.drop("rank")), most), "found")


def mine(rows: DataFrame, is_anchor: Column, positives: int = 5, negatives: int = 3, least: int = 50, most: int = 95, members: int = 128, sample: int = 20_000, anchor_rows: int = 50_000, first_share: int = 16) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score: of each positive the best rows of other labels whose score is `least` to `most` per cent of the positive's."""
    vectors = whole_vectors(rows, is_anchor)
    size = vectors.agg(F.max(F.octet_length("v")).alias("bytes"), F.max("square").alias("square"), F.count_if("anchor").alias("anchors")).first()
    dims, kind = max(1, (size.bytes or 0) // 4), kind_for(size.square or 0.0)
    anchors = vectors.filter("anchor")
    drawn = anchors.orderBy(F.xxhash64("row", F.lit("centre")), "row").limit(sample).select("v").toArrow()
    n = min(max(1, size.anchors // members), 256, max(1, drawn.num_rows))
    held = centres(matrix(drawn["v"], dims, np.float64), n) if drawn.num_rows else np.zeros((1, dims))
    context = rows.sparkSession.sparkContext.broadcast(held)

    def nearest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in text_batches(batches, "v", BLOCK_BYTES):
            of = (matrix(table["v"], dims, np.float64) @ context.value.T).argmax(axis=1)
            yield from table.append_column("cluster", pa.array(of)).combine_chunks().to_batches()

    placed = stored(anchors.select("row", "vec_id", "label", "v").mapInArrow(nearest, "row long, vec_id long, label long, v binary, cluster long"), "anchors")
    # Scores of vectors that fit lie within these ends.
    ends = (F.array(F.lit(-(2**62))), F.array(F.lit(2**62)))
    found = _search(vectors, placed.select("row", "label", "cluster", "v", ends[0].alias("low"), ends[1].alias("high")), held, dims, kind, positives, True, anchor_rows, first_share)
    share = lambda of: F.col("score").cast("decimal(20,0)") * of / 100  # noqa: E731  exact, and beyond a long's reach
    bands = found.select("anchor", "rank", F.col("vec_id").alias("positive_id"), F.col("score").alias("positive_score"), F.ceil(share(least)).cast("long").alias("low"), F.floor(share(most)).cast("long").alias("high"))
    bands = bands.withColumns({"low": F.when(F.col("low") <= F.col("high"), F.col("low")).otherwise(2**62), "high": F.when(F.col("low") <= F.col("high"), F.col("high")).otherwise(-(2**62))})
    wishes = bands.groupBy("anchor").agg(F.array_sort(F.collect_list(F.struct("rank", "low", "high"))).alias("wish"))
    padded = lambda c, end: F.transform(F.sequence(F.lit(0), F.lit(positives - 1)), lambda i: F.coalesce(F.get(F.col("wish")[c], i), F.lit(end)))
    asked = stored(placed.join(wishes, placed["row"] == wishes["anchor"]).select("row", "label", "cluster", "v", padded("low", 2**62).alias("low"), padded("high", -(2**62)).alias("high")), "asked")
    hard = _search(vectors, asked, held, dims, kind, negatives, False, anchor_rows, first_share)
    ids = placed.select(F.col("row").alias("anchor"), F.col("vec_id").alias("anchor_id"))
    hard = hard.select("anchor", (F.col("wish") + 1).alias("wish"), F.col("rank").cast("int").alias("rank"), F.col("vec_id").alias("negative_id"), F.col("score").alias("negative_score"))
    both = hard.join(bands.select("anchor", F.col("rank").alias("wish"), "positive_id", "positive_score"), ["anchor", "wish"]).join(ids, "anchor")
    return both.select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")
