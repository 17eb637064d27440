"""Operator 13. Cross-tokenizer alignment, each distinct text once.

Texts are shuffled in full and grouped (copies meet map-side first, so a hot text costs one row a task); each distinct text is
tokenised by A (a byte-level BPE file) and B (a piece BPE model) and aligned once. Byte offsets where tokens of both end cut
a text into groups; the links are the pairs whose byte ranges overlap, one for each piece between two neighbouring ends. A
text's links are kept packed (id pairs and how often), the corpus-wide count of an id pair is their sum weighted by the
text's multiplicity, and measures that need those counts come from a second pass over the packed links, against the counts in
blocks of at most `block_pairs` pairs (a pass for each block). Measures are joined to doc_ids by the SHA-256 of the text.

Neither tokenizer has a token across a space between two visible signs, but one that starts with the space. So texts are cut
there, and a task tokenises and aligns each distinct piece of text once, as tokenizers do with words; of B's pieces this is checked when
the model is loaded, and texts are cut nowhere if it doesn't hold. The cache holds at most `CACHED` pieces between batches.

Null and empty texts, and those whose bytes a tokenizer doesn't give back (B: a U+2581 of the text's own, invalid UTF-8), have no
tokens: zeros and ''. Repeated rows and shared or null doc_ids give a row each; their links count each time. Empty tables give empty
results, other columns are ignored. Very long texts are cut like others; without any space they are one piece.
"""

from __future__ import annotations

import hashlib
import json
import re
from collections.abc import Iterator
from functools import cache, reduce

import numpy as np
import pyarrow as pa
import sentencepiece
import tiktoken
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import stored, text_batches

#: How the byte-level tokenizer cuts text before it merges: fixed by its vocabulary.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
CUT = re.compile(r"(?<=[!-~À-ɏ]) (?=[!-~À-ɏ])")
ODD = re.compile(r"\A\s|\s\s|\s\Z")
CACHED = 300_000
BATCH = 8 << 20


def byte_signs() -> dict[str, int]:
    """The sign that stands for each byte in a byte-level vocabulary: itself where it is visible, else the next free one from U+0100."""
    plain = {*range(33, 127), *range(161, 173), *range(174, 256)}
    rest = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


@cache
def byte_tokenizer(path: str) -> tuple[tiktoken.Encoding, list[bytes]]:
    """The tokenizer of a byte-level BPE file (JSON), without its special tokens, and the bytes of each id.

    Merging the pair of lowest id is merging by the file's order, as long as the ids follow that order: checked here.
    """
    with open(path, encoding="utf-8") as f:
        model = json.load(f)["model"]
    signs, vocab = byte_signs(), model["vocab"]
    merges = [m.split(" ") if isinstance(m, str) else m for m in model["merges"]]
    made = [vocab[a + b] for a, b in merges]
    if any(x >= y for x, y in zip(made, made[1:], strict=False)):
        raise ValueError(f"{path}: ids don't follow the order of merges")
    whole = {*made, *(vocab[c] for c in signs)}
    ranks = {bytes(signs[c] for c in token): i for token, i in vocab.items() if i in whole}
    of = [b""] * (max(ranks.values()) + 1)
    for token, i in ranks.items():
        of[i] = token
    return tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={}), of


@cache
def piece_tokenizer(path: str) -> tuple[sentencepiece.SentencePieceProcessor, list[bytes], bool]:
    """The model, the bytes of each id, and whether no piece goes on across a space."""
    model = sentencepiece.SentencePieceProcessor(model_file=path)
    of, apart = [], True
    for i in range(model.get_piece_size()):
        piece = model.id_to_piece(i)
        apart &= "▁" not in piece.lstrip("▁")
        of.append(bytes([int(piece[3:5], 16)]) if model.is_byte(i) else piece.replace("▁", " ").encode())
    return model, of, apart


class Aligner:
    """Alignments of pieces of text, with numbers by which they are kept."""

    def __init__(self, a_path: str, b_path: str):
        self.a, self.a_bytes = byte_tokenizer(a_path)
        self.b, self.b_bytes, self.apart = piece_tokenizer(b_path)
        if len(self.a_bytes) * len(self.b_bytes) > 2**32:
            raise ValueError("the vocabularies have more pairs of ids than 32 bits name")
        self.a_len, self.b_len = (np.array([len(x) for x in of], np.int64) for of in (self.a_bytes, self.b_bytes))
        a_id, b_id = (np.array([b"%d" % i for i in range(len(of))], object) for of in (self.a_bytes, self.b_bytes))
        # What an id is followed by within its side of a group, and at the side's end.
        self.signs = np.concatenate([a_id + b",", a_id + b"|", b_id + b",", b_id + b";"])
        self.clear()

    def clear(self) -> None:
        self.index: dict[str, int] = {}
        self.groups: list[bytes | None] = []
        self.measures = np.zeros((0, 4), np.int64)  # A tokens, B tokens, groups, links
        self.first = np.zeros(1, np.int64)  # of each piece's links in `links`
        self.links = np.zeros(0, np.uint32)

    def add(self, pieces: list[str]) -> None:
        """Tokenise and align new pieces, all at once."""
        of_b = self.b.encode(pieces, num_threads=1)
        known, a_ids, b_ids = [], [], []
        for piece, b in zip(pieces, of_b, strict=True):
            whole = b" " + piece.encode("utf-8", "surrogatepass")
            a = self.a.encode_ordinary(" " + piece)
            good = b"".join([self.a_bytes[i] for i in a]) == whole == b"".join([self.b_bytes[i] for i in b])
            known.append(good)
            a_ids.append(a if good else [])
            b_ids.append(b if good else [])
        n_a, n_b = (np.array([len(x) for x in ids], np.int64) for ids in (a_ids, b_ids))
        a, b = (np.fromiter((i for x in ids for i in x), np.int64) for ids in (a_ids, b_ids))
        a_end, b_end = np.cumsum(self.a_len[a]), np.cumsum(self.b_len[b])  # both run over all pieces, which end together
        ends = np.union1d(a_end, b_end)
        a_at, b_at = np.searchsorted(a_end, ends), np.searchsorted(b_end, ends)
        both = (a_end[a_at] == ends) & (b_end[b_at] == ends) if len(ends) else np.zeros(0, bool)
        code = (a[a_at] * len(self.b_bytes) + b[b_at]).astype(np.uint32)
        cuts = ends[both]
        # Of each token the group; A's tokens of a group come before B's.
        a_group, b_group = np.searchsorted(cuts, a_end), np.searchsorted(cuts, b_end)
        a_last, b_last = a_end == cuts[a_group] if len(cuts) else [], b_end == cuts[b_group] if len(cuts) else []
        sign = np.empty(len(a) + len(b), np.int64)
        k = len(self.a_bytes)
        sign[np.arange(len(a)) + np.searchsorted(b_group, a_group)] = a + k * np.asarray(a_last, np.int64)
        sign[np.arange(len(b)) + np.searchsorted(a_group, b_group, "right")] = b + 2 * k + len(self.b_bytes) * np.asarray(b_last, np.int64)
        text = self.signs[sign].tolist()
        last = np.cumsum(self.a_len[a])[np.cumsum(n_a) - 1] if len(a) else np.zeros(0, np.int64)
        stop = np.where(np.cumsum(n_a) > 0, last, 0) if len(a) else np.zeros(len(pieces), np.int64)
        n_links = np.diff(np.searchsorted(ends, stop, "right"), prepend=0)
        n_groups = np.diff(np.searchsorted(cuts, stop, "right"), prepend=0)
        at = 0
        for good, n in zip(known, (n_a + n_b).tolist(), strict=True):
            self.groups.append(b"".join(text[at : at + n])[:-1] if good else None)
            at += n
        for piece in pieces:
            self.index[piece] = len(self.index)
        self.measures = np.concatenate([self.measures, np.stack([n_a, n_b, n_groups, n_links], axis=1)])
        self.first = np.concatenate([self.first, self.first[-1] + np.cumsum(n_links)])
        self.links = np.concatenate([self.links, code])

    def cut(self, text: str) -> list[str]:
        if not self.apart:
            return [text]
        return CUT.split(text) if ODD.search(text) else text.split(" ")

    def align(self, texts: list[str | None]) -> Iterator[tuple[np.ndarray, str, np.ndarray, np.ndarray] | None]:
        """Of each text the four measures, the digest of its groups, its distinct links and their numbers; None without tokens."""
        if len(self.index) > CACHED:
            self.clear()
        cut = [self.cut(t) if t else [] for t in texts]
        get = self.index.get
        new = dict.fromkeys(p for pieces in cut for p in pieces if get(p) is None)
        if new:
            self.add(list(new))
        for pieces in cut:
            ids = [get(p) for p in pieces]
            parts = [self.groups[i] for i in ids]
            if not parts or None in parts:
                yield None
                continue
            ids = np.array(ids)
            start, n = self.first[ids], self.measures[ids, 3]
            at = np.repeat(start - (np.cumsum(n) - n), n) + np.arange(n.sum())
            yield self.measures[ids].sum(axis=0), hashlib.sha256(b";".join(parts)).hexdigest(), *np.unique(self.links[at], return_counts=True)


def pack(codes: np.ndarray, counts: np.ndarray, packer: zstandard.ZstdCompressor) -> bytes:
    """Ascending codes and their counts: differences and counts, byte by byte."""
    planes = np.stack([np.diff(codes, prepend=np.uint32(0)), counts.astype(np.uint32)])
    return packer.compress(planes.view(np.uint8).reshape(2, -1, 4).swapaxes(1, 2).tobytes())


def unpack(packed: bytes, opener: zstandard.ZstdDecompressor) -> tuple[np.ndarray, np.ndarray]:
    planes = np.frombuffer(opener.decompress(packed), np.uint8).reshape(2, 4, -1).swapaxes(1, 2)
    gaps, counts = np.ascontiguousarray(planes).view(np.uint32)[..., 0]
    return np.cumsum(gaps, dtype=np.uint32), counts.astype(np.int64)


def aligned_texts(docs: DataFrame, a_path: str, b_path: str) -> DataFrame:
    """A row for each distinct text that has tokens: text_id (SHA-256), copies, n_a, n_b, n_groups, n_links, groups_sha256, packed links."""
    texts = docs.filter("text != ''").groupBy(F.col("text").cast("string").alias("text")).agg(F.count(F.lit(1)).alias("copies"))
    named = texts.select(F.unhex(F.sha2("text", 256)).alias("text_id"), "copies", F.col("text").cast("binary").alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        aligner, packer = Aligner(a_path, b_path), zstandard.ZstdCompressor(level=1)
        for table in text_batches(batches, limit=BATCH):
            found = [x and (*x[0].tolist(), x[1], pack(x[2], x[3], packer)) for x in aligner.align([_decoded(t.as_py()) for t in table["text"]])]
            own = table.select(["text_id", "copies"]).filter(pa.array([x is not None for x in found])).combine_chunks()
            columns = list(zip(*(x for x in found if x), strict=True)) or [[]] * 6
            for name, kind, column in zip(MEASURES, (*[pa.int64()] * 4, pa.string(), pa.binary()), columns, strict=True):
                own = own.append_column(name, pa.array(column, kind))
            yield from own.to_batches()

    return named.mapInArrow(run, "text_id binary, copies long, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, packed binary")


MEASURES = ("n_a", "n_b", "n_groups", "n_links", "groups_sha256", "packed")


def _decoded(text: bytes) -> str | None:
    try:
        return text.decode()
    except UnicodeDecodeError:
        return None


def pair_counts(texts: DataFrame, most: int = 1 << 21) -> DataFrame:
    """pair, n: how many links of the whole corpus hold a pair of ids. A task sums up to `most` of them before it gives them on."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        opener, held, size = zstandard.ZstdDecompressor(), [], 0

        def summed() -> tuple[np.ndarray, np.ndarray]:
            codes, at = np.unique(np.concatenate([c for c, _ in held]), return_inverse=True)
            n = np.zeros(len(codes), np.int64)
            np.add.at(n, at, np.concatenate([n for _, n in held]))
            return codes, n

        for batch in batches:
            for copies, packed in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                codes, n = unpack(packed.as_py(), opener)
                held.append((codes, n * copies))
                size += len(codes)
                if size >= most:
                    held = [summed()]
                    size = len(held[0][0])
                    if size >= most // 2:
                        yield pa.RecordBatch.from_arrays([pa.array(held[0][0].astype(np.int64)), pa.array(held[0][1])], names=["pair", "n"])
                        held, size = [], 0
        if held:
            codes, n = summed()
            yield pa.RecordBatch.from_arrays([pa.array(codes.astype(np.int64)), pa.array(n)], names=["pair", "n"])

    return texts.select("copies", "packed").mapInArrow(run, "pair long, n long").groupBy("pair").agg(F.sum("n").alias("n"))


def _weighed(texts: DataFrame, block: DataFrame) -> DataFrame | None:
    """What the pairs of one block (pair, n, best) give each text: n_best, count_sum. None if the block is empty."""
    table = block.toArrow()
    if not table.num_rows:
        return None
    order = np.argsort(table["pair"].to_numpy())
    pairs, n, best = (np.asarray(table[c].to_numpy())[order] for c in ("pair", "n", "best"))
    held = texts.sparkSession.sparkContext.broadcast((pairs.astype(np.uint32), n, best))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        opener, (pairs, n, best) = zstandard.ZstdDecompressor(), held.value
        for batch in batches:
            out = []
            for packed in batch.column(1):
                codes, times = unpack(packed.as_py(), opener)
                at = np.minimum(np.searchsorted(pairs, codes), len(pairs) - 1)
                times = np.where(pairs[at] == codes, times, 0)
                out.append((int(times[best[at]].sum()), int((times * n[at]).sum())))
            sums = list(zip(*out, strict=True)) or [[], []]
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(x, pa.int64()) for x in sums)], names=["text_id", "n_best", "count_sum"])

    return texts.select("text_id", "packed").mapInArrow(run, "text_id binary, n_best long, count_sum long")


def align(docs: DataFrame, a_path: str, b_path: str, block_pairs: int = 4_000_000) -> DataFrame:
    """One row for each document: doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256."""
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    texts = stored(aligned_texts(docs, a_path, b_path), "aligned")
    n_b = len(piece_tokenizer(b_path)[1])
    counts = pair_counts(texts)
    counted = stored(counts.withColumn("b", F.col("pair") % n_b), "pairs")
    highest = counted.groupBy("b").agg(F.max("n").alias("most"))  # at most one row for each id of B
    n_blocks = max(1, -(-counted.count() // block_pairs))
    ranked = counted.join(F.broadcast(highest), "b").select("pair", "n", (F.col("n") == F.col("most")).alias("best"), F.pmod(F.xxhash64("pair"), F.lit(n_blocks)).alias("block"))
    if n_blocks > 1:
        ranked = stored(ranked, "ranked-pairs")
    parts = [part for i in range(n_blocks) if (part := _weighed(texts, ranked.filter(F.col("block") == i)))] or [texts.select("text_id", *(F.lit(0).cast("long").alias(c) for c in ("n_best", "count_sum")))]
    sums = parts[0] if len(parts) == 1 else reduce(DataFrame.unionByName, parts).groupBy("text_id").agg(F.sum("n_best").alias("n_best"), F.sum("count_sum").alias("count_sum"))
    measures = stored(texts.select("text_id", "n_a", "n_b", "n_groups", "n_links", "groups_sha256").join(sums, "text_id"), "measures")
    named = docs.select("doc_id", F.when(F.col("text") != "", F.unhex(F.sha2("text", 256))).alias("text_id"))
    zero = {c: F.coalesce(c, F.lit(0).cast("long")).alias(c) for c in ("n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum")}
    return named.join(measures, "text_id", "left").select("doc_id", *zero.values(), F.coalesce("groups_sha256", F.lit("")).alias("groups_sha256"))
