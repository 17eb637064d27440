"""Operator 8. Compression classifier for quality.

Zstandard dictionaries are trained on good and on bad labelled text. A text is compressed with both, in pieces of `piece`
bytes so that the dictionaries and not the text's own beginning decide, and the difference of the two sizes over the text's
length says which kind it is nearer to. This is done in two views: the text itself, and its shape (runs of letters and digits
as one sign each, marks kept, a word equal to the one before it as "="), which shows repetition and layout that any
dictionary would compress away. A logistic fit on rows that trained no dictionary turns both differences into a probability.

Fit on a bounded sample: at most `per_class` labelled rows of each class, the first by a hash of doc_id. Half of them train the
dictionaries, in Spark: each gives pieces from all over its text, in the order of a hash, up to its share of `sample_bytes`, short
ones joined; the driver gets those pieces (some `sample_bytes` for each class and view, whatever the texts' lengths). The other
half calibrates: tasks give two numbers for each of its texts. Everything is scored, over whole texts. Only texts are inputs of a score.

Null texts count as empty; empty texts get the score of no size difference. Null labels and rows that are null in doc_id are not
learned from; where labels of a doc_id differ, each counts. With labels of fewer than two classes every score is the known share
of good rows (1 if no label is known). Repeated rows are scored alike. Empty tables give empty results; other columns are ignored.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from .common import flat, stored, text_batches

SHAPE = bytes.maketrans(bytes(range(256)), bytes(ord("a") if 97 <= b <= 122 or b > 127 else ord("A") if 65 <= b <= 90 else ord("0") if 48 <= b <= 57 else b for b in range(256)))
RUNS = re.compile(rb"(a)a+|(A)A+|(0)0+")


def shape(words: bytes) -> bytes:
    own = words.split(b" ")
    kinds = RUNS.sub(rb"\1\2\3", words.translate(SHAPE)).split(b" ")
    return b" ".join([kinds[0], *(b"=" if a == b else k for a, b, k in zip(own, own[1:], kinds[1:], strict=False))])


def _pieces(view: bytes, piece: int) -> list[bytes]:
    return [view[i : i + piece] for i in range(0, len(view), piece)]


def _hash(piece: bytes) -> int:
    return xxhash.xxh3_64_intdigest(piece, 8)


def _share(view: bytes, piece: int, most: int) -> list[bytes]:
    """Pieces of one text up to `most` bytes (one at least), by a hash of their content, so that no part of a text is preferred."""
    out, used = [], 0
    for x in sorted(_pieces(view, piece), key=_hash):
        if out and used + len(x) > most:
            break
        out.append(x)
        used += len(x)
    return out


def _dictionary(pieces: list[bytes], piece: int, size: int) -> bytes:
    sample: list[bytes] = []
    for x in sorted(pieces, key=_hash):  # short texts are joined, for the trainer takes no samples of a few bytes
        if sample and len(sample[-1]) + len(x) < piece:
            sample[-1] += b" " + x
        else:
            sample.append(x)
    try:
        return zstandard.train_dictionary(min(size, max(1024, sum(map(len, sample)) // 8)), sample, level=3).as_bytes()
    except zstandard.ZstdError:  # too few samples: the text itself serves
        return b"\n".join(sample)[-size:] or b"."


class Scorer:
    def __init__(self, dictionaries: list[tuple[bytes, bytes]], piece: int, weights: list[float] | None = None):
        self.piece, self.weights = piece, weights
        self.sides = [[zstandard.ZstdCompressor(level=3, dict_data=self._ready(d), write_content_size=False, write_dict_id=False, write_checksum=False) for d in pair] for pair in dictionaries]

    @staticmethod
    def _ready(data: bytes):
        d = zstandard.ZstdCompressionDict(data)
        d.precompute_compress(level=3)
        return d

    def features(self, text: str | None) -> list[float]:
        """Normalised size differences, bad minus good, of the text and of its shape."""
        words = flat(text)
        out = []
        for view, (bad, good) in zip((words, shape(words)), self.sides, strict=True):
            diff = sum(len(bad.compress(x)) - len(good.compress(x)) for x in _pieces(view, self.piece))
            out.append(diff / max(1, len(view)))
        return out

    def score(self, text: str | None) -> float:
        b, *w = self.weights
        return 1 / (1 + float(np.exp(-np.clip(b + np.dot(w, self.features(text)), -30, 30))))


def _logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1e-3) -> np.ndarray:
    """Newton steps for a logistic regression with an intercept; features are scaled within."""
    mean, scale = x.mean(axis=0), x.std(axis=0) + 1e-9
    a = np.column_stack([np.ones(len(x)), (x - mean) / scale])
    w = np.zeros(a.shape[1])
    for _ in range(40):
        p = 1 / (1 + np.exp(-np.clip(a @ w, -30, 30)))
        step = np.linalg.solve((a * (p * (1 - p))[:, None]).T @ a + ridge * len(x) * np.eye(len(w)), a.T @ (y - p) - ridge * len(x) * w)
        w += step
        if np.abs(step).max() < 1e-8:
            break
    return np.concatenate([[w[0] - (w[1:] * mean / scale).sum()], w[1:] / scale])


VIEWS = (lambda words: words, shape)


def fit(docs: DataFrame, labels: DataFrame, per_class: int = 1500, piece: int = 2048, size: int = 32 << 10, sample_bytes: int = 4 << 20) -> Scorer | float:
    """docs: doc_id, text; labels: doc_id, quality. A float is the score of all texts where nothing can be told apart.

    The sample is drawn from the labels alone; only its documents' texts are looked up.
    """
    known = labels.filter("quality in (0, 1) and doc_id is not null").select(F.col("doc_id").cast("long").alias("doc_id"), F.col("quality").cast("int").alias("quality")).distinct()
    order = F.xxhash64(F.col("doc_id"), F.lit("fit"))
    drawn = known.filter("quality = 0").orderBy(order, "doc_id").limit(per_class).unionByName(known.filter("quality = 1").orderBy(order, "doc_id").limit(per_class))
    rows = docs.select("doc_id", F.col("text").cast("string").alias("text")).join(F.broadcast(drawn), "doc_id")  # 2 * per_class rows at most, or as often as an id repeats
    sample = stored(rows.select("quality", "text", (F.pmod(F.xxhash64("doc_id", F.lit("half")), F.lit(2)) == 0).alias("trains")), "labelled")
    sizes = {(x.quality, x.trains): x.n for x in sample.groupBy("quality", "trains").agg(F.count(F.lit(1)).alias("n")).collect()}
    classes = {q for q, _ in sizes}
    if len(classes) < 2:
        return float(next(iter(classes), 1))
    if len(sizes) < 4:
        return sum(n for (q, _), n in sizes.items() if q) / sum(sizes.values())

    def pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in text_batches(batches):
            found = []
            for quality, text in zip(table["quality"].to_pylist(), table["text"], strict=True):
                words, most = flat(text.as_py()), sample_bytes // sizes[quality, True]
                found += [(quality, k, x) for k, view in enumerate(VIEWS) for x in _share(view(words), piece, most)]
            if found:
                yield pa.RecordBatch.from_pydict(dict(zip(("quality", "view", "piece"), zip(*found, strict=True), strict=True)), pa.schema([("quality", pa.int32()), ("view", pa.int32()), ("piece", pa.binary())]))

    taken: dict[tuple[int, int], list[bytes]] = {}
    for x in sample.filter("trains").mapInArrow(pieces, "quality int, view int, piece binary").collect():
        taken.setdefault((x.quality, x.view), []).append(bytes(x.piece))
    dictionaries = [tuple(_dictionary(taken.get((kind, k), []), piece, size) for kind in (0, 1)) for k in range(len(VIEWS))]

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(dictionaries, piece)
        for table in text_batches(batches):
            x = [scorer.features(t.as_py()) for t in table["text"]]
            yield pa.RecordBatch.from_arrays([table["quality"].combine_chunks(), pa.array(x, pa.list_(pa.float64()))], names=["quality", "x"])

    rest = sample.filter("not trains").mapInArrow(measure, "quality int, x array<double>").collect()
    rest.sort(key=lambda r: (r.quality, r.x))
    scorer = Scorer(dictionaries, piece)
    scorer.weights = _logistic(np.array([r.x for r in rest]), np.array([r.quality for r in rest], float)).tolist()
    scorer.dictionaries = dictionaries
    return scorer


def scores(docs: DataFrame, model: Scorer | float) -> DataFrame:
    """The columns of docs and score (0 to 1; higher: good is likelier), which replaces a column of that name."""
    docs = docs.drop("score")
    if isinstance(model, float):
        return docs.withColumn("score", F.lit(model))
    held = docs.sparkSession.sparkContext.broadcast((model.dictionaries, model.piece, model.weights))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(*held.value)
        for table in text_batches(batches):
            s = pa.array([scorer.score(t.as_py()) for t in table["text"]], pa.float64())
            yield from table.append_column("score", s).combine_chunks().to_batches()

    return docs.mapInArrow(run, StructType([*docs.schema, StructField("score", DoubleType())]))


def accepted(docs: DataFrame, model: Scorer | float, least: float) -> DataFrame:
    """The rows of docs, with all their columns, that score `least` or more."""
    if isinstance(model, float):
        return docs if model >= least else docs.limit(0)
    held = docs.sparkSession.sparkContext.broadcast((model.dictionaries, model.piece, model.weights))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(*held.value)
        for table in text_batches(batches):
            good = pa.array([scorer.score(t.as_py()) >= least for t in table["text"]], pa.bool_())
            yield from table.filter(good).combine_chunks().to_batches()

    return docs.mapInArrow(run, docs.schema)
