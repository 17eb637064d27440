"""Operator 3. Token counts as delta-maintained rollups.

The state is a log of signed deltas, summed by source, language and tokenizer version, one folder for each committed batch.
A batch is a table of changes (op, doc_id, text, lang, source, tokenizer): `insert` adds a document's counts, `delete` takes
back the counts that the document had, `revise` does both. What a document counted before is read from the same log's
document part, so totals stay additive and are never recounted. A commit is keyed by its batch id: the batch is written
under a temporary name and renamed to `batch=<id>`, and a batch whose folder exists is skipped, so a retry changes nothing.

A null text counts no tokens; null sources and languages form groups of their own, and a null doc_id is an id like any other. Within
a batch, repeated rows of one document (all columns and the text equal) are one change, and texts that share a doc_id count each;
different operations on one document, and unknown ones, are an error that commits nothing. An insert trusts its caller: a document
that counts already counts again (use revise). Empty batches commit and change nothing. Other columns are ignored. One writer at a time.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator

import pyarrow as pa
import tiktoken
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import WORD, key_of, text_batches

#: The split of a text into pieces that the public byte-level vocabularies assume; a fixed value.
PIECES = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
TOTALS = ("documents", "tokens", "words", "characters")
GROUP = ("source", "lang", "tokenizer")


def ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}


def count_tokens(docs: DataFrame, vocabulary: str, version: str) -> DataFrame:
    """docs with columns tokenizer, tokens, words, characters and a hash of the text. The vocabulary is a file of the driver and is broadcast (some 50,000 entries)."""
    table = docs.sparkSession.sparkContext.broadcast(ranks(vocabulary))
    schema = docs.select("doc_id", "source", "lang", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokenizer = tiktoken.Encoding("own", pat_str=PIECES, mergeable_ranks=table.value, special_tokens={})
        for part in text_batches(batches):
            n = [len(tokenizer.encode_ordinary(t.as_py() or "")) for t in part["text"]]
            for batch in part.append_column("tokens", pa.array(n, pa.int64())).combine_chunks().to_batches():
                yield batch

    counted = schema.mapInArrow(run, f"{', '.join(f'{n} {t}' for n, t in schema.dtypes)}, tokens long")
    text = F.coalesce("text", F.lit(""))
    return counted.select("doc_id", "source", "lang", F.lit(version).alias("tokenizer"), "tokens", F.size(F.regexp_extract_all(text, F.lit(WORD), F.lit(0))).cast("long").alias("words"), F.length(text).cast("long").alias("characters"), F.xxhash64("text").alias("text_hash"))


def changed(docs: DataFrame, changes: DataFrame, broadcast_rows: int = 4_000_000) -> DataFrame:
    """The documents that a batch (op, doc_id) inserts or revises, so that no other is tokenised. The batch's ids are broadcast up to `broadcast_rows` (some 100 MB); beyond, both sides are shuffled by id."""
    ids = changes.filter("op in ('insert', 'revise')").select(key_of("doc_id").alias("_of")).distinct()
    few = changes.count() <= broadcast_rows
    return docs.join(F.broadcast(ids) if few else ids, key_of("doc_id") == F.col("_of"), "left_semi")


class Rollup:
    """Totals by source, language and tokenizer version, under one folder of a shared store."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")

    def _fs(self):
        jvm = self.spark.sparkContext._jvm
        root = jvm.org.apache.hadoop.fs.Path(self.path)
        return root.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()), jvm.org.apache.hadoop.fs.Path

    def committed(self, batch: str) -> bool:
        fs, path = self._fs()
        return fs.exists(path(f"{self.path}/batch={batch}"))

    def _log(self, part: str, schema: str) -> DataFrame:
        fs, path = self._fs()
        found = sorted(str(x.getPath()) for x in (fs.globStatus(path(f"{self.path}/batch=*/{part}")) or ()))
        return self.spark.read.schema(schema).parquet(*found) if found else self.spark.createDataFrame([], schema)

    def documents(self) -> DataFrame:
        """Signed rows of every batch; what a document counts now is the sum of its rows."""
        return self._log("documents", "doc_id long, source string, lang string, tokenizer string, documents long, tokens long, words long, characters long")

    def totals(self) -> DataFrame:
        """Sums over the batches' own sums: work follows the number of groups and batches, not of documents."""
        log = self._log("totals", "source string, lang string, tokenizer string, documents long, tokens long, words long, characters long")
        return log.groupBy(*GROUP).agg(*(F.sum(c).alias(c) for c in TOTALS)).filter("documents <> 0 or tokens <> 0 or words <> 0 or characters <> 0")

    def commit(self, batch: str, changes: DataFrame, counts: DataFrame) -> bool:
        """changes: (op, doc_id); counts: what documents that are inserted or revised count, from count_tokens(). False if the batch was there already."""
        if self.committed(batch):
            return False
        own = changes.groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.min("op").alias("op"), F.max("op").alias("other"), F.count("op").alias("n"), F.count(F.lit(1)).alias("all"))
        fair = F.col("op").isin("insert", "delete", "revise") & (F.col("op") == F.col("other")) & (F.col("n") == F.col("all"))
        wrong = F.raise_error(F.concat(F.lit("no single known operation on document "), F.coalesce(F.col("doc_id").cast("string"), F.lit("null"))))
        ops = own.select(F.col("doc_id").alias("of"), F.when(fair, F.col("op")).otherwise(wrong).alias("op"))
        same = F.col("doc_id").eqNullSafe(F.col("of"))
        one = lambda sign: (F.lit(sign).alias("documents"), *((F.col(c) * sign).alias(c) for c in TOTALS[1:]))
        plus = counts.distinct().join(ops.filter("op in ('insert', 'revise')").select("of"), same, "left_semi").select("doc_id", *GROUP, *one(1))
        signed = plus
        if not ops.filter("op <> 'insert'").isEmpty():
            was = self.documents().join(ops.filter("op in ('delete', 'revise')").select("of"), same, "left_semi")
            now = was.groupBy("doc_id", *GROUP).agg(*(F.sum(c).alias(c) for c in TOTALS)).filter("documents <> 0")
            signed = plus.unionByName(now.select("doc_id", *GROUP, *((-F.col(c)).alias(c) for c in TOTALS)))
        fs, path = self._fs()
        trial = f"{self.path}/_trial-{batch}"
        fs.delete(path(trial), True)  # of an attempt that ended before its rename
        signed.write.parquet(f"{trial}/documents")
        rows = self.spark.read.schema(signed.schema).parquet(f"{trial}/documents")
        rows.groupBy(*GROUP).agg(*(F.sum(c).alias(c) for c in TOTALS)).coalesce(1).write.parquet(f"{trial}/totals")  # a row for each group
        return fs.rename(path(trial), path(f"{self.path}/batch={batch}"))
