"""A corpus pipeline of five stages. Each stage's rows are written as Parquet in the shared folder and read again as the next one's documents."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quadrel.llm import decontaminate, exact_dedup, mixing, quality, queries, simhash_dedup
from quadrel.llm.common import stored


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the compression classifier rejects go. Null texts count as empty and are scored like others."""
    model = queries.quality_model(docs, queries.table(spark, sf_dir, "labels"))
    return quality.accepted(docs, model, queries.LEAST_QUALITY)


def exact_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts the smallest doc_id stays; of rows that share it exactly one. A null doc_id ranks first, null texts equal empty ones."""
    rest = tuple(c for c in docs.columns if c != "doc_id")
    kept = exact_dedup.mark_copies(docs, keep=rest).filter("kept")
    return kept.select(*(F.col(c if c == "doc_id" else f"carried_{c}").alias(c) for c in docs.columns))


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of texts that are similar at 0.8 or more in five-word shingles the smallest doc_id stays; of rows that share it exactly one. Null and empty texts are one group."""
    return simhash_dedup.first_of_similar(docs, width=5, similarity=0.8)


def benchmark_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark passage go, row by row: ids, shared or null, play no part."""
    return decontaminate.uncontaminated(docs, queries.table(spark, sf_dir, "benchmark"))


def source_mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the mix takes, with their size, their source's target, the number of copies and the words that these hold; columns of those names give way. Rows of one doc_id and text are taken together."""
    out = mixing.mixed(docs, keep=tuple(docs.columns)).filter("copies > 0")
    rest = [c for c in docs.columns if c in out.columns and c not in MIX]
    return out.select(*rest, *MIX)


#: What the last stage adds.
MIX = ("size", "target", "copies", "taken")

STAGES = [
    ("quality classifier", quality_classifier),
    ("exact dedup", exact_copies),
    ("simhash near-dedup", near_copies),
    ("benchmark decontamination", benchmark_leaks),
    ("mixing sources", source_mix),
]

#: A trained classifier and fingerprints can't be expressed in SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = queries.table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = stored(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return docs
