"""The corpus operators as queries over the given tables, with their production parameters."""

from __future__ import annotations

import os
import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import decontaminate, exact_dedup, hard_negatives, html_text, mixing, pii, quality, secrets, simhash_dedup, substring_dedup, token_alignment, token_rollup, toxicity
from .common import shared_dir

#: A public vocabulary file on the driver.
VOCABULARY = os.environ.get("QUADREL_VOCABULARY", "/opt/tokenizers/byte_bpe_50k.tiktoken")
#: Vocabulary files at one path on all machines.
TOKENIZERS = os.environ.get("QUADREL_TOKENIZERS", "/opt/tokenizers")
LEAST_QUALITY = 0.3
LEAST_TOXICITY = 0.3


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = substring_dedup.remove_repeats(table(spark, sf_dir, "documents"), width=20)
    return out.select("doc_id", "n_words", "n_removed", F.sha2("kept_text", 256).alias("kept_sha256"))


def op2_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.mark_copies(table(spark, sf_dir, "documents")).select("doc_id", "keep_id", "group_size", "kept", "text_sha256")


def op3_token_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents are inserted; then those labelled toxic are deleted and those of low quality revised to their text without its marks; the first batch arrives twice."""
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    roll = token_rollup.Rollup(spark, f"{shared_dir(spark)}/rollup-{uuid.uuid4().hex}")
    load = docs.select(F.lit("insert").alias("op"), "doc_id")
    counts = token_rollup.count_tokens(docs, VOCABULARY, "byte_bpe_50k/1")
    roll.commit("load", load, counts)
    edits = labels.filter("toxic = 1 or quality = 0").select(F.when(F.col("toxic") == 1, "delete").otherwise("revise").alias("op"), "doc_id")
    cleaned = token_rollup.changed(docs, edits).withColumn("text", F.regexp_replace("text", r"[!$%&*#|]+", ""))
    roll.commit("edits", edits, token_rollup.count_tokens(cleaned, VOCABULARY, "byte_bpe_50k/1"))
    roll.commit("load", load, counts)
    return roll.totals()


def op4_simhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash_dedup.near_copies(table(spark, sf_dir, "documents"), width=3, radius=2)


def op5_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def _joined(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["stop"].cast("string"))), ",")


def _digest(found: DataFrame, kinds: tuple[str, ...]) -> DataFrame:
    base = F.filter("spans", lambda s: s["base"])
    counts = [F.size(F.filter(base["kind"], lambda x: x == F.lit(k))).cast("long").alias(f"n_{k}") for k in kinds]  # noqa: B023
    return found.select("doc_id", *counts, F.sha2(_joined(base), 256).alias("base_sha256"), _joined(F.col("spans")).alias("spans"))


def op6_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _digest(pii.find_pii(table(spark, sf_dir, "documents")), pii.KINDS)


def op7_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_text.extract(table(spark, sf_dir, "pages")).withColumn("n_chars", F.length("text").cast("long"))


def held_out() -> Column:
    return F.crc32(F.col("doc_id").cast("string")) % 5 == 0


def quality_model(docs: DataFrame, labels: DataFrame):
    return quality.fit(docs.filter(~held_out()).select("doc_id", "text"), labels.filter(~held_out()))


def op8_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    scored = quality.scores(docs, quality_model(docs, table(spark, sf_dir, "labels")))
    return scored.select("doc_id", F.coalesce(held_out(), F.lit(False)).alias("held_out"), "score", (F.col("score") >= LEAST_QUALITY).cast("int").alias("predicted"))


def op9_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mixed(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


def op10_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _digest(secrets.find_secrets(table(spark, sf_dir, "documents")), tuple(r.kind for r in secrets.RULES if r.base))


def op11_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return hard_negatives.mine(table(spark, sf_dir, "embeddings").withColumn("label", label), F.col("vec_id") % 50 == 0)


def op12_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    apart = F.crc32(F.col("doc_id").cast("string")) % 4 == 2
    docs, labels = table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "labels")
    scored = toxicity.scores(docs, toxicity.fit(docs.filter(~apart), labels.filter(~apart)))
    return scored.select("doc_id", F.coalesce(apart, F.lit(False)).alias("held_out"), "score", (F.col("score") >= LEAST_TOXICITY).cast("int").alias("predicted"))


def op13_token_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_alignment.align(table(spark, sf_dir, "documents"), f"{TOKENIZERS}/byte_bpe_50k.json", f"{TOKENIZERS}/piece_bpe_32k.model")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (op1_substring_dedup, op2_exact_dedup, op3_token_rollup, op4_simhash_dedup, op5_decontaminate, op6_pii, op7_html_text, op8_quality, op9_mixing, op10_secrets, op11_hard_negatives, op12_toxicity, op13_token_alignment)}


#: Words of every document in order, from 0; a document without words has no row.
_WORDS = r"""
words AS (SELECT doc_id, generate_subscripts(w, 1) - 1 AS i, unnest(w) AS word
          FROM (SELECT doc_id, regexp_extract_all(text, '[^\x20\x09-\x0D]+') AS w FROM documents WHERE text IS NOT NULL))"""


def oracle_sql() -> dict[str, str]:
    return {
        "op1_substring_dedup": rf"""WITH {_WORDS.strip()},
windows AS (SELECT doc_id, i, string_agg(word, ' ') OVER w AS seq, count(*) OVER w AS n
            FROM words WINDOW w AS (PARTITION BY doc_id ORDER BY i ROWS BETWEEN CURRENT ROW AND 19 FOLLOWING)),
ranked AS (SELECT doc_id, i, row_number() OVER (PARTITION BY seq ORDER BY doc_id, i) AS nth FROM windows WHERE n = 20),
late AS (SELECT doc_id, i FROM ranked WHERE nth > 1),
marked AS (SELECT w.doc_id, w.i, w.word, max(l.i) OVER (PARTITION BY w.doc_id ORDER BY w.i) AS last_late FROM words w LEFT JOIN late l ON l.doc_id = w.doc_id AND l.i = w.i),
per AS (SELECT doc_id, count(*) AS n_words, count(*) FILTER (WHERE last_late > i - 20) AS n_removed,
               string_agg(word, ' ' ORDER BY i) FILTER (WHERE last_late IS NULL OR last_late <= i - 20) AS kept FROM marked GROUP BY doc_id)
SELECT d.doc_id, coalesce(n_words, 0) AS n_words, coalesce(n_removed, 0) AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256
FROM documents d LEFT JOIN per USING (doc_id)""",
        "op2_exact_dedup": r"""WITH t AS (SELECT doc_id, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g') AS norm FROM documents)
SELECT doc_id, min(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size, doc_id = min(doc_id) OVER w AS kept, sha256(norm) AS text_sha256
FROM t WINDOW w AS (PARTITION BY norm)""",
        "op9_mixing": _MIX,
        "op11_hard_negatives": """WITH v AS (
  SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS q
  FROM embeddings WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT a.vec_id AS anchor_id, a.label = b.label AS same, b.vec_id AS other, list_dot_product(a.q, b.q)::BIGINT AS score FROM v a JOIN v b ON a.vec_id <> b.vec_id WHERE a.vec_id % 50 = 0),
pos AS (SELECT anchor_id, other AS positive_id, score AS positive_score FROM s WHERE same QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, other) <= 5),
neg AS (SELECT pos.*, other AS negative_id, score AS negative_score, row_number() OVER (PARTITION BY anchor_id, positive_id ORDER BY score DESC, other) AS nth
        FROM pos JOIN s USING (anchor_id) WHERE NOT same AND 50 * positive_score <= 100 * score AND 100 * score <= 95 * positive_score)
SELECT anchor_id, positive_id, nth::INTEGER AS rank, negative_id, positive_score, negative_score FROM neg WHERE nth <= 3""",
    }


_MIX = r"""WITH RECURSIVE sized AS (SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size FROM documents),
src AS (SELECT source, sum(size)::BIGINT AS n, [5.0, 2.0, 1.0][1 + (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3]::DOUBLE AS weight FROM sized GROUP BY source),
fill AS (
  SELECT 0 AS step, source, n, weight, NULL::DOUBLE AS fixed, 1.5 * (SELECT sum(n) FROM src)::DOUBLE AS rest FROM src
  UNION ALL
  SELECT step + 1, source, n, weight, CASE WHEN fixed IS NULL AND weight * unit > 2 * n THEN 2.0 * n ELSE fixed END, rest
  FROM (SELECT *, (rest - coalesce(sum(fixed) OVER (), 0)) / nullif(sum(weight) FILTER (WHERE fixed IS NULL) OVER (), 0) AS unit FROM fill) x WHERE step < 40),
goal AS (SELECT source, n, coalesce(fixed, weight * (rest - coalesce(sum(fixed) OVER (), 0)) / nullif(sum(weight) FILTER (WHERE fixed IS NULL) OVER (), 0)) AS target FROM fill WHERE step = 40),
placed AS (SELECT doc_id, source, size, coalesce(sum(size) OVER (PARTITION BY source ORDER BY ('0x' || substr(md5('mix:' || doc_id), 1, 15))::BIGINT, doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM sized)
SELECT doc_id, size, n AS source_size, target, (size * ((before + size / 2 <= target AND size > 0)::INT + (n + before + size / 2 <= target AND size > 0)::INT))::BIGINT AS taken
FROM placed p JOIN goal g ON p.source IS NOT DISTINCT FROM g.source"""
