"""Operator 2. Exact dedup by content sort, in DataFrame operations only.

Rows are range-partitioned by their normalised bytes, sorted within each partition by an external sort, and compared in full
with their neighbours (the window's frame ends where the text changes), which leaves the smallest doc_id. Spark samples the
splitters; of a text they hold its first characters and an 8-byte hash of the rest, for whole texts would swell the
sample that the driver sorts. Texts that hold more rows than a partition should are found first by counting 8-byte hashes with
partial aggregation; their copies are dealt to several partitions by a salt, and the few heads that the salts leave are
merged in a second sort. At most `partitions` texts per `1/share` can be that frequent, which bounds the broadcast.

A null text counts as empty. A null doc_id ranks before all others. Repeated rows are copies of one another. An empty
table gives an empty result. Of other columns those named in `keep` are carried along.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import SPACE, key_of

#: Characters of a text in a splitter.
FRONT = 48


def mark_copies(docs: DataFrame, keep: tuple[str, ...] = (), partitions: int | None = None, share: float = 0.25) -> DataFrame:
    """One row for each document: doc_id, keep_id, group_size, kept, norm, and the columns in `keep`.

    Exactly one row of each group is kept, also where rows share a doc_id. A text is hot that holds over `share` of an even partition's rows.
    """
    spark = docs.sparkSession
    n = partitions or int(spark.conf.get("spark.sql.shuffle.partitions"))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.regexp_replace(F.coalesce(F.col("text").cast("string"), F.lit("")), f"{SPACE}+", " ").alias("norm"), *(F.col(c).alias(f"_{c}") for c in keep))
    rows = rows.withColumns({"key": key_of("doc_id"), "h": F.xxhash64("norm")})
    per = rows.groupBy("h").agg(F.count(F.lit(1)).alias("n"))
    even = max(1.0, share * docs.count() / n)
    found = [(x.h, int(x.n // even) + 1) for x in per.filter(F.col("n") > even).collect()]  # n / share rows at most
    hot = spark.createDataFrame(found, "h long, salts long")
    salt = F.when(F.col("salts").isNotNull(), F.pmod(F.xxhash64("key", F.lit(1)), "salts")).otherwise(F.lit(0)).alias("salt")
    front = F.substring("norm", 1, FRONT).alias("front")
    dealt = rows.join(F.broadcast(hot), "h", "left").select("doc_id", "key", "norm", "h", front, *(f"_{c}" for c in keep), F.col("salts").isNotNull().alias("hot"), salt)
    part = Window.partitionBy("front", "h", "norm", "salt")
    first = part.orderBy("key")
    sorted_ = dealt.repartitionByRange(n, "front", "h", "salt").select(
        "*", F.row_number().over(first).alias("nth"), F.min("key").over(part).alias("low"), F.count(F.lit(1)).over(part).alias("size")
    )
    # Of a text that isn't hot there is one salt, so its head is the head of all.
    if not found:
        sorted_ = sorted_.withColumns({"best": F.lit(None).cast("struct<low:long,salt:long>"), "all": F.lit(None).cast("long"), "text_sha256": F.sha2("norm", 256)})
        return _result(sorted_, keep)
    heads = dealt.filter("hot").groupBy("norm", "salt").agg(F.min("key").alias("low"), F.count(F.lit(1)).alias("size"))
    whole = heads.groupBy("norm").agg(F.min(F.struct("low", "salt")).alias("best"), F.sum("size").alias("all"))
    hot_ids = whole.select(F.xxhash64("norm").alias("wh"), F.sha2("norm", 256).alias("wsha"), "best", "all")
    out = sorted_.withColumn("text_sha256", F.sha2("norm", 256)).join(F.broadcast(hot_ids), F.col("hot") & (F.col("text_sha256") == F.col("wsha")), "left")
    return _result(out, keep)


def _result(out: DataFrame, keep: tuple[str, ...]) -> DataFrame:
    keep_key = F.coalesce(F.col("best.low"), F.col("low"))
    kept = (F.col("nth") == 1) & (F.col("best").isNull() | (F.col("salt") == F.col("best.salt")) & (F.col("low") == F.col("best.low")))
    return out.select(
        "doc_id", F.when(keep_key != F.lit(-(2**63)), keep_key).alias("keep_id"), F.coalesce(F.col("all"), F.col("size")).alias("group_size"), kept.alias("kept"), "norm", "text_sha256", *(F.col(f"_{c}").alias(f"carried_{c}") for c in keep)
    )
