"""Pieces of files: digests, ranges, verification and availability."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def piece_digests(files: DataFrame, piece: int = 4 << 20) -> DataFrame:
    """SHA-1 of each piece of (key, content) rows, and of the whole file the MD5."""
    data = files.select("key", F.col("content").cast("binary").alias("content")).withColumn("_n", F.greatest(F.lit(1), F.ceil(F.octet_length("content") / piece)).cast("int"))
    digests = F.transform(F.sequence(F.lit(0), F.col("_n") - 1), lambda i: F.sha1(F.substring(F.col("content"), i * piece + 1, F.lit(piece))))  # of the content no copy is made
    return data.select("key", F.md5("content").alias("file_md5"), F.posexplode(digests).alias("piece", "sha1"))


def piece_ranges(ranges: DataFrame, piece: int) -> DataFrame:
    """First and last piece of byte ranges [begin, stop)."""
    return ranges.withColumns({"first_piece": F.floor(F.col("begin") / piece).cast("long"), "last_piece": F.floor((F.col("stop") - 1) / piece).cast("long")})


def pieces_of_ranges(ranges: DataFrame, piece: int) -> DataFrame:
    return piece_ranges(ranges, piece).withColumn("piece", F.explode(F.sequence("first_piece", "last_piece")))


def verified(found: DataFrame, expected: DataFrame) -> DataFrame:
    """Share of pieces whose digest is the expected one, and the first that isn't."""
    both = expected.withColumnRenamed("sha1", "_want").join(found.select("key", "piece", "sha1"), ["key", "piece"], "left")
    good = F.coalesce(F.col("sha1") == F.col("_want"), F.lit(False))
    return both.groupBy("key").agg(F.count(F.lit(1)).alias("pieces"), F.avg(good.cast("int")).alias("share"), F.min(F.when(~good, F.col("piece"))).alias("first_bad"))


def sampled_pieces(expected: DataFrame, claims: DataFrame, most: int = 3) -> DataFrame:
    """Of each key's expected pieces (key, piece, ...) the `most` to look at: first those that claims (key, piece, held) disputes, in order, then the first, the middle and the last. Ranks are cut where rows are before they are shuffled."""
    n = expected.groupBy("key").agg((F.max("piece") + 1).alias("_n"))
    spread = n.select("key", F.posexplode(F.array(F.lit(0), F.floor(F.col("_n") / 2).cast("int"), F.col("_n") - 1)).alias("_nth", "piece")).select("key", "piece", F.lit(1).alias("_kind"), "_nth")
    disputed = claims.filter(~F.col("held")).select("key", "piece", F.lit(0).alias("_kind"), F.col("piece").alias("_nth"))
    top = lambda rows: rows.withColumn("_k", F.row_number().over(Window.partitionBy("key").orderBy("_kind", "_nth", "piece"))).filter(F.col("_k") <= most)
    once = top(disputed).drop("_k").unionByName(spread).groupBy("key", "piece").agg(F.min(F.struct("_kind", "_nth")).alias("o")).select("key", "piece", "o.*")
    return expected.join(top(once).select("key", "piece"), ["key", "piece"])


def sample_verified(wanted: DataFrame, read: DataFrame) -> DataFrame:
    """(key, checked, passed) of sampled pieces (key, piece, length, sha1) against what was read of them (key, piece, data); pieces that are cut short aren't checked."""
    both = wanted.join(read, ["key", "piece"], "left")
    whole = F.coalesce(F.octet_length("data") >= F.col("length"), F.lit(False))
    return both.groupBy("key").agg(F.count_if(whole).alias("checked"), F.count_if(whole & (F.sha1("data") == F.col("sha1"))).alias("passed"))


def read_pieces(wanted: DataFrame, piece: int) -> DataFrame:
    """(key, piece, data) of wanted (key, path, piece, length): only those ranges of the files are read, where the task runs; a file that can't be opened gives none."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for path, n, length in zip(*(batch.column(k).to_pylist() for k in (1, 2, 3)), strict=True):
                try:
                    with open(path, "rb") as f:
                        f.seek(n * piece)
                        out.append(f.read(length))
                except OSError:
                    out.append(None)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array(out, pa.binary())], names=["key", "piece", "data"])

    kinds = dict(wanted.dtypes)
    rows = wanted.select("key", "path", "piece", "length").repartition("path").sortWithinPartitions("path", "piece")
    return rows.mapInArrow(run, f"key {kinds['key']}, piece {kinds['piece']}, data binary")


def piece_buckets(availability: DataFrame, buckets: int) -> DataFrame:
    """(archive, piece, copies) reduced to a number of buckets by all, any and min; copies above 255 count as 255. Every bucket holds a piece at least, so few pieces serve several buckets."""
    n = availability.groupBy("archive").agg(F.max("piece").alias("_last")).withColumn("_n", F.col("_last") + 1)
    spans = n.select("archive", "_n", F.explode(F.sequence(F.lit(0), F.lit(buckets - 1))).alias("bucket")).select(
        "archive", "bucket", F.floor(F.col("bucket") * F.col("_n") / buckets).cast("long").alias("_a"),
        F.greatest(F.floor(F.col("bucket") * F.col("_n") / buckets) + 1, F.floor((F.col("bucket") + 1) * F.col("_n") / buckets)).cast("long").alias("_b"),
    )
    at = spans.withColumn("piece", F.explode(F.sequence(F.col("_a"), F.col("_b") - 1)))
    rows = at.join(availability, ["archive", "piece"], "left").withColumn("copies", F.coalesce("copies", F.lit(0)))
    return rows.groupBy("archive", "bucket").agg(F.bool_and(F.col("copies") > 0).alias("all_held"), F.bool_or(F.col("copies") > 0).alias("any_held"), F.least(F.lit(255), F.min("copies")).cast("long").alias("least"))


def distributed_copies(availability: DataFrame) -> DataFrame:
    """Whole copies that peers hold together: the rarest piece's count, plus the share of pieces above it."""
    least = availability.groupBy("archive").agg(F.min("copies").alias("_min"))
    return availability.join(least, "archive").groupBy("archive").agg((F.first("_min") + F.avg((F.col("copies") > F.col("_min")).cast("int"))).alias("copies"))
