"""Bandwidth samples: (info_hash, at in seconds, down, up) rows at a fixed interval."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.rules import in_schedule, limit, round_half_up


def clean_samples(samples: DataFrame) -> DataFrame:
    """Rates as whole numbers from 0."""
    rate = lambda c: F.greatest(F.lit(0), round_half_up(F.coalesce(F.col(c), F.lit(0)))).cast("long").alias(c)
    return samples.select("info_hash", F.col("at").cast("long").alias("at"), rate("down"), rate("up"))


def _bucket(seconds: int) -> Column:
    return (F.col("at") - F.pmod("at", F.lit(seconds))).alias("bucket")


def _means() -> list[Column]:
    return [round_half_up(F.avg(c)).cast("long").alias(c) for c in ("down", "up")]


def series(samples: DataFrame, seconds: int, archive=None) -> DataFrame:
    """Mean rates for each bucket (multiples of its width): of one archive, or of the sums over all archives at each instant."""
    if archive is not None:
        samples = samples.filter(F.col("info_hash") == archive)
    else:
        samples = samples.groupBy("at").agg(F.sum("down").alias("down"), F.sum("up").alias("up"))
    return samples.groupBy(_bucket(seconds)).agg(*_means())


def totals(samples: DataFrame, interval: int = 15, since: int | None = None) -> DataFrame:
    """Bytes that each archive moved, and its number of samples."""
    if since is not None:
        samples = samples.filter(F.col("at") >= since)
    return samples.groupBy("info_hash").agg(*((F.sum(c) * interval).alias(f"{c}_bytes") for c in ("down", "up")), F.count(F.lit(1)).alias("samples"))


def retained(samples: DataFrame, keep_hours: int, now: Column) -> DataFrame:
    """History without samples older than keep_hours."""
    return samples.filter(F.col("at") >= now - keep_hours * 3600)


def limit_in_force(at: Column, override: Column, scheduled: Column, usual: Column, days: tuple[str, ...], start: int, stop: int) -> Column:
    """An override holds before the schedule's limit, which holds before the usual one."""
    return limit(F.coalesce(override, F.when(in_schedule(at, days, start, stop), scheduled), usual))
