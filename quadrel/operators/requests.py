"""Statistics of tile requests: (info_hash, z, status, bytes, ms, ip, at, seq) rows, one for each request."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.rules import client_key


def archive_totals(requests: DataFrame) -> DataFrame:
    """Requests, bytes, first and last time, and the first known name of each archive."""
    return requests.groupBy("info_hash").agg(
        F.count(F.lit(1)).alias("requests"), F.sum("bytes").alias("bytes"), F.min("at").alias("first_seen"), F.max("at").alias("last_seen"), F.min_by("name", F.when(F.col("name").isNotNull(), F.col("seq"))).alias("name")
    )


def by_zoom(requests: DataFrame) -> DataFrame:
    return requests.groupBy("info_hash", "z").agg(F.count(F.lit(1)).alias("requests"))


def by_status(requests: DataFrame) -> DataFrame:
    return requests.groupBy("info_hash", "status").agg(F.count(F.lit(1)).alias("requests"))


def counters(counts: DataFrame, key: str) -> DataFrame:
    """Counts as one map for each archive."""
    return counts.groupBy("info_hash").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct(key, "requests")))).alias(f"by_{key}"))


def by_client(requests: DataFrame) -> DataFrame:
    return requests.groupBy(client_key(F.col("ip")).alias("client")).agg(F.count(F.lit(1)).alias("requests"), F.sum("bytes").alias("bytes"))


def recent_percentiles(requests: DataFrame, fractions: dict[str, float], last: int = 512) -> DataFrame:
    """Nearest-rank percentiles of the latest finite durations of each archive: the value at rank ceil(fraction * n)."""
    finite = requests.filter(F.col("ms").isNotNull() & ~F.isnan("ms") & (F.abs("ms") < float("inf")))
    recent = finite.withColumn("_n", F.row_number().over(Window.partitionBy("info_hash").orderBy(F.desc("at"), F.desc("seq")))).filter(F.col("_n") <= last)
    return recent.groupBy("info_hash").agg(F.count(F.lit(1)).alias("samples"), *(F.expr(f"percentile_disc({f}) WITHIN GROUP (ORDER BY ms)").alias(k) for k, f in fractions.items()))


def node_totals(requests: DataFrame) -> DataFrame:
    """Totals of each archive and, with info_hash null and archive false, of the node."""
    return requests.rollup("info_hash").agg(F.count(F.lit(1)).alias("requests"), F.sum("bytes").alias("bytes"), (F.grouping("info_hash") == 0).alias("archive"))


def recent(requests: DataFrame, n: int = 200) -> DataFrame:
    """The latest requests, newest first; the limit is the feature."""
    return requests.orderBy(F.desc("at"), F.desc("seq")).limit(n)


#: Cells that a doubling of a value is cut into, to find ranks without sorting a side in one task.
CELLS = 256


def _cell() -> Column:
    return F.floor(F.log2(F.abs("ms") + 1) * CELLS * F.signum("ms")).cast("long")


def value_counts(requests: DataFrame, side: str) -> DataFrame:
    """(side, ms, n, before, total, cell, next): each value of a side with how often it occurs, how many values are smaller, and the next larger one. Sums run within cells of values, then over a side's cells (some thousands), so no task sorts a side."""
    values = requests.filter("ms is not null").groupBy(side, "ms").agg(F.count(F.lit(1)).alias("n")).withColumn("cell", _cell())
    cells = values.groupBy(side, "cell").agg(F.sum("n").alias("_n"), F.min("ms").alias("_low"))
    w = Window.partitionBy(side).orderBy("cell")
    cells = cells.select(side, "cell", (F.sum("_n").over(w) - F.col("_n")).alias("_before"), F.sum("_n").over(Window.partitionBy(side)).alias("total"), F.lead("_low").over(w).alias("_next"))
    own = Window.partitionBy(side, "cell").orderBy("ms")
    placed = values.withColumns({"_own": F.sum("n").over(own) - F.col("n"), "_after": F.lead("ms").over(own)}).join(cells, [side, "cell"])
    return placed.select(side, "ms", "n", (F.col("_before") + F.col("_own")).alias("before"), "total", "cell", F.coalesce("_after", "_next").alias("next"))


def at_index(value: str, index: Column) -> Column:
    """An aggregate over value_counts(): the value at an index of the side's sorted values."""
    return F.max(F.when((F.col("before") <= index) & (index < F.col("before") + F.col("n")), F.col(value)))


def rank_index(n: Column, fraction: float) -> Column:
    """The other percentile rule: index min(n - 1, floor(n * fraction)) of n sorted values."""
    return F.least(n - 1, F.floor(n * F.lit(fraction)))


def latency_summary(requests: DataFrame, side: str) -> DataFrame:
    """Percentiles by the index rule, worst value, errors and bytes of each side."""
    ranks = value_counts(requests, side).groupBy(side).agg(*(at_index("ms", rank_index(F.col("total"), f)).alias(k) for k, f in (("p50", 0.5), ("p90", 0.9), ("p99", 0.99))))
    rest = requests.groupBy(side).agg(F.count(F.lit(1)).alias("requests"), F.max("ms").alias("worst"), F.count_if(F.col("status") >= 400).alias("errors"), F.sum("bytes").alias("bytes"))
    return rest.join(ranks, side, "left").select(side, "requests", "p50", "p90", "p99", "worst", "errors", "bytes")


def latency_report(results: DataFrame, side: str) -> DataFrame:
    """results (side, ok, status, total, ttfb, bytes, encoding, backend): of each side how many were served, statuses of all, and of those served the bytes, encodings, backends, and percentiles of the time to the first byte and to the last."""
    served = results.filter("ok")
    of = results.groupBy(side).agg(F.count(F.lit(1)).alias("of"), F.count_if("ok").alias("served"), F.sum(F.when(F.col("ok"), F.col("bytes"))).alias("bytes"), F.max(F.when(F.col("ok"), F.col("total"))).alias("total_max"))

    def counted(rows: DataFrame, name: str, alias: str) -> DataFrame:
        """"name=count" of each value in order; values are few."""
        n = rows.filter(F.col(name).isNotNull()).groupBy(side, name).agg(F.count(F.lit(1)).alias("n"))
        return n.groupBy(side).agg(F.array_join(F.array_sort(F.collect_list(F.concat_ws("=", F.col(name).cast("string"), F.col("n").cast("string")))), ",").alias(alias))

    out = of
    for name in ("ttfb", "total"):
        v = value_counts(served.select(side, F.col(name).alias("ms")), side)
        out = out.join(v.groupBy(side).agg(*(at_index("ms", rank_index(F.col("total"), f)).alias(f"{name}_{k}") for k, f in (("p50", 0.5), ("p90", 0.9), ("p99", 0.99)))), side, "left")
    for rows, name, alias in ((results, "status", "statuses"), (served, "encoding", "encodings"), (served, "backend", "backends")):
        out = out.join(counted(rows, name, alias), side, "left")
    return out


def histogram(requests: DataFrame, side: str, bins: int = 8) -> DataFrame:
    """Counts in equal bins up to each side's maximum; empty bins are absent."""
    top = requests.groupBy(side).agg(F.max("ms").alias("_top"))
    bin_ = F.when(F.col("_top") <= 0, F.lit(0)).otherwise(F.least(F.lit(bins - 1), F.floor(F.col("ms") / (F.col("_top") / bins)))).cast("long").alias("bin")
    return requests.join(top, side).groupBy(side, bin_).agg(F.count(F.lit(1)).alias("requests"))


def side_ratio(summary: DataFrame, side: str, one, two) -> DataFrame:
    """Second side over first, for each figure."""
    a, b = (summary.filter(F.col(side) == s) for s in (one, two))
    figures = ("p50", "p90", "p99")
    return a.select(*(F.col(c).alias(f"a_{c}") for c in figures)).crossJoin(b.select(*(F.col(c).alias(f"b_{c}") for c in figures))).select(  # one row on either side
        *(F.when(F.col(f"a_{c}") != 0, F.col(f"b_{c}") / F.col(f"a_{c}")).alias(f"{c}_ratio") for c in figures)
    )


def two_modes(requests: DataFrame, side: str, least: int = 20, share: float = 0.25, ratio: float = 1.8, spreads: float = 3.0) -> DataFrame:
    """Where each side's durations split, and whether that makes two populations.

    The split is the widest gap between neighbours of the middle (from index floor(0.1 n) up to ceil(0.9 n)). There are two if the smaller half holds
    `share` of the values, the upper median is `ratio` times the lower, and the gap is `spreads` times the lower half's spread (10th to 90th percentile, 1 at least).
    """
    v = value_counts(requests, side)
    index = F.col("before") + F.col("n") - 1  # of a value's last occurrence
    gap = F.col("next") - F.col("ms")
    inner = (index >= F.floor(F.col("total") * 0.1)) & (index < F.ceil(F.col("total") * 0.9) - 1) & (gap > 0)
    at = v.filter(inner).groupBy(side).agg(F.max_by(F.struct(F.col("ms").alias("low"), F.col("next").alias("high"), (index + 1).alias("below")), F.struct(gap, -index)).alias("g"))
    halves = v.join(at, side)  # a row for each side on the right
    below, above = F.col("g.below"), F.col("total") - F.col("g.below")
    stats = halves.groupBy(side).agg(
        F.first("g.low").alias("low_end"), F.first("g.high").alias("high_start"), F.first(below).cast("long").alias("below"), F.first(above).cast("long").alias("above"), F.first("total").alias("_n"),
        at_index("ms", rank_index(below, 0.5)).alias("fast_median"), at_index("ms", below + rank_index(above, 0.5)).alias("slow_median"),
        (at_index("ms", rank_index(below, 0.9)) - at_index("ms", rank_index(below, 0.1))).alias("_spread"),
    )
    split = (F.col("_n") >= least) & (F.least("below", "above") / F.col("_n") >= share) & (F.col("slow_median") >= F.col("fast_median") * ratio) & (F.col("high_start") - F.col("low_end") >= F.greatest(F.lit(1.0), F.col("_spread")) * spreads)
    return stats.select(side, "low_end", "high_start", "below", "above", "fast_median", "slow_median", split.alias("split"))
