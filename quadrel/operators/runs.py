"""Coverage as runs of tile ids: (tile_id, run_length) entries, never a row a tile.

Runs are cut at cells of 2 ** bits ids, all work is done within cells, and what touches across cells is joined after. A cell
holds as many rows as there are ends of runs in it, whatever the runs' lengths; only runs that reach a cell's edge, two a cell, meet in one window.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.tiles import first_id, zoom_of

BITS = 20


def cut(entries: DataFrame, bits: int = BITS) -> DataFrame:
    """entries as pieces [first, stop) within cells; other columns pass."""
    last = F.col("tile_id") + F.col("run_length") - 1
    rest = [c for c in entries.columns if c not in ("tile_id", "run_length")]
    cells = entries.filter("run_length > 0").select(*rest, "tile_id", last.alias("_last"), F.explode(F.sequence(F.shiftright("tile_id", bits), F.shiftright(last, bits))).alias("_cell"))
    edge = F.call_function("shiftleft", F.col("_cell").cast("long"), F.lit(bits))
    return cells.select(*rest, "_cell", F.greatest(F.col("tile_id"), edge).alias("first"), F.least(F.col("_last") + 1, edge + (1 << bits)).alias("stop"))


def _islands(pieces: DataFrame, keys: list[str], within: list[str]) -> DataFrame:
    """Pieces (keys, first, stop) that touch or overlap as one, within partitions by keys and `within`."""
    w = Window.partitionBy(*keys, *within).orderBy("first", "stop")
    reach = F.max("stop").over(w.rowsBetween(Window.unboundedPreceding, -1))
    opened = pieces.withColumn("_opens", (reach.isNull() | (F.col("first") > reach)).cast("int"))
    return opened.withColumn("_n", F.sum("_opens").over(w)).groupBy(*keys, *within, "_n").agg(F.min("first").alias("first"), F.max("stop").alias("stop")).drop("_n")


def joined(pieces: DataFrame, keys: list[str], bits: int = BITS) -> DataFrame:
    """Disjoint pieces (keys, _cell, first, stop) as runs: those that reach an edge of their cell are joined across cells, the rest are runs as they are."""
    size = 1 << bits
    edge = (F.pmod("first", F.lit(size)) == 0) | (F.pmod("stop", F.lit(size)) == 0)
    whole = _islands(pieces.filter(edge).select(*keys, "first", "stop"), keys, [])
    return pieces.filter(~edge).select(*keys, "first", "stop").unionByName(whole).select(*keys, F.col("first").alias("tile_id"), (F.col("stop") - F.col("first")).alias("run_length"))


def union_runs(entries: DataFrame, keys: list[str] | None = None, bits: int = BITS) -> DataFrame:
    """The tiles that any entry has, as runs; with keys for each of their values."""
    keys = keys or []
    return joined(_islands(cut(entries.select(*keys, "tile_id", "run_length"), bits), keys, ["_cell"]), keys, bits)


def _swept(pieces: DataFrame) -> DataFrame:
    """pieces (_cell, first, stop, one: boolean) as elementary pieces (_cell, first, stop, ones, others): how many of each kind hold it."""
    ends = pieces.select("_cell", F.explode(F.array(F.struct(F.col("first").alias("at"), F.lit(1).alias("d")), F.struct(F.col("stop").alias("at"), F.lit(-1).alias("d")))).alias("e"), "one")
    points = ends.groupBy("_cell", F.col("e.at").alias("first")).agg(*(F.sum(F.when(c, F.col("e.d")).otherwise(0)).alias(n) for n, c in (("_a", F.col("one")), ("_b", ~F.col("one")))))
    w = Window.partitionBy("_cell").orderBy("first")
    return points.select("_cell", "first", F.lead("first").over(w).alias("stop"), F.sum("_a").over(w).alias("ones"), F.sum("_b").over(w).alias("others")).filter("stop is not null and (ones > 0 or others > 0)")


def overlap_runs(entries: DataFrame, one, two, bits: int = BITS) -> DataFrame:
    """(tile_id, run_length, held_by): runs of tiles that one archive (source_idx) has and the other has too, or lacks."""
    kinds = entries.filter(F.col("source_idx").isin(one, two)).select((F.col("source_idx") == one).alias("one"), "tile_id", "run_length")
    pieces = _swept(cut(kinds, bits)).filter("ones > 0").select("_cell", F.when(F.col("others") > 0, "both").otherwise("first").alias("held_by"), "first", "stop")
    return joined(_islands(pieces, ["held_by"], ["_cell"]), ["held_by"], bits)


def by_zoom(entries: DataFrame) -> DataFrame:
    """entries cut at the first ids of zooms, with z."""
    stop = F.col("tile_id") + F.col("run_length")
    z = entries.withColumn("z", F.explode(F.sequence(zoom_of(F.col("tile_id")), zoom_of(stop - 1))))
    low, high = F.greatest(F.col("tile_id"), first_id(F.col("z"))), F.least(stop, first_id(F.col("z") + 1))
    rest = [c for c in entries.columns if c not in ("tile_id", "run_length")]
    return z.select(*rest, F.col("z").cast("int").alias("z"), low.alias("tile_id"), (high - low).alias("run_length"))


def warm_runs(wanted: DataFrame, covered: DataFrame, bits: int = BITS) -> DataFrame:
    """Hits and misses by zoom of wanted runs against covered ones. Each wanted tile counts once."""
    kinds = wanted.select(F.lit(True).alias("one"), "tile_id", "run_length").unionByName(covered.select(F.lit(False).alias("one"), "tile_id", "run_length"))
    held = _swept(cut(kinds, bits)).filter("ones > 0").select(F.col("first").alias("tile_id"), (F.col("stop") - F.col("first")).alias("run_length"), (F.col("others") > 0).alias("hit"))
    n: Column = F.col("run_length")
    return by_zoom(held).groupBy("z").agg(F.sum(n).alias("total"), F.sum(F.when(F.col("hit"), n).otherwise(0)).alias("hits"), F.sum(F.when(F.col("hit"), 0).otherwise(n)).alias("misses"))
