"""Covers of boxes and shapes as runs of Hilbert ids.

A quadtree cell at a zoom is one run of the ids of every deeper zoom, so what a box or a shape holds is a few runs, found by descending from
cells that an edge meets; cells wholly inside or outside are never opened. Tiles meet a cover by their ids alone, in one range join.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import tiles as T
from ..sources.tables import stored
from . import clip, runs

#: Boxes that a task descends at once.
TOGETHER = 64
#: Edges, in tiles, of rectangles that a task unites at once.
EDGES = 1 << 18


def _long(c: Column) -> Column:
    return c.cast("long")


def curve(level: int, x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Place of cells of one level on the Hilbert curve, from the highest bit down."""
    x, y, d = x.copy(), y.copy(), np.zeros(len(x), np.int64)
    for k in range(level - 1, -1, -1):
        s = 1 << k
        rx, ry = (x >> k) & 1, (y >> k) & 1
        d += s * s * ((3 * rx) ^ ry)
        x, y = x & (s - 1), y & (s - 1)
        turn, flip = ry == 0, (ry == 0) & (rx == 1)
        x, y = np.where(flip, s - 1 - x, x), np.where(flip, s - 1 - y, y)
        x, y = np.where(turn, y, x), np.where(turn, x, y)
    return d


def rectangle_runs(z: int, x0: np.ndarray, x1: np.ndarray, y0: np.ndarray, y1: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(rectangle, first place, number) of the runs of each rectangle of tiles at a zoom, in order."""
    of, x, y = np.arange(len(x0)), np.zeros(len(x0), np.int64), np.zeros(len(x0), np.int64)
    found = []
    for level in range(z + 1):
        k = z - level
        left, right, top, bottom = x << k, ((x + 1) << k) - 1, y << k, ((y + 1) << k) - 1
        meets = (left <= x1[of]) & (right >= x0[of]) & (top <= y1[of]) & (bottom >= y0[of])
        whole = meets & (left >= x0[of]) & (right <= x1[of]) & (top >= y0[of]) & (bottom <= y1[of])
        at = curve(level, x[whole], y[whole])
        found.append((of[whole], at << (2 * k), np.full(len(at), 1 << (2 * k), np.int64)))
        part = meets & ~whole
        of, x, y = np.repeat(of[part], 4), (2 * x[part][:, None] + [0, 1, 0, 1]).ravel(), (2 * y[part][:, None] + [0, 0, 1, 1]).ravel()
    of, first, n = (np.concatenate(c) for c in zip(*found, strict=True))
    order = np.lexsort((first, of))
    of, first, n = of[order], first[order], n[order]
    if not len(of):
        return of, first, n
    starts = np.flatnonzero(np.concatenate([[True], (of[1:] != of[:-1]) | (first[1:] != first[:-1] + n[:-1])]))
    return of[starts], first[starts], np.add.reduceat(n, starts)


def box_runs(boxes: DataFrame, low: int, high: int) -> DataFrame:
    """(the boxes' other columns, z, tile_id, run_length): each box (west, south, east, north) over a range of zooms as runs of ids, about as many as its edges are long in tiles."""
    keys = [c for c in boxes.columns if c not in ("west", "south", "east", "north")]
    z = boxes.select("*", F.explode(F.sequence(F.lit(low), F.lit(high))).alias("z"))
    r = z.select(*keys, "z", T.box_range(F.col("west"), F.col("south"), F.col("east"), F.col("north"), F.col("z")).alias("r")).filter("r.x0 <= r.x1 and r.y0 <= r.y1").select(*keys, "z", *(_long(F.col(f"r.{c}")).alias(f"_{c}") for c in ("x0", "x1", "y0", "y1")))
    n = len(keys)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            zooms = batch.column(n).to_numpy()
            sides = [batch.column(n + 1 + i).to_numpy() for i in range(4)]
            for zoom in np.unique(zooms).tolist():
                rows = np.flatnonzero(zooms == zoom)
                for at in range(0, len(rows), TOGETHER):
                    part = rows[at : at + TOGETHER]
                    of, first, count = rectangle_runs(zoom, *(s[part] for s in sides))
                    own = batch.take(pa.array(part[of]))
                    yield pa.RecordBatch.from_arrays([*own.columns[: n + 1], pa.array(first + (4**zoom - 1) // 3), pa.array(count)], names=[*keys, "z", "tile_id", "run_length"])

    kinds = dict(boxes.dtypes)
    return r.mapInArrow(run, ", ".join([*(f"`{k}` {kinds[k]}" for k in keys), "z int, tile_id long, run_length long"]))


def united_rectangles(z: int, x0: np.ndarray, x1: np.ndarray, y0: np.ndarray, y1: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(first place, number) of the runs of tiles that any of the rectangles at a zoom has, in order.

    All descend at once: a cell that one of them fills is closed for the others, and rectangles that are alike within a cell go on as one.
    """
    x, y = np.zeros(len(x0), np.int64), np.zeros(len(x0), np.int64)
    found = []
    for level in range(z + 1):
        k = z - level
        x0, x1, y0, y1 = np.maximum(x0, x << k), np.minimum(x1, ((x + 1) << k) - 1), np.maximum(y0, y << k), np.minimum(y1, ((y + 1) << k) - 1)
        meets = (x0 <= x1) & (y0 <= y1)
        x, y, x0, x1, y0, y1 = (c[meets] for c in (x, y, x0, x1, y0, y1))
        at = curve(level, x, y)
        full = np.unique(at[(x1 - x0 + 1 == 1 << k) & (y1 - y0 + 1 == 1 << k)])
        found.append((full << (2 * k), np.full(len(full), 1 << (2 * k), np.int64)))
        part = np.flatnonzero(~np.isin(at, full))
        if 4 * z - 2 * level < 63:  # a cell and four sides within it in one number
            name = at[part]
            for side, edge in ((x0, x), (x1, x), (y0, y), (y1, y)):
                name = (name << k) | (side[part] - (edge[part] << k))
            part = part[np.unique(name, return_index=True)[1]]
        x, y = (2 * x[part][:, None] + [0, 1, 0, 1]).ravel(), (2 * y[part][:, None] + [0, 0, 1, 1]).ravel()
        x0, x1, y0, y1 = (np.repeat(c[part], 4) for c in (x0, x1, y0, y1))
    first, n = (np.concatenate(c) for c in zip(*found, strict=True))
    order = np.argsort(first)
    first, n = first[order], n[order]
    if not len(first):
        return first, n
    starts = np.flatnonzero(np.concatenate([[True], first[1:] != first[:-1] + n[:-1]]))
    return first[starts], np.add.reduceat(n, starts)


def boxes_union(boxes: DataFrame, low: int, high: int) -> DataFrame:
    """(tile_id, run_length): the tiles that any box (west, south, east, north) has over a range of zooms, as runs of ids.

    Columns and rows of a zoom are those of the deepest one, shifted; so boxes of the same tiles are taken once, and each task unites its rectangles before they meet those of others.
    """
    sides = ["x0", "x1", "y0", "y1"]
    deepest = boxes.select(T.box_range(F.col("west"), F.col("south"), F.col("east"), F.col("north"), F.lit(high)).alias("r")).select("r.*").distinct()
    z = deepest.select("*", F.explode(F.sequence(F.lit(low), F.lit(high))).alias("z"))
    r = z.select("z", *(F.call_function("shiftright", F.col(c), F.lit(high) - F.col("z")).alias(c) for c in sides)).filter("x0 <= x1 and y0 <= y1")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            zooms, *cut = (c.to_numpy() for c in batch.columns)
            for zoom in np.unique(zooms).tolist():
                x0, x1, y0, y1 = (c[zooms == zoom] for c in cut)
                group = np.cumsum(x1 - x0 + y1 - y0 + 2) // EDGES
                for part in np.split(np.arange(len(x0)), np.flatnonzero(np.diff(group)) + 1):
                    first, count = united_rectangles(zoom, x0[part], x1[part], y0[part], y1[part])
                    yield pa.RecordBatch.from_arrays([pa.array(first + (4**zoom - 1) // 3), pa.array(count)], names=["tile_id", "run_length"])

    longest = r.mapInArrow(run, "tile_id long, run_length long").groupBy("tile_id").agg(F.max("run_length").alias("run_length"))
    return runs.union_runs(longest)


def depth_for(segs: DataFrame, cells: int, deepest: int = 16) -> int:
    """The deepest level at which the boxes of all segments meet no more than about so many cells."""
    wide, tall = F.abs(F.col("bx") - F.col("ax")), F.abs(F.col("by") - F.col("ay"))
    n = segs.agg(*(F.sum((wide * 2**k + 2) * (tall * 2**k + 2)).alias(f"n{k}") for k in range(deepest + 1))).first()
    return max([k for k in range(deepest + 1) if (n[k] or 0) <= cells], default=0)


def met_cells(segs: DataFrame, level: int) -> DataFrame:
    """(shape, x, y, and the box sx0 ... sy1 of the segment): cells of a level that the box of a segment meets; touching is not meeting."""
    n = 1 << level
    s = segs.select("shape", F.least("ax", "bx").alias("sx0"), F.greatest("ax", "bx").alias("sx1"), F.least("ay", "by").alias("sy0"), F.greatest("ay", "by").alias("sy1"))
    reach = lambda a, b: F.filter(F.sequence(F.greatest(F.lit(0).cast("long"), F.floor(F.col(a) * n)), F.greatest(F.floor(F.col(a) * n), F.least(F.lit(n - 1).cast("long"), F.ceil(F.col(b) * n) - 1), F.lit(0).cast("long"))), lambda i: (F.col(b) > i / n) & (F.col(a) < (i + 1) / n) & (i < n))
    return s.withColumn("x", F.explode(reach("sx0", "sx1"))).withColumn("y", F.explode(reach("sy0", "sy1")))


def shape_runs(segs: DataFrame, level: int) -> DataFrame:
    """(shape, place, tile_id: place on the curve of the level, run_length): inside, outside and partial runs that fill the world for each shape."""
    leaf = met_cells(segs, level).select("shape", "x", "y").distinct()
    up = leaf.select("shape", "x", "y", F.explode(F.sequence(F.lit(0), F.lit(level))).alias("k"))
    shift = lambda c: F.call_function("shiftright", _long(F.col(c)), F.lit(level) - F.col("k"))
    split = up.select("shape", "k", shift("x").alias("x"), shift("y").alias("y")).distinct()
    below = F.explode(F.array(*(F.struct((2 * F.col("x") + i).alias("x"), (2 * F.col("y") + j).alias("y")) for i in (0, 1) for j in (0, 1))))
    children = split.filter(F.col("k") < level).select("shape", (F.col("k") + 1).alias("k"), below.alias("c")).select("shape", "k", "c.x", "c.y")
    ends = children.join(split, ["shape", "k", "x", "y"], "left_anti")
    side = F.pow(F.lit(2.0), F.col("k"))
    centres = ends.select(F.col("shape").alias("of"), "k", "x", "y", ((F.col("x") + 0.5) / side).alias("px"), ((F.col("y") + 0.5) / side).alias("py"))
    inside = clip.odd_crossings(centres, segs, ["of", "k", "x", "y"]).filter("of = shape").select("shape", "k", "x", "y", F.lit("inside").alias("place"))
    whole = ends.join(inside, ["shape", "k", "x", "y"], "left").withColumn("place", F.coalesce("place", F.lit("outside")))
    cells = whole.unionByName(leaf.select("shape", F.lit(level).alias("k"), "x", "y", F.lit("partial").alias("place")))
    size = F.call_function("shiftleft", F.lit(1).cast("long"), (2 * (level - F.col("k"))).cast("int"))
    at = (T.tile_id(F.col("k"), F.col("x"), F.col("y")) - T.first_id(F.col("k"))) * size
    return runs.union_runs(cells.select("shape", "place", at.alias("tile_id"), size.alias("run_length")), ["shape", "place"])


def classify(tiles: DataFrame, segs: DataFrame, cells: int = 1 << 18) -> DataFrame:
    """inside, outside or partial for each tile (tile_id, z) and shape, as clip.classify() gives them.

    A tile finds the run that its first descendant at the cover's level lies in (or, deeper than that, its ancestor), by shifting its id. It is as the run
    if the run holds all of it. Only tiles deeper than the cover in a partial cell are tested, against the segments of that cell.
    """
    level = depth_for(segs, cells)
    bits = max(0, 2 * level - 12)
    t = tiles.select("tile_id", _long(F.col("tile_id") - T.first_id(F.col("z"))).alias("h"), F.col("z").cast("int").alias("z"))
    down = F.call_function("shiftleft", F.col("h"), 2 * F.greatest(F.lit(0), F.lit(level) - F.col("z")))
    first = F.call_function("shiftright", down, 2 * F.greatest(F.lit(0), F.col("z") - F.lit(level)))
    wide = F.call_function("shiftleft", F.lit(1).cast("long"), 2 * F.greatest(F.lit(0), F.lit(level) - F.col("z")))
    t = t.select("tile_id", "z", first.alias("_at"), (first + wide).alias("_end")).withColumn("_cell", F.shiftright("_at", bits))
    cover = stored(shape_runs(segs, level), "cover").withColumn("_stop", F.col("tile_id") + F.col("run_length"))
    pieces = runs.cut(cover, bits).select("shape", "place", "_cell", "first", "stop", "_stop")
    met = t.join(pieces, "_cell").filter((F.col("_at") >= F.col("first")) & (F.col("_at") < F.col("stop")))
    place = F.when((F.col("place") == "partial") & (F.col("z") > level), "open").when((F.col("place") == "partial") | (F.col("_end") > F.col("_stop")), "partial").otherwise(F.col("place"))
    placed = stored(met.select("tile_id", "z", "shape", "_at", place.alias("place")), "placed")
    open_ = T.with_places(placed.filter("place = 'open'").select("tile_id", "shape", F.col("_at").alias("_leaf"))).select("tile_id", "shape", "_leaf", "z", "x", "y")
    boxes = open_.withColumn("b", T.tile_box(F.col("z"), F.col("x"), F.col("y")))
    leaf_at = T.tile_id(F.lit(level), F.col("x"), F.col("y")) - T.first_id(F.lit(level))
    near = met_cells(segs, level).select("shape", leaf_at.alias("_leaf"), "sx0", "sx1", "sy0", "sy1")
    meets = (F.col("sx1") > F.col("b.min_x")) & (F.col("sx0") < F.col("b.max_x")) & (F.col("sy1") > F.col("b.min_y")) & (F.col("sy0") < F.col("b.max_y"))
    crossed = boxes.join(near, ["shape", "_leaf"]).filter(meets).select("tile_id", "shape").distinct().withColumn("place", F.lit("partial"))
    n = F.pow(F.lit(2.0), F.col("z").cast("double"))
    rest = open_.join(crossed, ["tile_id", "shape"], "left_anti").select("tile_id", F.col("shape").alias("of"), ((F.col("x") + 0.5) / n).alias("px"), ((F.col("y") + 0.5) / n).alias("py"))
    odd = clip.odd_crossings(rest, segs, ["tile_id", "of"]).filter("of = shape").select("tile_id", "shape", F.lit("inside").alias("place"))
    other = rest.select("tile_id", F.col("of").alias("shape")).join(odd, ["tile_id", "shape"], "left").select("tile_id", "shape", F.coalesce("place", F.lit("outside")).alias("place"))
    return placed.filter("place <> 'open'").select("tile_id", "shape", "place").unionByName(crossed).unionByName(other)
