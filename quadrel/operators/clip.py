"""Polygons against tiles: rings as segments of world fractions, joined to tiles by a grid."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import tiles as T


#: Sources of a recipe, and shapes that they name: what may be broadcast whole.
FEW = 4096


def few(rows: DataFrame, what: str, most: int = FEW) -> DataFrame:
    """rows as ones that are broadcast, after a look at how many they are."""
    if rows.limit(most + 1).count() > most:
        raise ValueError(f"{what}: more than {most}")
    return F.broadcast(rows)


def segments(points: DataFrame) -> DataFrame:
    """(shape, ring, i, lon, lat) ring points as segments; rings of fewer than four points are dropped, open rings closed."""
    w = Window.partitionBy("shape", "ring")
    o = w.orderBy("i")
    p = points.withColumns({"_n": F.count(F.lit(1)).over(w), "_last": F.row_number().over(w.orderBy(F.desc("i"))) == 1, "_lon0": F.first("lon").over(o), "_lat0": F.first("lat").over(o)})
    p = p.withColumns({"_lon": F.coalesce(F.lead("lon").over(o), F.col("_lon0")), "_lat": F.coalesce(F.lead("lat").over(o), F.col("_lat0"))})
    closed = ~((F.col("lon") == F.col("_lon")) & (F.col("lat") == F.col("_lat")))
    return p.filter((F.col("_n") >= 4) & closed).select("shape", "ring", F.col("i").alias("seg"), T.world_x(F.col("lon")).alias("ax"), T.world_y(F.col("lat")).alias("ay"), T.world_x(F.col("_lon")).alias("bx"), T.world_y(F.col("_lat")).alias("by"))


def crosses_ray(x: Column, y: Column) -> Column:
    """Whether a segment crosses the ray from a point to the east."""
    ay, by = F.col("ay"), F.col("by")
    return ((ay > y) != (by > y)) & (x < (F.col("bx") - F.col("ax")) * (y - ay) / F.when(by != ay, by - ay) + F.col("ax"))


def bands_for(segs: DataFrame, most: int = 1 << 14, rows: int = 8) -> int:
    """Into how many bands of rows to cut the world so that a band holds about `rows` segments: as many as the segments' own heights allow, 16 at least."""
    tall = segs.agg(F.count(F.lit(1)).alias("n"), F.sum(F.abs(F.col("by") - F.col("ay"))).alias("height")).first()
    return 1 << max(4, min(most, int(tall.n / max(rows * 1.0, 1e-9)) + 1, int(tall.n / max(tall.height or 0.0, 1e-9)) + 1).bit_length() - 1)


def odd_crossings(points: DataFrame, segs: DataFrame, keys: list[str], bins: int | None = None) -> DataFrame:
    """Even-odd test: (keys, shape) of the points (keys, px, py) inside each shape. Points and segments meet in bands of rows; a band holds every segment that can cross its rays, so parity is whole."""
    bins = bins or bands_for(segs)
    band = lambda y: F.floor(y * bins)
    s = segs.withColumn("_band", F.explode(F.sequence(band(F.least("ay", "by")), band(F.greatest("ay", "by")))))
    hit = points.withColumn("_band", band(F.col("py"))).join(s, "_band").filter(crosses_ray(F.col("px"), F.col("py")))
    return hit.groupBy(*keys, "shape").agg((F.count(F.lit(1)) % 2 == 1).alias("_odd")).filter("_odd").drop("_odd")


def of_all_shapes(rows: DataFrame, states: DataFrame, segs: DataFrame, keys: list[str], rest: Column) -> DataFrame:
    """rows (keys) for every shape with its state from states (keys, shape, state), `rest` where there is none. Only keys with a state are joined; the shapes' names, a recipe's few, come as one row."""
    names = few(segs.select("shape").distinct(), "shapes").agg(F.array_sort(F.collect_set("shape")).alias("_shapes"))
    own = states.groupBy(*keys).agg(F.map_from_entries(F.collect_list(F.struct("shape", "state"))).alias("_own"))
    each = rows.join(own, keys, "left").crossJoin(F.broadcast(names)).withColumn("shape", F.explode("_shapes"))  # one row on the right
    return each.select(*keys, "shape", F.coalesce(F.try_element_at(F.col("_own"), F.col("shape")), rest).alias("state"))


def contains(points: DataFrame, segs: DataFrame, keys: list[str], bins: int | None = None) -> DataFrame:
    """Points (keys, px, py) with `inside` for each shape."""
    odd = odd_crossings(points, segs, keys, bins).withColumn("state", F.lit(True))
    return of_all_shapes(points.select(*keys), odd, segs, keys, F.lit(False)).withColumnRenamed("state", "inside")


def crossed_tiles(tiles: DataFrame, segs: DataFrame, step: int = 3, top: int = 24) -> DataFrame:
    """(shape, tile_id) where a segment's box meets the tile's box; touching is not meeting.

    Both sides meet in cells of grid levels. A segment's own level has cells no smaller than its box, so it lies in four of them at most, and
    in four at most of every coarser level; a tile lies in one cell of each level up to its own. A tile meets segments as fine as itself or
    finer at its own level, and coarser ones at theirs, so long edges aren't spread over small cells nor short ones over all tiles.
    """
    t = tiles.select("tile_id", "z", "x", "y", (F.floor(F.least(F.col("z"), F.lit(top)) / step) * step).cast("int").alias("_own"), T.tile_box(F.col("z"), F.col("x"), F.col("y")).alias("_b"))
    t = t.withColumn("_level", F.explode(F.sequence(F.lit(0), F.col("_own"), F.lit(step))))
    up = F.call_function("shiftleft", F.lit(1).cast("long"), F.col("z") - F.col("_level"))
    t = t.select("tile_id", "_level", F.floor(F.col("x") / up).alias("_cx"), F.floor(F.col("y") / up).alias("_cy"), (F.col("_level") == F.col("_own")).alias("_mine"), "_b.*")
    s = segs.select("shape", F.least("ax", "bx").alias("sx0"), F.greatest("ax", "bx").alias("sx1"), F.least("ay", "by").alias("sy0"), F.greatest("ay", "by").alias("sy1"))
    wide = F.greatest(F.col("sx1") - F.col("sx0"), F.col("sy1") - F.col("sy0"), F.lit(2.0**-top))
    s = s.withColumn("_fits", (F.floor(F.greatest(F.lit(0.0), F.floor(-F.log2(wide))) / step) * step).cast("int")).withColumn("_level", F.explode(F.sequence(F.lit(0), F.col("_fits"), F.lit(step))))
    n = F.call_function("shiftleft", F.lit(1).cast("long"), F.col("_level"))
    cells = lambda a, b: F.explode(F.sequence(*(F.greatest(F.lit(0).cast("long"), F.least(n - 1, F.floor(F.col(v) * n))) for v in (a, b))))
    s = s.withColumn("_cx", cells("sx0", "sx1")).withColumn("_cy", cells("sy0", "sy1"))
    meets = (F.col("sx1") > F.col("min_x")) & (F.col("sx0") < F.col("max_x")) & (F.col("sy1") > F.col("min_y")) & (F.col("sy0") < F.col("max_y"))
    return t.join(s, ["_level", "_cx", "_cy"]).filter((F.col("_mine") | (F.col("_level") == F.col("_fits"))) & meets).select("shape", "tile_id").distinct()


def classify(tiles: DataFrame, segs: DataFrame) -> DataFrame:
    """inside, outside or partial for each tile and shape: partial where an edge meets the tile, else as its centre."""
    t = tiles.select("tile_id", "z", "x", "y")
    n = F.pow(F.lit(2.0), F.col("z").cast("double"))
    centres = t.select("tile_id", ((F.col("x") + 0.5) / n).alias("px"), ((F.col("y") + 0.5) / n).alias("py"))
    states = odd_crossings(centres, segs, ["tile_id"]).withColumn("state", F.lit(1)).unionByName(crossed_tiles(t, segs).withColumn("state", F.lit(2)))
    states = states.groupBy("tile_id", "shape").agg(F.max("state").alias("state"))
    placed = of_all_shapes(t.select("tile_id"), states, segs, ["tile_id"], F.lit(0))
    return placed.select("tile_id", "shape", F.when(F.col("state") == 2, "partial").when(F.col("state") == 1, "inside").otherwise("outside").alias("place"))


def masks(tiles: DataFrame, segs: DataFrame, size: int) -> DataFrame:
    """A coverage mask of size x size at pixel centres for each tile and shape: 1 inside, 0 outside, in rows. Scanlines: a row's crossings are sorted once, and a pixel is inside if an odd number lies to its right; parity is over all of the row's segments. Rows without crossings are never made."""
    n = F.pow(F.lit(2.0), F.col("z").cast("double"))
    rows = tiles.select("tile_id", "z", "x", "y").withColumn("row", F.explode(F.sequence(F.lit(0), F.lit(size - 1)))).withColumn("py", (F.col("y") + (F.col("row") + 0.5) / size) / n)
    bins = bands_for(segs)
    s = segs.withColumn("_band", F.explode(F.sequence(F.floor(F.least("ay", "by") * bins), F.floor(F.greatest("ay", "by") * bins))))
    at = F.col("ax") + (F.col("bx") - F.col("ax")) * (F.col("py") - F.col("ay")) / F.when(F.col("by") != F.col("ay"), F.col("by") - F.col("ay"))
    hit = rows.withColumn("_band", F.floor(F.col("py") * bins)).join(s, "_band").filter((F.col("ay") > F.col("py")) != (F.col("by") > F.col("py")))
    crossings = hit.groupBy("tile_id", "shape", "row").agg(F.first("x").alias("x"), F.first("z").alias("z"), F.array_sort(F.collect_list(at)).alias("c"))  # as many as the shape has edges on a row
    px = lambda i: (F.col("x") + (i + 0.5) / size) / n
    line = F.transform(F.sequence(F.lit(0), F.lit(size - 1)), lambda i: F.when(F.size(F.filter("c", lambda v: v > px(i))) % 2 == 1, 1).otherwise(0))
    lines = crossings.select("tile_id", "shape", "row", line.alias("line")).groupBy("tile_id", "shape").agg(F.map_from_entries(F.collect_list(F.struct("row", "line"))).alias("state"))
    clear = F.array_repeat(F.lit(0), size)
    full = of_all_shapes(tiles.select("tile_id"), lines, segs, ["tile_id"], F.create_map().cast("map<int,array<int>>"))
    return full.select("tile_id", "shape", F.flatten(F.transform(F.sequence(F.lit(0), F.lit(size - 1)), lambda r: F.coalesce(F.try_element_at(F.col("state"), r), clear))).alias("mask"))


def clip_choice(sources: DataFrame, places: DataFrame) -> DataFrame:
    """How each source's tiles are clipped: by its cutline if it names one that exists, inside where it names none, outside where the shape is missing. sources: (source_idx, cutline), places: (tile_id, shape, place)."""
    known = places.select("shape").distinct().withColumn("_known", F.lit(True))
    s = sources.join(known, F.col("cutline") == F.col("shape"), "left").drop("shape")
    tiles = places.select("tile_id").distinct()
    joined = tiles.crossJoin(few(s, "sources of a recipe")).join(places.withColumnRenamed("shape", "cutline"), ["tile_id", "cutline"], "left")
    return joined.select("tile_id", "source_idx", F.when(F.col("cutline").isNull(), "inside").otherwise(F.coalesce("place", F.lit("outside"))).alias("place"))
