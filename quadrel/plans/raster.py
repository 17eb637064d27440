"""Queries on height and colour grids and on shapes, with their SQL."""

from __future__ import annotations

import re

from pyspark.sql import functions as F

from ..functions import tiles as T
from ..operators import clip as C
from ..operators import cover as V
from ..operators import raster as R
from ..operators import stack as ST
from ..operators import tiles as O
from .fixtures import archive_tiles, height_tiles, rgba_tiles, with_views

#: Heights that the mask queries take out, in thousandths as the mask compares them.
MASK = [round(-5 + 0.001 * k, 3) for k in range(150)]
#: Outer ring and hole of the query's shape, in degrees.
SHAPE = {"island": [[(-100.0, -40.0), (60.0, -55.0), (120.0, 30.0), (10.0, 62.0), (-130.0, 45.0)], [(-20.0, -10.0), (30.0, -10.0), (30.0, 20.0), (-20.0, 20.0)]]}


def _exploded(df, name="h", *more):
    """One row for each pixel, rounded."""
    return df.select("tile_id", *more, F.posexplode("px").alias("i", name)).withColumn(name, F.round(name, 6))


def elevation_encode(s, d):
    h = height_tiles(s, d)
    e = h.select("tile_id", "source_idx", R.encode(F.col("px"), R.factors("mapbox")).alias("e")).select("tile_id", "source_idx", "e.*")
    back = e.withColumn("px", R.decode(F.col("r"), F.col("g"), F.col("b"), R.factors("mapbox")))
    return back.select("tile_id", "source_idx", F.posexplode(F.arrays_zip("r", "g", "b", "px")).alias("i", "p")).select("tile_id", "source_idx", "i", "p.r", "p.g", "p.b", F.round("p.px", 3).alias("height"))


#: The encoding of each source of elevation_encodings.
ENCODINGS = (R.factors("terrarium"), R.factors("mapbox", 0.25, -5000.0), R.factors("mapbox", 0.5), R.factors("custom", custom=(131072.0, 512.0, 2.0, 3000.0)))


def elevation_encodings(s, d):
    """A source in each encoding, encoded and decoded."""
    pick = lambda of: F.element_at(F.array(*(of(f) for f in ENCODINGS)), F.col("source_idx") + 1)
    e = height_tiles(s, d).select("tile_id", "source_idx", pick(lambda f: R.encode(F.col("px"), f)).alias("e")).select("tile_id", "source_idx", "e.*")
    back = e.withColumn("px", pick(lambda f: R.decode(F.col("r"), F.col("g"), F.col("b"), f)))
    return back.select("tile_id", "source_idx", F.posexplode(F.arrays_zip("r", "g", "b", "px")).alias("i", "p")).select("tile_id", "source_idx", "i", "p.r", "p.g", "p.b", F.round("p.px", 3).alias("height"))


def elevation_mask_paint(s, d):
    layers = height_tiles(s, d).select("tile_id", "source_idx", R.adjust(R.mask_heights(F.col("px"), MASK), 2.5).alias("px"))
    some = layers.withColumn("px", F.transform("px", lambda h: F.when(h > F.col("source_idx") * 40 - 60, h)))
    return _exploded(R.paint(some).withColumn("px", R.fill(F.col("px"))))


def color_mask(s, d):
    t = rgba_tiles(s, d)
    return _exploded(t.withColumn("px", R.mask_colors(F.transform("r", lambda v: v.cast("double")), F.col("r"), F.col("g"), F.col("b"), ["#000000", "1,2,3", "#0a141e"])), "h", "source_idx")


def elevation_resample(s, d):
    """All grids at twice their size by the cubic kernel."""
    return _exploded(R.resample(height_tiles(s, d), 16, "cubic"), "h", "source_idx")


def elevation_parent(s, d):
    """A square of each grid, one zoom down, by the Lanczos kernel; one in nine of the samples is missing."""
    h = _holes(s, d).withColumns({"levels": F.lit(1), "sub_x": (F.col("tile_id") % 2).cast("int"), "sub_y": F.lit(1)})
    return _exploded(R.resample_parent(h, "lanczos"), "h", "source_idx")


def elevation_blur(s, d):
    """Blurred by a distance of none to two zooms; one in nine of the samples is missing."""
    h = _holes(s, d).withColumn("levels", (F.col("tile_id") % 3).cast("int"))
    return _exploded(R.blur(h, 0.8, distance="levels"), "h", "source_idx")


def _holes(s, d):
    return height_tiles(s, d).withColumn("px", F.transform("px", lambda h, i: F.when((i + F.col("tile_id")) % 9 != 0, h)))


def elevation_resample_all(s, d):
    return _exploded(R.resample(height_tiles(s, d), 16, "bilinear"), "h", "source_idx")


def elevation_parent_all(s, d):
    h = height_tiles(s, d).withColumns({"levels": F.lit(1), "sub_x": (F.col("tile_id") % 2).cast("int"), "sub_y": F.lit(1)})
    return _exploded(R.resample_parent(h, "bilinear"), "h", "source_idx")


def elevation_blur_all(s, d):
    return _exploded(R.blur(height_tiles(s, d), 0.8), "h", "source_idx")


def elevation_stitch(s, d):
    h = height_tiles(s, d).select("tile_id", (F.col("source_idx") % 2).alias("dx"), F.floor(F.col("source_idx") / 2).cast("int").alias("dy"), "px")
    return _exploded(R.assemble(h, 2, 8))


def elevation_merge(s, d):
    layers = height_tiles(s, d).withColumn("adjustment", F.col("source_idx").cast("double"))
    return _exploded(R.merge_elevation(layers, 8, MASK, "nearest"))


def stack_answer(s, d):
    layers = height_tiles(s, d).filter("tile_id % 3 <> 0 or source_idx = 0").withColumn("adjustment", F.col("source_idx").cast("double"))
    return _exploded(ST.answer(layers, F.col("source_idx") > 0, 8, MASK, "nearest"), "h", "copied")


def _layers(s, d):
    mode = F.element_at(F.array(*(F.lit(m) for m in ("normal", "multiply", "overlay", "screen"))), F.col("source_idx") + 1)
    t = rgba_tiles(s, d)
    ch = [R.to_channels(F.col(c)).alias(c) for c in "rgba"]
    return t.select("tile_id", "source_idx", *ch, F.when(F.col("source_idx") == 0, 1.0).otherwise(0.75).alias("opacity"), mode.alias("blend"))


def rgba_composite(s, d):
    c = R.composite(_layers(s, d))
    return c.select("tile_id", F.posexplode(F.arrays_zip("r", "g", "b", "a")).alias("i", "p")).select("tile_id", "i", *(F.round(f"p.{c}", 6).alias(c) for c in "rgba"))


BLENDS = ("normal", "multiply", "screen", "darken", "lighten", "overlay")


def rgba_blends(s, d):
    """Each layer above the first by one of the six modes in turn, so that each mode meets each place in the order."""
    k = F.when(F.col("source_idx") == 0, F.lit(0)).otherwise(F.pmod(F.col("tile_id") + F.col("source_idx"), F.lit(6)).cast("int"))
    c = R.composite(_layers(s, d).withColumn("blend", F.element_at(F.array(*(F.lit(m) for m in BLENDS)), k + 1)))
    return c.select("tile_id", F.posexplode(F.arrays_zip("r", "g", "b", "a")).alias("i", "p")).select("tile_id", "i", *(F.round(f"p.{c}", 6).alias(c) for c in "rgba"))


def rgba_bytes(s, d):
    t = _layers(s, d).withColumn("a", R.mask_layer(F.col("r"), F.col("g"), F.col("b"), F.col("a"), ["#000000"]))
    return t.select("tile_id", "source_idx", F.posexplode(F.arrays_zip(R.to_bytes(F.col("r")).alias("r"), R.to_bytes(F.col("a")).alias("a"))).alias("i", "p")).select("tile_id", "source_idx", "i", "p.r", "p.a")


def rgba_resample(s, d):
    """A square of each layer, one zoom down."""
    square = _layers(s, d).select("tile_id", "source_idx", "r", "g", "b", "a", F.lit(1).alias("levels"), (F.col("tile_id") % 2).cast("int").alias("sub_x"), F.lit(1).alias("sub_y"))
    c = R.resample_layer(square, 8, square=True)
    return c.select("tile_id", "source_idx", F.posexplode(F.arrays_zip("r", "a")).alias("i", "p")).select("tile_id", "source_idx", "i", F.round("p.r", 6).alias("r"), F.round("p.a", 6).alias("a"))


def rgba_resample_all(s, d):
    c = R.resample_layer(_layers(s, d).select("tile_id", "source_idx", "r", "g", "b", "a"), 4)
    return c.select("tile_id", "source_idx", F.posexplode(F.arrays_zip("r", "a")).alias("i", "p")).select("tile_id", "source_idx", "i", F.round("p.r", 6).alias("r"), F.round("p.a", 6).alias("a"))


def _stack(s, d, grids, space, **more):
    """A recipe of four sources over all tiles: the second clipped by the island, the third by a shape that is missing, the fourth always altered. Each source lacks a third of the tiles, which its ancestors then answer."""
    tiles = grids.select("tile_id").distinct()
    held = O.with_zxy(grids.filter((F.col("tile_id") + F.col("source_idx")) % 3 != 0).select("source_idx", "tile_id"))
    mode = ("normal", "multiply", "overlay", "screen")
    recipe = s.createDataFrame([(k, c, k == 3, float(k), 1.0 if k == 0 else 0.75, mode[k]) for k, c in enumerate((None, "island", "atlantis", None))], "source_idx int, cutline string, changes boolean, adjustment double, opacity double, blend string")
    return ST.stack_answer(O.with_zxy(tiles), held, grids, recipe, 8, space, shape_segments(s), kernel="nearest", **more)


def elevation_full(s, d):
    return _exploded(_stack(s, d, height_tiles(s, d), "elevation", values=MASK), "h", "copied")


#: Bounds of the second source of stack_blurred, in degrees.
BOX = {"west": -100.0, "south": -50.0, "east": 95.0, "north": 70.0}


def _whole_metres(s, d):
    return height_tiles(s, d).withColumn("px", F.transform("px", lambda h: F.round(h)))


def stack_blurred(s, d):
    """Each source has masks of its own, the second is clipped by its bounds, the first is required; squares of parents are weighed and blurred by their distance; some tiles can't be read."""
    grids = _whole_metres(s, d)
    broken = (F.col("tile_id") * 7 + F.col("source_idx")) % 11 == 0
    held = O.with_zxy(grids.filter((F.col("tile_id") + F.col("source_idx")) % 3 != 0).select("source_idx", "tile_id", broken.alias("broken")))
    rows = [(k, None, BOX if k == 1 else None, k == 0, [float(v) for v in range(40 * k, 40 * k + 40 if k < 3 else 0)], float(k)) for k in range(4)]
    recipe = s.createDataFrame(rows, "source_idx int, cutline string, bounds struct<west:double,south:double,east:double,north:double>, required boolean, values array<double>, adjustment double")
    out = ST.stack_answer(O.with_zxy(grids.select("tile_id").distinct()), held, grids, recipe, 8, "elevation", kernel="bilinear", sigma=0.6)
    return out.select("tile_id", F.posexplode("px").alias("i", "h")).withColumn("h", F.round("h", 5))


def _sized(s, d):
    """Sources of half the width that is asked for; the first lacks some tiles and so some whole sets of children."""
    grids = _whole_metres(s, d)
    width = F.sqrt(F.size("px")).cast("int")
    held = O.with_zxy(grids.filter((F.col("source_idx") < 2) & ((F.col("source_idx") == 1) | (F.col("tile_id") % 5 != 1))).select("source_idx", "tile_id", width.alias("width")))
    recipe = s.createDataFrame([(k, None, float(k) / 4) for k in range(2)], "source_idx int, cutline string, adjustment double")
    return O.with_zxy(grids.select("tile_id").distinct()), held, grids, recipe


def stack_answer_children(s, d):
    wanted, held, grids, recipe = _sized(s, d)
    only = held.filter((F.col("source_idx") == 0) | (F.col("tile_id") % 2 == 0))  # where the second has none, the first shows
    out = ST.stack_answer(wanted, only, grids, recipe, 16, "elevation", kernel="nearest", sized=True, most=0)
    return out.select("tile_id", F.posexplode("px").alias("i", "h"))


def stack_contributors(s, d):
    wanted, held, _, recipe = _sized(s, d)
    reads, _ = ST.stack_reads(wanted, held, recipe, sized=True)
    return ST.contributors(reads, ST.child_reads(reads, wanted, held, 16))


def stack_failures(s, d):
    """Required sources whose tiles, or whose ancestors that would answer, can't be read."""
    grids = height_tiles(s, d)
    held = O.with_zxy(grids.filter("(tile_id + source_idx) % 3 <> 0").select("source_idx", "tile_id", ((F.col("tile_id") * 7 + F.col("source_idx")) % 11 == 0).alias("broken")))
    recipe = s.createDataFrame([(k, None, k % 2 == 0) for k in range(4)], "source_idx int, cutline string, required boolean")
    reads, _ = ST.stack_reads(O.with_zxy(grids.select("tile_id").distinct()), held, recipe)
    return ST.failures(reads)


def stack_answer_rgba(s, d):
    grids = rgba_tiles(s, d).select("tile_id", "source_idx", *(R.to_channels(F.col(c)).alias(c) for c in "rgba"))
    out = _stack(s, d, grids, "rgba", colors=["#000000"])
    return out.select("tile_id", "copied", F.posexplode(F.arrays_zip("r", "g", "b", "a")).alias("i", "p")).select("tile_id", "copied", "i", *(F.round(f"p.{c}", 6).alias(c) for c in "rgba"))


def shape_segments(s):
    points = [(n, k, i, x, y) for n, rings in SHAPE.items() for k, ring in enumerate(rings) for i, (x, y) in enumerate(ring)]
    return C.segments(s.createDataFrame(points, "shape string, ring int, i int, lon double, lat double"))


def _tiles(s, d):
    return O.with_zxy(O.coverage_union(archive_tiles(s, d)))


def clip_classify(s, d):
    return C.classify(_tiles(s, d), shape_segments(s)).select("tile_id", "place")


def clip_classify_cover(s, d):
    """The same by a cover of runs, shallow enough that many tiles lie deeper."""
    ids = O.coverage_union(archive_tiles(s, d))
    return V.classify(ids.select("tile_id", T.zoom_of(F.col("tile_id")).alias("z")), shape_segments(s), 1 << 10).select("tile_id", "place")


def clip_mask(s, d):
    return clip_mask_all(s, d)


def clip_sources(s, d):
    return clip_sources_all(s, d)


def clip_mask_all(s, d):
    m = C.masks(_tiles(s, d), shape_segments(s), 8)
    return m.select("tile_id", F.posexplode("mask").alias("i", "inside"))


def clip_sources_all(s, d):
    src = s.createDataFrame([(0, None), (1, "island"), (2, "atlantis")], "source_idx int, cutline string")
    return C.clip_choice(src, C.classify(_tiles(s, d), shape_segments(s)))


def tile_boxes(s, d):
    t = _tiles(s, d)
    b = t.select("tile_id", T.tile_box(F.col("z"), F.col("x"), F.col("y")).alias("b"), T.parent(F.col("z"), F.col("x"), F.col("y"), F.least(F.lit(2), F.col("z"))).alias("p"))
    return b.select("tile_id", *(F.round(F.col(f"b.{c}"), 6).alias(c) for c in ("min_x", "min_y")), F.col("p.x").alias("px"), F.col("p.dy").alias("dy"))


QUERIES = (elevation_encode, elevation_encodings, rgba_blends, elevation_mask_paint, color_mask, elevation_resample, elevation_parent, elevation_blur, elevation_stitch, elevation_merge, stack_answer, elevation_full, stack_blurred, stack_answer_children, stack_contributors, stack_failures, stack_answer_rgba, rgba_composite, rgba_bytes, rgba_resample, clip_classify, clip_classify_cover, clip_mask, clip_sources, clip_mask_all, clip_sources_all, elevation_resample_all, elevation_parent_all, elevation_blur_all, rgba_resample_all, tile_boxes)

H = with_views("heights")
_M = "floor(h * 1000 + 0.5) BETWEEN -5000 AND -4851"
_RGBA = """px AS (SELECT vec_id // 4 AS tile_id, CAST(vec_id % 4 AS INT) AS source_idx, CAST(i AS INT) AS i, least(255, CAST(floor(abs(embedding[i + 1]::DOUBLE) * 500) AS INT)) AS r, least(255, CAST(floor(abs(embedding[(i + 16) % 64 + 1]::DOUBLE) * 500) AS INT)) AS g,
  least(255, CAST(floor(abs(embedding[(i + 32) % 64 + 1]::DOUBLE) * 500) AS INT)) AS b, CAST(floor(label * 255 / 9) AS INT) AS a FROM embeddings, range(64) q(i))"""
_RESAMPLED = lambda source, size, origin, extent: f"""{H}, g AS (SELECT tile_id, i % 8 AS x, i // 8 AS y, h FROM heights WHERE {source}),
ax AS (SELECT o, k, greatest(0, least(7, CAST(floor(p) AS INT) + k)) AS s, 1 - abs(p - floor(p) - k) AS w FROM (SELECT o, {origin} + (o + 0.5) * {extent} / {size} - 0.5 AS p FROM range({size}) q(o)), range(2) r(k)),
wx AS (SELECT o, s, sum(w) AS w FROM ax GROUP BY 1, 2)"""  # noqa: E731
_TILES = with_views("archive_tiles", "zoomed").replace("WITH", "WITH RECURSIVE", 1)


def _segments_sql(shapes: dict | None = None) -> str:
    from .tiles import _WX, _WY

    rows = [f"('{n}', {x1}, {y1}, {x2}, {y2})" for n, rings in (shapes or SHAPE).items() for ring in rings for (x1, y1), (x2, y2) in zip(ring, ring[1:] + ring[:1], strict=True)]
    return f"lonlat(shape, x1, y1, x2, y2) AS (VALUES {', '.join(rows)}), segs AS (SELECT shape, {_WX('x1')} AS ax, {_WY('y1')} AS ay, {_WX('x2')} AS bx, {_WY('y2')} AS \"by\" FROM lonlat)"


def _clip_sql(shapes: dict | None = None) -> str:
    from .tiles import _ZXY

    return f"""{_TILES}, {_ZXY}, {_segments_sql(shapes)}, c AS (SELECT *, (x + 0.5) / pow(2, z) AS cx, (y + 0.5) / pow(2, z) AS cy FROM places),
hit AS (SELECT tile_id, sum(CASE WHEN (ay > cy) <> (s."by" > cy) AND cx < (bx - ax) * (cy - ay) / CASE WHEN s."by" <> ay THEN s."by" - ay END + ax THEN 1 ELSE 0 END) % 2 = 1 AS inside,
  bool_or(greatest(ax, bx) > x / pow(2, z) AND least(ax, bx) < (x + 1) / pow(2, z) AND greatest(ay, s."by") > y / pow(2, z) AND least(ay, s."by") < (y + 1) / pow(2, z)) AS crossed FROM c, segs s GROUP BY tile_id),
cls AS (SELECT tile_id, z, CASE WHEN crossed THEN 'partial' WHEN inside THEN 'inside' ELSE 'outside' END AS place FROM hit JOIN places USING (tile_id))"""


def oracle() -> dict[str, str]:
    from .tiles import _ZXY

    out = {
        "elevation_encodings": _encodings_sql(),
        "rgba_blends": _blends_sql(),
        "elevation_encode": f"{H}, u AS (SELECT *, CAST(greatest(0, least(16777215, floor((h + 10000.0) / 0.1 + 0.5))) AS BIGINT) AS u FROM heights) SELECT tile_id, source_idx, CAST(i AS INT) AS i, CAST(u >> 16 AS INT) AS r, CAST((u >> 8) & 255 AS INT) AS g, CAST(u & 255 AS INT) AS b, round((u >> 16) * 6553.6 + ((u >> 8) & 255) * 25.6 + (u & 255) * 0.1 - 10000.0, 3) AS height FROM u",
        "elevation_mask_paint": f"""{H}, m AS (SELECT tile_id, source_idx, i, CASE WHEN NOT ({_M}) AND h + 2.5 > source_idx * 40 - 60 THEN h + 2.5 END AS h FROM heights),
p AS (SELECT tile_id, i, arg_max(h, source_idx) FILTER (WHERE h IS NOT NULL) AS h FROM m GROUP BY 1, 2) SELECT tile_id, CAST(i AS INT) AS i, round(coalesce(h, -10000.0), 6) AS h FROM p WHERE tile_id IN (SELECT tile_id FROM p WHERE h IS NOT NULL)""",
        "color_mask": f"WITH {_RGBA} SELECT tile_id, source_idx, i, CASE WHEN NOT ((r, g, b) IN ((0, 0, 0), (1, 2, 3), (10, 20, 30))) THEN CAST(r AS DOUBLE) END AS h FROM px",
        "elevation_resample": f"{_RESAMPLED('source_idx = 0', 16, 0, 8)} SELECT tile_id, CAST(y.o * 16 + x.o AS INT) AS i, round(sum(y.w * x.w * h) / sum(y.w * x.w), 6) AS h FROM g JOIN wx x ON x.s = g.x JOIN wx y ON y.s = g.y GROUP BY 1, 2",
        "elevation_parent": f"""{_RESAMPLED('source_idx = 1', 8, 0, 4)}, ay AS (SELECT o, sx, greatest(0, least(7, CAST(floor(p) AS INT) + k)) AS s, 1 - abs(p - floor(p) - k) AS w FROM (SELECT o, sx, sx * 4 + (o + 0.5) * 4 / 8 - 0.5 AS p FROM range(8) q(o), range(2) t(sx)), range(2) r(k)), wy AS (SELECT o, sx, s, sum(w) AS w FROM ay GROUP BY 1, 2, 3)
SELECT tile_id, CAST(y.o * 8 + x.o AS INT) AS i, round(sum(y.w * x.w * h) / sum(y.w * x.w), 6) AS h FROM g JOIN wy x ON x.s = g.x AND x.sx = tile_id % 2 JOIN wy y ON y.s = g.y AND y.sx = 1 GROUP BY 1, 2""",
        "elevation_blur": f"""{H}, g AS (SELECT tile_id, i % 8 AS x, i // 8 AS y, h FROM heights WHERE source_idx = 2), wx AS (SELECT o, greatest(0, least(7, o + k)) AS s, sum(exp(-(k * k) / (2 * 0.8 * 0.8))) AS w FROM range(8) q(o), range(-3, 4) r(k) GROUP BY 1, 2)
SELECT tile_id, CAST(y.o * 8 + x.o AS INT) AS i, round(sum(y.w * x.w * h) / sum(y.w * x.w), 6) AS h FROM g JOIN wx x ON x.s = g.x JOIN wx y ON y.s = g.y GROUP BY 1, 2""",
        "elevation_stitch": f"{H} SELECT tile_id, CAST((source_idx // 2 * 8 + i // 8) * 16 + source_idx % 2 * 8 + i % 8 AS INT) AS i, round(h, 6) AS h FROM heights WHERE tile_id IN (SELECT tile_id FROM heights GROUP BY tile_id HAVING count(DISTINCT source_idx) = 4)",
        "elevation_merge": f"{H}, m AS (SELECT tile_id, i, arg_max(h + source_idx, source_idx) FILTER (WHERE NOT ({_M})) AS h FROM heights GROUP BY 1, 2) SELECT tile_id, CAST(i AS INT) AS i, round(h, 6) AS h FROM m WHERE tile_id IN (SELECT tile_id FROM m WHERE h IS NOT NULL)",
        "stack_answer": f"""{H}, l AS (SELECT * FROM heights WHERE tile_id % 3 <> 0 OR source_idx = 0), c AS (SELECT tile_id, count(DISTINCT source_idx) = 1 AND max(source_idx) = 0 AS copied FROM l GROUP BY 1),
m AS (SELECT tile_id, copied, i, CASE WHEN copied THEN max(h) ELSE arg_max(h + source_idx, source_idx) FILTER (WHERE NOT ({_M})) END AS h FROM l JOIN c USING (tile_id) GROUP BY 1, 2, 3) SELECT tile_id, copied, CAST(i AS INT) AS i, round(h, 6) AS h FROM m WHERE tile_id IN (SELECT tile_id FROM m WHERE h IS NOT NULL)""",
        "rgba_composite": _composite_sql(),
        "rgba_bytes": f"WITH {_RGBA} SELECT tile_id, source_idx, i, r, CASE WHEN r = 0 AND g = 0 AND b = 0 THEN 0 ELSE a END AS a FROM px",
        "rgba_resample": f"""WITH {_RGBA}, ax AS (SELECT o, greatest(0, least(7, CAST(floor(p) AS INT) + k)) AS s, 1 - abs(p - floor(p) - k) AS w FROM (SELECT o, (o + 0.5) * 2 - 0.5 AS p FROM range(4) q(o)), range(2) t(k)), wx AS (SELECT o, s, sum(w) AS w FROM ax GROUP BY 1, 2),
g AS (SELECT tile_id, i % 8 AS x, i // 8 AS y, r / 255.0::DOUBLE AS r, a / 255.0::DOUBLE AS a FROM px WHERE source_idx = 3)
SELECT tile_id, CAST(y.o * 4 + x.o AS INT) AS i, CASE WHEN sum(y.w * x.w * a) > 1e-6 THEN round(sum(y.w * x.w * r * a) / sum(y.w * x.w * a), 6) ELSE 0.0 END AS r, round(sum(y.w * x.w * a) / sum(y.w * x.w), 6) AS a FROM g JOIN wx x ON x.s = g.x JOIN wx y ON y.s = g.y GROUP BY 1, 2""",
        "clip_classify": f"{_clip_sql()} SELECT tile_id, place FROM cls",
        "clip_classify_cover": f"{_clip_sql()} SELECT tile_id, place FROM cls",
        "clip_mask": f"""{_TILES}, {_ZXY}, {_segments_sql()}, p AS (SELECT tile_id, CAST(i AS INT) AS i, (x + (i % 8 + 0.5) / 8) / pow(2, z) AS cx, (y + (i // 8 + 0.5) / 8) / pow(2, z) AS cy FROM places, range(64) q(i))
SELECT tile_id, i, CAST(sum(CASE WHEN (ay > cy) <> (s."by" > cy) AND cx < (bx - ax) * (cy - ay) / CASE WHEN s."by" <> ay THEN s."by" - ay END + ax THEN 1 ELSE 0 END) % 2 AS INT) AS inside FROM p, segs s GROUP BY 1, 2""",
        "clip_sources": f"{_clip_sql()} SELECT tile_id, CAST(k AS INT) AS source_idx, CASE k WHEN 0 THEN 'inside' WHEN 1 THEN place ELSE 'outside' END AS place FROM cls, range(3) q(k) WHERE z <= 3",
        "tile_boxes": f"{_TILES}, {_ZXY} SELECT tile_id, round(x / pow(2, z), 6) AS min_x, round(y / pow(2, z), 6) AS min_y, x >> least(2, z) AS px, y % (1 << least(2, z)) AS dy FROM places",
    }
    out |= _full_sql() | _read_sql()
    # The same over all tiles.
    out["clip_mask_all"] = out["clip_mask"]
    out["clip_sources_all"] = out["clip_sources"].replace(" WHERE z <= 3", "")
    # The same over all sources.
    for name in ("elevation_resample", "elevation_parent", "elevation_blur", "rgba_resample"):
        sql = re.sub(r" WHERE source_idx = \d", "", out[name])
        sql = sql.replace("g AS (SELECT tile_id,", "g AS (SELECT tile_id, source_idx,").replace("GROUP BY 1, 2", "GROUP BY 1, 2, 3")
        out[name + "_all"] = re.sub(r"SELECT tile_id, CAST\(y\.o", "SELECT tile_id, source_idx, CAST(y.o", sql).replace("FROM ax GROUP BY 1, 2, 3", "FROM ax GROUP BY 1, 2").replace("r(k) GROUP BY 1, 2, 3)", "r(k) GROUP BY 1, 2)")
    out["clip_sources"] = out["clip_sources_all"]
    return out | _kernel_sql()


def _kernel_sql() -> dict[str, str]:
    """Resampling by kernels that reach several samples, blurring in two passes, and squares of layers."""
    holes = f"{H}, g AS (SELECT tile_id, source_idx, i % 8 AS x, i // 8 AS y, h FROM heights WHERE (i + tile_id) % 9 <> 0)"
    cubic = "CASE WHEN t <= 1 THEN 1.5 * t * t * t - 2.5 * t * t + 1 WHEN t < 2 THEN -0.5 * t * t * t + 2.5 * t * t - 4 * t + 2 ELSE 0 END"
    lanczos = "CASE WHEN t < 1e-9 THEN 1 WHEN t < 3 THEN 3 * sin(pi() * t) * sin(pi() * t / 3) / (pi() * pi() * t * t) ELSE 0 END"
    axis = lambda at, size, reach, kernel, subs=1: f"""w AS (SELECT sub, o, s, sum({kernel}) AS w FROM (SELECT sub, o, greatest(0, least(7, CAST(floor(p) AS INT) + k)) AS s, abs(p - floor(p) - k) AS t
  FROM (SELECT sub, o, {at} AS p FROM range({subs}) b(sub), range({size}) q(o)), range({1 - reach}, {reach + 1}) r(k)) GROUP BY 1, 2, 3)"""  # noqa: E731
    whole = "CASE WHEN abs(sum(y.w * x.w)) > 1e-9 THEN round(sum(y.w * x.w * h) / sum(y.w * x.w), 6) END"
    every = lambda side: f"SELECT e.tile_id, e.source_idx, CAST(q.i AS INT) AS i, m.h FROM (SELECT DISTINCT tile_id, source_idx FROM heights) e CROSS JOIN range({side * side}) q(i) LEFT JOIN m ON m.tile_id = e.tile_id AND m.source_idx = e.source_idx AND m.i = q.i"
    return {
        "elevation_resample": f"{H}, g AS (SELECT tile_id, source_idx, i % 8 AS x, i // 8 AS y, h FROM heights), {axis('(o + 0.5) / 2 - 0.5', 16, 2, cubic)} SELECT tile_id, source_idx, CAST(y.o * 16 + x.o AS INT) AS i, {whole} AS h FROM g JOIN w x ON x.s = g.x JOIN w y ON y.s = g.y GROUP BY tile_id, source_idx, x.o, y.o",
        "elevation_parent": f"{holes}, {axis('sub * 4 + (o + 0.5) / 2 - 0.5', 8, 3, lanczos, 2)}, m AS (SELECT tile_id, source_idx, y.o * 8 + x.o AS i, {whole} AS h FROM g JOIN w x ON x.s = g.x AND x.sub = tile_id % 2 JOIN w y ON y.s = g.y AND y.sub = 1 GROUP BY tile_id, source_idx, x.o, y.o) {every(8)}",
        "elevation_blur": f"""{holes}, bw AS (SELECT l, o, s, sum(w) AS w FROM (SELECT l, o, greatest(0, least(7, o + k)) AS s, exp(-(k * k) / (2 * pow(0.8 * l, 2))) AS w FROM range(1, 3) a(l), range(8) c(o), range(-5, 6) r(k) WHERE abs(k) <= greatest(1, ceil(2.4 * l))) GROUP BY 1, 2, 3),
a AS (SELECT tile_id, source_idx, b.o AS x, y, sum(b.w * h) / sum(b.w) AS h FROM g JOIN bw b ON b.l = tile_id % 3 AND b.s = g.x GROUP BY 1, 2, 3, 4),
m AS (SELECT tile_id, source_idx, b.o * 8 + x AS i, round(sum(b.w * h) / sum(b.w), 6) AS h FROM a JOIN bw b ON b.l = tile_id % 3 AND b.s = a.y GROUP BY 1, 2, 3 UNION ALL SELECT tile_id, source_idx, y * 8 + x, round(h, 6) FROM g WHERE tile_id % 3 = 0) {every(8)}""",
        "rgba_resample": f"""WITH {_RGBA}, {axis('sub * 4 + (o + 0.5) / 2 - 0.5', 8, 1, 'greatest(0, 1 - t)', 2)}, g AS (SELECT tile_id, source_idx, i % 8 AS x, i // 8 AS y, r / 255.0::DOUBLE AS r, a / 255.0::DOUBLE AS a FROM px)
SELECT tile_id, source_idx, CAST(y.o * 8 + x.o AS INT) AS i, CASE WHEN sum(y.w * x.w * a) > 1e-6 THEN round(sum(y.w * x.w * r * a) / sum(y.w * x.w * a), 6) ELSE 0.0 END AS r, round(sum(y.w * x.w * a) / sum(y.w * x.w), 6) AS a
FROM g JOIN w x ON x.s = g.x AND x.sub = tile_id % 2 JOIN w y ON y.s = g.y AND y.sub = 1 GROUP BY tile_id, source_idx, x.o, y.o""",
    }


def _picked_sql() -> str:
    """picked: for each wanted tile, source and pixel the source's tile and pixel that answers, whether it lies inside the source's shape, and whether the tile is copied."""
    from .fixtures import CTE
    from .tiles import _ZXY

    archive = "archive_tiles AS (SELECT CAST(vec_id % 4 AS INT) AS source_idx, vec_id // 4 AS tile_id FROM embeddings)"
    body = _clip_sql().split("hit AS", 1)[1]
    return f"""WITH RECURSIVE {archive}, {CTE["zoomed"]}, {_ZXY}, {_segments_sql()}, c AS (SELECT *, (x + 0.5) / pow(2, z) AS cx, (y + 0.5) / pow(2, z) AS cy FROM places), hit AS{body},
held AS (SELECT a.source_idx, p.* FROM archive_tiles a JOIN places p USING (tile_id) WHERE (a.tile_id + a.source_idx) % 3 <> 0),
up AS (SELECT tile_id, z - l AS z, x >> l AS x, y >> l AS y, l, x % (1 << l) AS sx, y % (1 << l) AS sy FROM places, range(7) r(l) WHERE l <= z),
near AS (SELECT u.tile_id, h.source_idx, min(l) AS l, arg_min(h.tile_id, l) AS from_id, arg_min(sx, l) AS sx, arg_min(sy, l) AS sy FROM up u JOIN held h ON h.z = u.z AND h.x = u.x AND h.y = u.y GROUP BY 1, 2),
own AS (SELECT n.*, CASE n.source_idx WHEN 1 THEN k.place ELSE 'inside' END AS place FROM near n JOIN cls k USING (tile_id) WHERE n.source_idx <> 2 AND NOT (n.source_idx = 1 AND k.place = 'outside')),
cp AS (SELECT tile_id, count(*) = 1 AND NOT bool_or(source_idx = 3 OR l > 0 OR place = 'partial') AS copied FROM own GROUP BY 1),
inm AS (SELECT tile_id, i, sum(CASE WHEN (ay > cy) <> (s."by" > cy) AND cx < (bx - ax) * (cy - ay) / CASE WHEN s."by" <> ay THEN s."by" - ay END + ax THEN 1 ELSE 0 END) % 2 = 1 AS inside
  FROM (SELECT p.tile_id, i, (x + (i % 8 + 0.5) / 8) / pow(2, p.z) AS cx, (y + (i // 8 + 0.5) / 8) / pow(2, p.z) AS cy FROM places p JOIN cls USING (tile_id), range(64) q(i) WHERE cls.place = 'partial'), segs s GROUP BY 1, 2),
picked AS (SELECT o.tile_id, o.source_idx, CAST(q.i AS INT) AS i, copied, from_id, o.place <> 'partial' OR coalesce(inside, false) AS inside,
    CAST(least(7, floor(sy * 8 / pow(2, l) + (q.i // 8 + 0.5) / pow(2, l))) * 8 + least(7, floor(sx * 8 / pow(2, l) + (q.i % 8 + 0.5) / pow(2, l))) AS INT) AS k
  FROM own o JOIN cp USING (tile_id) CROSS JOIN range(64) q(i) LEFT JOIN inm ON inm.tile_id = o.tile_id AND inm.i = q.i)"""


def _reads_sql(shapes: dict | None = None) -> str:
    """held (every source's tiles as stack_blurred has them), near (which of them answers a wanted tile) and the clip's cls."""
    from .fixtures import CTE
    from .tiles import _ZXY

    archive = "archive_tiles AS (SELECT CAST(vec_id % 4 AS INT) AS source_idx, vec_id // 4 AS tile_id FROM embeddings)"
    body = _clip_sql(shapes).split("hit AS", 1)[1]
    return f"""WITH RECURSIVE {archive}, {CTE["zoomed"]}, {_ZXY}, {_segments_sql(shapes)}, c AS (SELECT *, (x + 0.5) / pow(2, z) AS cx, (y + 0.5) / pow(2, z) AS cy FROM places), hit AS{body},
held AS (SELECT a.source_idx, p.*, (a.tile_id * 7 + a.source_idx) % 11 = 0 AS broken FROM archive_tiles a JOIN places p USING (tile_id) WHERE (a.tile_id + a.source_idx) % 3 <> 0),
up AS (SELECT tile_id, z - l AS z, x >> l AS x, y >> l AS y, l, x % (1 << l) AS sx, y % (1 << l) AS sy FROM places, range(7) r(l) WHERE l <= z),
near AS (SELECT u.tile_id, h.source_idx, min(l) AS l, arg_min(h.tile_id, l) AS from_id, arg_min(sx, l) AS sx, arg_min(sy, l) AS sy, arg_min(h.broken, l) AS broken FROM up u JOIN held h ON h.z = u.z AND h.x = u.x AND h.y = u.y GROUP BY 1, 2)"""


def _read_sql() -> dict[str, str]:
    from .fixtures import CTE
    from .tiles import _ZXY

    w, e, b, t = (BOX[k] for k in ("west", "east", "south", "north"))
    reads = _reads_sql({"box": [[(w, t), (e, t), (e, b), (w, b)]]})
    archive = "archive_tiles AS (SELECT CAST(vec_id % 4 AS INT) AS source_idx, vec_id // 4 AS tile_id FROM embeddings)"
    metres = CTE["heights"].replace("heights AS", "metres AS") + ", heights AS (SELECT tile_id, source_idx, i, CASE WHEN h < 0 THEN -floor(-h + 0.5) ELSE floor(h + 0.5) END AS h FROM metres)"
    sized = f"""WITH RECURSIVE {archive}, {CTE["zoomed"]}, {_ZXY}, {metres}, held AS (SELECT a.source_idx, p.* FROM archive_tiles a JOIN places p USING (tile_id) WHERE a.source_idx < 2 AND (a.source_idx = 1 OR a.tile_id % 5 <> 1)),
near AS (SELECT p.tile_id, h.source_idx, min(l) AS l FROM places p, range(7) r(l) JOIN held h ON h.z = p.z - l AND h.x = p.x >> l AND h.y = p.y >> l WHERE l <= p.z GROUP BY 1, 2)"""
    sets = lambda extra: f"""sets AS (SELECT p.tile_id, h.source_idx FROM places p JOIN held h ON h.z = p.z + 1 AND h.x >> 1 = p.x AND h.y >> 1 = p.y {extra} GROUP BY 1, 2 HAVING count(*) = 4)"""
    pick = "(h.source_idx = 0 OR h.tile_id % 2 = 0)"
    return {
        "stack_blurred": f"""{reads}, {metres},
own AS (SELECT n.*, CASE n.source_idx WHEN 1 THEN k.place ELSE 'inside' END AS place FROM near n JOIN cls k USING (tile_id) WHERE n.source_idx <> 1 OR k.place <> 'outside'),
good AS (SELECT * FROM own WHERE NOT broken AND tile_id NOT IN (SELECT tile_id FROM own WHERE broken AND source_idx = 0)),
g AS (SELECT tile_id, source_idx, i % 8 AS x, i // 8 AS y, h + source_idx AS h FROM heights WHERE source_idx = 3 OR NOT h BETWEEN 40 * source_idx AND 40 * source_idx + 39),
cw AS (SELECT l, sub, o, s, sum(w) AS w FROM (SELECT l, sub, o, greatest(0, least(7, CAST(floor(p) AS INT) + k)) AS s, 1 - abs(p - floor(p) - k) AS w
  FROM (SELECT l, sub, o, sub * 8 / pow(2, l) + (o + 0.5) / pow(2, l) - 0.5 AS p FROM range(7) a(l), range(64) b(sub), range(8) c(o) WHERE sub < 1 << l), range(2) r(k)) WHERE w > 0 GROUP BY 1, 2, 3, 4),
bw AS (SELECT l, o, s, sum(w) AS w FROM (SELECT l, o, greatest(0, least(7, o + k)) AS s, exp(-(k * k) / (2 * pow(0.6 * l, 2))) AS w FROM range(1, 7) a(l), range(8) c(o), range(-12, 13) r(k) WHERE abs(k) <= greatest(1, ceil(1.8 * l))) GROUP BY 1, 2, 3),
cut AS (SELECT o.tile_id, o.source_idx, o.l, o.place, x.o AS x, y.o AS y, sum(x.w * y.w * h) / sum(x.w * y.w) AS h FROM good o JOIN g ON g.tile_id = o.from_id AND g.source_idx = o.source_idx
  JOIN cw x ON x.l = o.l AND x.sub = o.sx AND x.s = g.x JOIN cw y ON y.l = o.l AND y.sub = o.sy AND y.s = g.y GROUP BY ALL),
across AS (SELECT tile_id, source_idx, c.l, place, w.o AS x, y, sum(w.w * h) / sum(w.w) AS h FROM cut c JOIN bw w ON w.l = c.l AND w.s = c.x GROUP BY ALL),
down AS (SELECT tile_id, source_idx, place, x, w.o AS y, sum(w.w * h) / sum(w.w) AS h FROM across c JOIN bw w ON w.l = c.l AND w.s = c.y GROUP BY ALL),
soft AS (SELECT tile_id, source_idx, place, y * 8 + x AS i, h FROM (SELECT tile_id, source_idx, place, x, y, h FROM cut WHERE l = 0 UNION ALL SELECT tile_id, source_idx, place, x, y, h FROM down)),
inm AS (SELECT tile_id, i, sum(CASE WHEN (ay > cy) <> (s."by" > cy) AND cx < (bx - ax) * (cy - ay) / CASE WHEN s."by" <> ay THEN s."by" - ay END + ax THEN 1 ELSE 0 END) % 2 = 1 AS inside
  FROM (SELECT p.tile_id, i, (x + (i % 8 + 0.5) / 8) / pow(2, p.z) AS cx, (y + (i // 8 + 0.5) / 8) / pow(2, p.z) AS cy FROM places p JOIN cls USING (tile_id), range(64) q(i) WHERE cls.place = 'partial'), segs s GROUP BY 1, 2),
top AS (SELECT f.tile_id, f.i, arg_max(h, f.source_idx) AS h FROM soft f LEFT JOIN inm ON inm.tile_id = f.tile_id AND inm.i = f.i WHERE f.place <> 'partial' OR inm.inside GROUP BY 1, 2)
SELECT t.tile_id, CAST(q.i AS INT) AS i, round(h, 5) AS h FROM (SELECT DISTINCT tile_id FROM top) t CROSS JOIN range(64) q(i) LEFT JOIN top ON top.tile_id = t.tile_id AND top.i = q.i""",
        "stack_answer_children": f"""{sized}, {sets("WHERE " + pick)},
px AS (SELECT h.tile_id, h.source_idx, u, v, CASE WHEN s.tile_id IS NULL THEN h.tile_id ELSE k.tile_id END AS from_id, CASE WHEN s.tile_id IS NULL THEN v // 2 * 8 + u // 2 ELSE v % 8 * 8 + u % 8 END AS k
  FROM held h CROSS JOIN range(16) a(u) CROSS JOIN range(16) b(v) LEFT JOIN sets s ON s.tile_id = h.tile_id AND s.source_idx = h.source_idx LEFT JOIN held k ON k.source_idx = h.source_idx AND k.z = h.z + 1 AND k.x = h.x * 2 + u // 8 AND k.y = h.y * 2 + v // 8 WHERE {pick})
SELECT p.tile_id, CAST(v * 16 + u AS INT) AS i, arg_max(g.h + p.source_idx / 4, p.source_idx) AS h FROM px p JOIN heights g ON g.tile_id = p.from_id AND g.source_idx = p.source_idx AND g.i = p.k GROUP BY 1, 2""",
        "stack_contributors": f"{sized}, {sets('')} SELECT n.tile_id, n.source_idx, CASE WHEN l > 0 THEN 'up' || l WHEN s.tile_id IS NULL THEN 'own' ELSE 'down1' END AS gave FROM near n LEFT JOIN sets s ON s.tile_id = n.tile_id AND s.source_idx = n.source_idx",
        "stack_failures": f"{_reads_sql()} SELECT tile_id, source_idx FROM near WHERE broken AND source_idx % 2 = 0",
    }


def _full_sql() -> dict[str, str]:
    from .fixtures import CTE

    heights = f"""{_picked_sql()}, {CTE["heights"]}, v AS (SELECT p.*, h.h FROM picked p JOIN heights h ON h.tile_id = p.from_id AND h.source_idx = p.source_idx AND h.i = p.k),
m AS (SELECT tile_id, copied, i, CASE WHEN copied THEN max(h) ELSE arg_max(h + source_idx, source_idx) FILTER (WHERE inside AND NOT ({_M})) END AS h FROM v GROUP BY 1, 2, 3)
SELECT tile_id, copied, i, round(h, 6) AS h FROM m WHERE tile_id IN (SELECT tile_id FROM m WHERE h IS NOT NULL)"""
    layers = f"""{_picked_sql()}, {_RGBA}, l AS (SELECT p.tile_id, p.source_idx, p.i, p.copied, x.r / 255.0::DOUBLE AS r, x.g / 255.0::DOUBLE AS g, x.b / 255.0::DOUBLE AS b, x.a / 255.0::DOUBLE AS raw,
  CASE WHEN NOT inside OR x.r = 0 AND x.g = 0 AND x.b = 0 THEN 0.0 ELSE x.a / 255.0::DOUBLE * CASE WHEN p.source_idx = 0 THEN 1.0 ELSE 0.75 END::DOUBLE END AS sa FROM picked p JOIN px x ON x.tile_id = p.from_id AND x.source_idx = p.source_idx AND x.i = p.k)"""
    merged = _composite_sql().split("FROM px),\n", 1)[1].replace("FROM l)", "FROM l WHERE NOT copied)", 1)
    steps, final = merged.rsplit("\nSELECT tile_id, i, round(r, 6)", 1)
    return {
        "elevation_full": heights,
        "stack_answer_rgba": f"""{layers},
{steps}
SELECT tile_id, copied, i, round(r, 6) AS r, round(g, 6) AS g, round(b, 6) AS b, round(raw, 6) AS a FROM l WHERE copied
UNION ALL SELECT tile_id, false AS copied, i, round(r, 6){final}""",
    }


def _encodings_sql() -> str:
    f = lambda k: "CASE source_idx " + " ".join(f"WHEN {n} THEN {x[k]!r}" for n, x in enumerate(ENCODINGS)) + " END::DOUBLE"
    step = "CASE source_idx " + " ".join(f"WHEN {n} THEN {min(x[:3])!r}" for n, x in enumerate(ENCODINGS)) + " END::DOUBLE"
    return f"""{H}, u AS (SELECT *, CAST(greatest(0, least(16777215, floor((h + {f(3)}) / {step} + 0.5))) AS BIGINT) AS u FROM heights)
SELECT tile_id, source_idx, CAST(i AS INT) AS i, CAST(u >> 16 AS INT) AS r, CAST((u >> 8) & 255 AS INT) AS g, CAST(u & 255 AS INT) AS b, round((u >> 16) * {f(0)} + ((u >> 8) & 255) * {f(1)} + (u & 255) * {f(2)} - {f(3)}, 3) AS height FROM u"""


def _blends_sql() -> str:
    """_composite_sql with the mode by tile: the standard's formulas of the six modes."""
    lower, upper = "s.{c}", "l.{c}"
    mode = f"CASE l.mode WHEN 1 THEN {lower} * {upper} WHEN 2 THEN {lower} + {upper} - {lower} * {upper} WHEN 3 THEN least({lower}, {upper}) WHEN 4 THEN greatest({lower}, {upper}) WHEN 5 THEN CASE WHEN {lower} <= 0.5 THEN 2 * {lower} * {upper} ELSE 1 - 2 * (1 - {lower}) * (1 - {upper}) END ELSE {upper} END"
    return _composite_sql([mode] * 4, ", CASE WHEN source_idx = 0 THEN 0 ELSE (tile_id + source_idx) % 6 END AS mode")


def _composite_sql(modes: list[str] | None = None, more: str = "") -> str:
    """Four layers, composed step by step from clear."""
    out = f"WITH {_RGBA}, l AS (SELECT tile_id, source_idx, i, r / 255.0::DOUBLE AS r, g / 255.0::DOUBLE AS g, b / 255.0::DOUBLE AS b, a / 255.0::DOUBLE * CASE WHEN source_idx = 0 THEN 1.0 ELSE 0.75 END::DOUBLE AS sa{more} FROM px),\n"
    out += "s0 AS (SELECT DISTINCT tile_id, i, 0.0::DOUBLE AS r, 0.0::DOUBLE AS g, 0.0::DOUBLE AS b, 0.0::DOUBLE AS a FROM l)"
    modes = modes or ["l.{c}", "s.{c} * l.{c}", "CASE WHEN s.{c} <= 0.5 THEN 2 * s.{c} * l.{c} ELSE 1 - 2 * (1 - s.{c}) * (1 - l.{c}) END", "s.{c} + l.{c} - s.{c} * l.{c}"]
    for k, mode in enumerate(modes):
        oa = "(l.sa + s.a * (1 - l.sa))"
        mix = ", ".join(f"CASE WHEN l.sa IS NULL THEN s.{c} WHEN {oa} <= 0 THEN 0.0 ELSE (l.sa * ((1 - s.a) * l.{c} + s.a * ({mode.format(c=c)})) + (1 - l.sa) * s.a * s.{c}) / {oa} END AS {c}" for c in "rgb")
        out += f",\ns{k + 1} AS (SELECT s.tile_id, s.i, {mix}, CASE WHEN l.sa IS NULL THEN s.a ELSE {oa} END AS a FROM s{k} s LEFT JOIN l ON l.tile_id = s.tile_id AND l.i = s.i AND l.source_idx = {k})"
    return out + "\nSELECT tile_id, i, round(r, 6) AS r, round(g, 6) AS g, round(b, 6) AS b, round(a, 6) AS a FROM s4 WHERE tile_id IN (SELECT tile_id FROM s4 WHERE a > 0)"
