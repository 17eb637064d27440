"""Tile geometry as Column expressions; z, x and y are whole numbers, tile ids follow the Hilbert curve through the zoom pyramid."""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Zooms that a 64-bit id serves here, and the latitude where the square world ends.
MAX_ZOOM = 26
MAX_LATITUDE = 85.0511287798066
#: Every second bit, and the masks that bring those bits together in five steps.
EVEN = 0x5555555555555555
GATHER = ((1, 0x3333333333333333), (2, 0x0F0F0F0F0F0F0F0F), (4, 0x00FF00FF00FF00FF), (8, 0x0000FFFF0000FFFF), (16, 0x00000000FFFFFFFF))


def _long(c) -> Column:
    return (F.lit(c) if not isinstance(c, Column) else c).cast("long")


def first_id(z: Column) -> Column:
    """Number of tiles in all lower zooms: (4^z - 1) / 3, looked up in whole numbers, for doubles lose ids beyond 2^53."""
    return F.get(F.lit([(4**k - 1) // 3 for k in range(MAX_ZOOM + 1)]).cast("array<long>"), z)


def zoom_of(tile_id: Column) -> Column:
    """The zoom of a tile id, by the length of 3 * id + 1 in bits; null for ids below 0 or beyond MAX_ZOOM."""
    return F.when(tile_id.between(0, (4 ** (MAX_ZOOM + 1) - 1) // 3 - 1), F.shiftright(F.length(F.bin(tile_id * 3 + 1)) - 1, 1))


def tile_id(z: Column, x: Column, y: Column) -> Column:
    """Hilbert id of a tile: at each level from the highest bit down, the quadrant adds to the distance and turns the rest."""
    z = z.cast("int")
    start = F.struct(_long(x).alias("x"), _long(y).alias("y"), _long(0).alias("d"))

    def level(acc: Column, k: Column) -> Column:
        # k counts down to the lowest bit; the side of this level's quadrant is 2^k.
        s = F.get(F.lit([1 << i for i in range(MAX_ZOOM)]).cast("array<long>"), k)
        rx, ry = (acc["x"].bitwiseAND(s) > 0).cast("long"), (acc["y"].bitwiseAND(s) > 0).cast("long")
        d = acc["d"] + s * s * (F.lit(3) * rx).bitwiseXOR(ry)
        flip = (ry == 0) & (rx == 1)
        x1, y1 = F.when(flip, s - 1 - acc["x"]).otherwise(acc["x"]), F.when(flip, s - 1 - acc["y"]).otherwise(acc["y"])
        return F.struct(F.when(ry == 0, y1).otherwise(x1).alias("x"), F.when(ry == 0, x1).otherwise(y1).alias("y"), d.alias("d"))

    levels = F.when(z > 0, F.sequence(z - 1, F.lit(0), F.lit(-1))).otherwise(F.array().cast("array<int>"))
    return first_id(z) + F.aggregate(levels, start, level, lambda acc: acc["d"])


#: Columns by name, in steps: each step's columns are made of those before it.
Step = dict[str, Callable[[dict[str, Column]], Column]]


def _place_steps() -> list[Step]:
    """Steps from a tile id to z, x and y. The turns of all levels are composed at once by a prefix scan over the id's bit pairs (exclusive or, with doubling distance)."""
    even = F.lit(EVEN)
    by_zoom = lambda z, f: F.get(F.lit([f(k) for k in range(MAX_ZOOM + 1)]).cast("array<long>"), z)
    steps: list[Step] = [
        {"z": lambda c: zoom_of(c["id"])},
        # Levels above the tile hold the pair that turns nothing.
        {"t": lambda c: (c["id"] - first_id(c["z"])).bitwiseOR(by_zoom(c["z"], lambda k: (EVEN << 2 * k) % (1 << 64)))},
        {"high": lambda c: F.shiftrightunsigned(c["t"], 1).bitwiseAND(even)},
        {"turn": lambda c: (c["t"].bitwiseAND(even) + c["high"]).bitwiseXOR(even)},
    ]
    for by in (2, 4, 8, 16, 32):
        steps.append({"turn": lambda c, by=by: c["turn"].bitwiseXOR(F.shiftrightunsigned(c["turn"], by))})
    steps += [
        {"flip": lambda c: c["t"].bitwiseAND(c["turn"].bitwiseAND(even)).bitwiseXOR(F.shiftrightunsigned(c["turn"], 1).bitwiseAND(even))},
        {"t": lambda c: c["t"].bitwiseXOR(c["high"]).bitwiseXOR(c["flip"]).bitwiseXOR(F.shiftleft(c["flip"], 1)).bitwiseAND(by_zoom(c["z"], lambda k: 4**k - 1))},
        {"x": lambda c: F.shiftrightunsigned(c["t"], 1).bitwiseAND(even), "y": lambda c: c["t"].bitwiseAND(even)},
    ]
    for by, mask in GATHER:
        steps.append({k: lambda c, k=k, by=by, mask=mask: c[k].bitwiseXOR(F.shiftrightunsigned(c[k], by)).bitwiseAND(F.lit(mask)) for k in ("x", "y")})
    return steps


def with_places(tiles: DataFrame, column: str = "tile_id") -> DataFrame:
    """tiles with z, x, y of their ids (null for ids that are none). Every step is a projection of its own, which Spark compiles into one loop and does not merge, for each refers to the one before it twice; a generator of one row holds back filters and join keys, which would otherwise be rewritten into copies of all steps."""
    name = lambda n: f"_tile_{n}"
    out, have = tiles.withColumn(name("id"), F.col(column).cast("long")), {"id"}
    for step in _place_steps():
        columns = {n: F.col(name(n)) for n in have}
        out = out.withColumns({name(n): f(columns) for n, f in step.items()})
        have |= set(step)
    place = F.inline(F.array(F.struct(F.col(name("z")).alias("z"), F.col(name("x")).alias("x"), F.col(name("y")).alias("y"))))
    return out.select(*(F.col(f"`{c}`") for c in tiles.columns), place)


def zxy(tile: Column) -> Column:
    """struct(z int, x long, y long) of a tile id as one expression; null for ids that are none. Steps are bound as lambda variables, so each stands once in the plan. with_places() is compiled and faster."""
    values, have = F.array(F.struct(tile.cast("long").alias("id"))), frozenset(["id"])

    def bound(step: Step, before: frozenset[str]) -> Callable[[Column], Column]:
        return lambda v: F.struct(*((step[n]({m: v[m] for m in before}) if n in step else v[n]).alias(n) for n in sorted(before | set(step))))

    for step in _place_steps():
        values, have = F.transform(values, bound(step, have)), have | set(step)
    return F.get(F.transform(values, lambda v: F.when(v["z"].isNotNull(), F.struct(v["z"].alias("z"), v["x"].alias("x"), v["y"].alias("y")))), F.lit(0))


def world_x(lon: Column) -> Column:
    """Longitude as a fraction of the world from the west."""
    return (lon + 180) / 360


def world_y(lat: Column) -> Column:
    """Latitude as a fraction of the world from the north, held within the square world."""
    r = F.radians(F.greatest(F.lit(-MAX_LATITUDE), F.least(F.lit(MAX_LATITUDE), lat)))
    return (1 - F.log(F.tan(r) + 1 / F.cos(r)) / math.pi) / 2


def tile_of(fraction: Column, z: Column) -> Column:
    """Column or row of a world fraction at a zoom, held within the world."""
    n = F.pow(F.lit(2.0), z.cast("double"))
    return F.greatest(F.lit(0.0), F.least(n - 1, F.floor(fraction * n).cast("double"))).cast("long")


def tile_box(z: Column, x: Column, y: Column) -> Column:
    """World fractions of a tile's edges."""
    n = F.pow(F.lit(2.0), z.cast("double"))
    return F.struct((x / n).alias("min_x"), (y / n).alias("min_y"), ((x + 1) / n).alias("max_x"), ((y + 1) / n).alias("max_y"))


def parent(z: Column, x: Column, y: Column, levels: Column) -> Column:
    """The ancestor some levels up, and where in it the tile's square begins, in squares of that level."""
    span = F.pow(F.lit(2.0), levels.cast("double")).cast("long")
    return F.struct((z - levels).cast("int").alias("z"), F.floor(x / span).cast("long").alias("x"), F.floor(y / span).cast("long").alias("y"), F.pmod(_long(x), span).alias("dx"), F.pmod(_long(y), span).alias("dy"), span.alias("span"))


def box_range(west: Column, south: Column, east: Column, north: Column, z: Column) -> Column:
    """Columns and rows that a box touches at a zoom. A box across the antimeridian (west > east) has none, unless both ends share a column."""
    return F.struct(tile_of(world_x(west), z).alias("x0"), tile_of(world_x(east), z).alias("x1"), tile_of(world_y(north), z).alias("y0"), tile_of(world_y(south), z).alias("y1"))


def box_count(west: Column, south: Column, east: Column, north: Column, z: Column) -> Column:
    r = box_range(west, south, east, north, z)
    return F.greatest(F.lit(0).cast("long"), r["x1"] - r["x0"] + 1) * F.greatest(F.lit(0).cast("long"), r["y1"] - r["y0"] + 1)


def bounds_ok(west: Column, south: Column, east: Column, north: Column) -> Column:
    """Whether four numbers make a rectangle on the map."""
    return F.coalesce(west.between(-180, 180) & east.between(-180, 180) & south.between(-90, 90) & north.between(-90, 90) & (west < east) & (south < north), F.lit(False))


def bounds_segments(west: Column, south: Column, east: Column, north: Column) -> Column:
    """The four sides of a rectangle as segments of world fractions; null where the rectangle is not valid."""
    corners = [(west, north), (east, north), (east, south), (west, south)]
    sides = [F.struct(F.lit(i).alias("seg"), world_x(a[0]).alias("ax"), world_y(a[1]).alias("ay"), world_x(b[0]).alias("bx"), world_y(b[1]).alias("by")) for i, (a, b) in enumerate(zip(corners, corners[1:] + corners[:1], strict=True))]
    return F.when(bounds_ok(west, south, east, north), F.array(*sides))


def bucket_seconds(since: Column, until: Column, buckets: Column) -> Column:
    """Width of a time bucket: at least a second."""
    return F.greatest(F.lit(1).cast("long"), F.floor((until - since) / buckets + 0.5))


def revision(*parts: Column, length: int = 16) -> Column:
    """A short digest of what an answer depends on."""
    return F.substring(F.sha1(F.concat_ws(":", *(F.coalesce(p.cast("string"), F.lit("")) for p in parts))), 1, length)
