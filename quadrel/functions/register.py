"""The geometry functions for SQL users."""

from __future__ import annotations

from pyspark.sql import SparkSession

from .tiles import MAX_LATITUDE, MAX_ZOOM

_COLUMN = "CAST(greatest(0, least(power(2, {z}) - 1, floor({f} * power(2, {z})))) AS BIGINT)"
_LAT = f"radians(greatest(-{MAX_LATITUDE}D, least({MAX_LATITUDE}D, {{c}})))"


def _y(c: str) -> str:
    lat = _LAT.format(c=c)
    return f"((1 - ln(tan({lat}) + 1 / cos({lat})) / pi()) / 2)"


def _x(c: str) -> str:
    return f"(({c} + 180) / 360)"


_FIRST = f"CAST(array({', '.join(str((4**k - 1) // 3) + 'L' for k in range(MAX_ZOOM + 1))})[z] AS BIGINT)"
#: One level of the curve: what the quadrant adds, and how it turns the rest.
_DOWN = "named_struct('x', CASE WHEN a.y & s > 0 THEN a.x ELSE CASE WHEN a.x & s > 0 THEN s - 1 - a.y ELSE a.y END END, 'y', CASE WHEN a.y & s > 0 THEN a.y ELSE CASE WHEN a.x & s > 0 THEN s - 1 - a.x ELSE a.x END END, 'd', a.d + s * s * ((3 * CAST(a.x & s > 0 AS BIGINT)) ^ CAST(a.y & s > 0 AS BIGINT)))"
#: One level back up: the lowest pair of bits says the quadrant, which turns what was found below it.
_RX, _RY = "(shiftright(a.t, 1) & 1)", "((a.t ^ shiftright(a.t, 1)) & 1)"
_UP = f"named_struct('x', CASE WHEN {_RY} = 1 THEN a.x WHEN {_RX} = 1 THEN s - 1 - a.y ELSE a.y END + s * {_RX}, 'y', CASE WHEN {_RY} = 1 THEN a.y WHEN {_RX} = 1 THEN s - 1 - a.x ELSE a.x END + s * {_RY}, 't', shiftright(a.t, 2))"
_PLACE = f"aggregate(CASE WHEN z > 0 THEN transform(sequence(0, z - 1), k -> shiftleft(1L, k)) ELSE CAST(array() AS ARRAY<BIGINT>) END, named_struct('x', 0L, 'y', 0L, 't', id - {_FIRST}), (a, s) -> {_UP}, a -> named_struct('z', z, 'x', a.x, 'y', a.y))"
SCALARS = (
    ("world_x", "lon DOUBLE", "DOUBLE", _x("lon")),
    ("world_y", "lat DOUBLE", "DOUBLE", _y("lat")),
    ("first_tile_id", "z INT", "BIGINT", _FIRST),
    ("tile_zoom", "id BIGINT", "INT", f"CASE WHEN id >= 0 AND id < {(4 ** (MAX_ZOOM + 1) - 1) // 3} THEN shiftright(length(bin(id * 3 + 1)) - 1, 1) END"),
    ("tile_id", "z INT, x BIGINT, y BIGINT", "BIGINT", f"{_FIRST} + aggregate(CASE WHEN z > 0 THEN transform(sequence(z - 1, 0, -1), k -> shiftleft(1L, k)) ELSE CAST(array() AS ARRAY<BIGINT>) END, named_struct('x', x, 'y', y, 'd', 0L), (a, s) -> {_DOWN}, a -> a.d)"),
    ("tile_place_at", "id BIGINT, z INT", "STRUCT<z: INT, x: BIGINT, y: BIGINT>", _PLACE),
    ("tile_place", "id BIGINT", "STRUCT<z: INT, x: BIGINT, y: BIGINT>", "CASE WHEN tile_zoom(id) IS NOT NULL THEN tile_place_at(id, tile_zoom(id)) END"),
    ("tile_z", "id BIGINT", "INT", "tile_zoom(id)"),
    ("tile_x", "id BIGINT", "BIGINT", "tile_place(id).x"),
    ("tile_y", "id BIGINT", "BIGINT", "tile_place(id).y"),
    ("tile_column", "lon DOUBLE, z INT", "BIGINT", _COLUMN.format(z="z", f=_x("lon"))),
    ("tile_row", "lat DOUBLE, z INT", "BIGINT", _COLUMN.format(z="z", f=_y("lat"))),
    ("tile_box", "z INT, x BIGINT, y BIGINT", "STRUCT<min_x: DOUBLE, min_y: DOUBLE, max_x: DOUBLE, max_y: DOUBLE>", "named_struct('min_x', x / power(2, z), 'min_y', y / power(2, z), 'max_x', (x + 1) / power(2, z), 'max_y', (y + 1) / power(2, z))"),
    ("tile_parent", "z INT, x BIGINT, y BIGINT, levels INT", "STRUCT<z: INT, x: BIGINT, y: BIGINT>", "named_struct('z', z - levels, 'x', shiftright(x, levels), 'y', shiftright(y, levels))"),
    ("bounds_ok", "west DOUBLE, south DOUBLE, east DOUBLE, north DOUBLE", "BOOLEAN", "coalesce(west BETWEEN -180 AND 180 AND east BETWEEN -180 AND 180 AND south BETWEEN -90 AND 90 AND north BETWEEN -90 AND 90 AND west < east AND south < north, false)"),
    ("bucket_seconds", "since BIGINT, until BIGINT, buckets BIGINT", "BIGINT", "greatest(1, floor((until - since) / buckets + 0.5))"),
    ("revision", "parts ARRAY<STRING>", "STRING", "substring(sha1(array_join(transform(parts, p -> coalesce(p, '')), ':')), 1, 16)"),
)


def register_functions(spark: SparkSession) -> None:
    """Temporary SQL functions for scalars, and tiles_in_bounds(west, south, east, north, min_zoom, max_zoom) as a table function; all are SQL, so Spark plans them like any query."""
    for name, args, kind, body in SCALARS:
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {name}({args}) RETURNS {kind} RETURN {body}")
    column, row = (lambda c, f: _COLUMN.format(z="z", f=f(c)) for _ in range(2))
    spark.sql(f"""CREATE OR REPLACE TEMPORARY FUNCTION tiles_in_bounds(west DOUBLE, south DOUBLE, east DOUBLE, north DOUBLE, low INT, high INT) RETURNS TABLE(z INT, x BIGINT, y BIGINT) RETURN
SELECT z, x, y FROM (SELECT explode(sequence(low, high)) AS z) LATERAL VIEW explode(CASE WHEN {column("west", _x)} <= {column("east", _x)} THEN sequence({column("west", _x)}, {column("east", _x)}) END) AS x
LATERAL VIEW explode(CASE WHEN {row("north", _y)} <= {row("south", _y)} THEN sequence({row("north", _y)}, {row("south", _y)}) END) AS y""")
