"""Queries through files: tables written as tile databases, recipes, shapes and catalogues, read back by the connectors, with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import rules as P
from ..functions.register import register_functions
from ..operators import catalog as C
from ..operators import tiles as O
from ..sources import files as W
from ..sources import mbtiles as M
from ..sources import records as J
from .fixtures import archive_tiles, catalog, table, with_views
from .tiles import _WX, _WY, _ZR, _ZXY, _local_shared

#: Suppliers whose tiles make one database.
SUPPLIERS = 25


def _databases(s, d):
    """Every line as a tile, in a database for each 25 suppliers; every other database tells its least zoom, which its tiles don't have."""
    z = (F.col("l_linenumber") + 4).cast("int")
    side = F.expr("shiftleft(1L, l_linenumber + 4)")
    line = table(s, d, "lineitem").select(F.floor(F.col("l_suppkey") / SUPPLIERS).cast("long").alias("k"), z.alias("z"), (F.col("l_orderkey") % side).alias("x"), (F.col("l_partkey") % side).alias("y")).distinct()
    tiles = line.select(F.concat(F.lit("s"), F.col("k").cast("string"), F.lit(".mbtiles")).alias("database"), "z", "x", "y", F.concat_ws("/", "k", "z", "x", "y").alias("content"))
    groups = table(s, d, "supplier").select(F.floor(F.col("s_suppkey") / SUPPLIERS).cast("long").alias("k")).distinct()
    metadata = groups.select(F.concat(F.lit("s"), F.col("k").cast("string"), F.lit(".mbtiles")).alias("database"), F.when(F.col("k") % 2 == 0, "minzoom").otherwise("format").alias("name"), F.when(F.col("k") % 2 == 0, "2").otherwise("pbf").alias("value"))
    folder = _local_shared(s)
    M.write_databases(tiles, folder, metadata)
    return folder


def mbtiles_tiles(s, d):
    return M.scan_folder(s, _databases(s, d)).withColumn("content", F.col("content").cast("string"))


def mbtiles_zooms(s, d):
    folder = _databases(s, d)
    ranges = M.folder_ranges(s, folder).select(F.regexp_extract("path", r"([^/]*)$", 1).alias("database"), F.col("z").cast("int").alias("z"))
    return M.zoom_ranges(M.folder_metadata(s, folder), ranges)


#: Orders' keys that share a file of recipes.
RECIPES_A_FILE = 2000


def _recipes(s, d):
    """Each order as a recipe of its lines, in files of 2,000 keys; beside each file one that is broken off."""
    n, k = F.col("l_linenumber"), F.col("l_partkey")
    source = F.struct(n.alias("_n"), k.alias("_k"), F.col("l_discount").alias("opacity"), F.when(k % 29 != 0, F.when(n % 2 == 1, F.concat(F.lit("c"), n.cast("string")))).alias("category"), F.when(k % 29 != 0, F.when(n % 2 == 0, F.concat(F.lit("a"), k.cast("string")))).alias("archive"))
    lines = table(s, d, "lineitem").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.array_sort(F.collect_list(source)).alias("sources"))
    o = F.col("o_orderkey")
    recipe = F.struct(F.when(o % 17 == 0, F.lit(None)).when(o % 19 == 0, "  ").otherwise(F.concat(F.lit("r"), o.cast("string"))).alias("id"), "sources")
    rows = table(s, d, "orders").select("o_orderkey").join(lines, "o_orderkey", "left").select("o_orderkey", F.to_json(recipe).alias("r"))
    texts = rows.groupBy(F.floor(o / RECIPES_A_FILE).cast("string").alias("f")).agg(F.concat(F.lit("["), F.array_join(F.collect_list("r"), ",\n"), F.lit("]")).alias("content"))
    broken = rows.select(F.floor(o / RECIPES_A_FILE).cast("string").alias("f")).distinct().select(F.concat(F.lit("broken-"), "f", F.lit(".json")).alias("name"), F.lit('{"id": "b", "sources": [').alias("content"))
    folder = _local_shared(s)
    W.write_files(texts.select(F.concat(F.lit("recipes-"), "f", F.lit(".json")).alias("name"), "content").unionByName(broken), folder)
    return J.load_recipes(s, folder)


def recipe_problems(s, d):
    return _recipes(s, d).select("id", "problem", F.coalesce(F.size("sources"), F.lit(0)).alias("sources"))


def recipe_sources(s, d):
    return J.recipe_sources(_recipes(s, d)).select("stack_id", "idx", "category", "archive", "opacity")


#: Rings of the four forms of shapes, as steps in degrees from a supplier's own point.
FORMS = (
    [[(0, 0), (20, 0), (20, 20), (0, 20), (0, 0)], [(5, 5), (10, 5), (10, 10), (5, 5)]],
    [[(0, 0), (8, 1), (9, 9), (1, 8), (0, 0)], [(30, 0), (34, 0), (32, 7), (30, 0)]],
    [[(0, 0), (6, 0), (6, 6), (0, 0)], [(-9, -9), (-3, -9), (-3, -4), (-9, -9)]],
    [[(0, 0), (15, 2), (12, 11), (1, 9)]],
)


def cutline_segments(s, d):
    """A shape of each supplier in a file of its own: a polygon with a hole, a feature of two polygons, collections within a collection with a point and a ring that is too short, and a ring left open."""
    k = F.col("s_suppkey")
    lon, lat = k % 140 - 70, k % 90 - 50
    ring = lambda points: F.array(*(F.array(lon + x, lat + y) for x, y in points))
    rings = [[ring(r) for r in form] for form in FORMS]
    shape = lambda kind, c: F.struct(F.lit(kind).alias("type"), c.alias("coordinates"))
    of = lambda kind, name, c: F.struct(F.lit(kind).alias("type"), c.alias(name))
    inner = F.to_json(of("GeometryCollection", "geometries", F.array(shape("Polygon", F.array(rings[2][1])))))
    outer = F.concat(F.lit('{"type":"GeometryCollection","geometries":['), F.to_json(shape("Polygon", F.array(rings[2][0]))), F.lit(',{"type":"Point","coordinates":[1,2]},'), inner, F.lit("]}"))
    short = F.to_json(of("Feature", "geometry", shape("Polygon", F.array(ring([(0, 0), (1, 0), (0, 0)])))))
    text = (
        F.when(k % 4 == 0, F.to_json(shape("Polygon", F.array(*rings[0]))))
        .when(k % 4 == 1, F.to_json(of("Feature", "geometry", shape("MultiPolygon", F.array(*(F.array(r) for r in rings[1]))))))
        .when(k % 4 == 2, F.concat(F.lit('{"type":"FeatureCollection","features":['), short, F.lit(',{"type":"Feature","geometry":'), outer, F.lit("}]}")))
        .otherwise(F.to_json(shape("Polygon", F.array(*rings[3]))))
    )
    folder = _local_shared(s)
    W.write_files(table(s, d, "supplier").select(F.concat(F.lit("shape."), k.cast("string"), F.lit(".geojson")).alias("name"), text.alias("content")), folder)
    segs = J.load_shapes(s, folder)
    return segs.select("shape", "ring", "seg", *(F.round(c, 9).alias(c) for c in ("ax", "ay", "bx", "by")))


#: The format that the queries' catalogues have.
FORMAT = "tile-catalogue/"


def peer_catalogues(s, d):
    """Each customer as a peer whose catalogue has its orders, by pages of 5,000 keys; every tenth peer's format is another one."""
    c = catalog(s, d)
    entry = F.struct(F.col("info_hash").cast("string").alias("infoHash"), "name", "size", "categories")
    page = F.floor(F.col("info_hash") / 5000)
    kind = F.when(F.col("peer") % 10 == 0, "other/1").otherwise(FORMAT + "2")
    bodies = c.groupBy(F.col("custkey").alias("peer"), page.alias("page")).agg(F.collect_list(entry).alias("archives")).select("peer", F.to_json(F.struct(kind.alias("format"), "archives")).alias("body"))
    return J.catalogue_entries(bodies, FORMAT).select("peer", F.col("infoHash").alias("info_hash"), "name", "size", F.array_join("categories", "|").alias("categories"))


def catalogue_lines(s, d):
    """The export of one category's published archives, written as lines and read again."""
    k = F.col("info_hash")
    lines = J.catalogue_export(catalog(s, d).withColumn("published", F.when(k % 3 != 0, k % 3 == 1)), FORMAT + "2", "building")
    folder = f"{_local_shared(s)}/lines"
    lines.select("value").write.text(folder)
    read = s.read.schema("format string, count long, infoHash string, name string, size long, categories array<string>").json(folder)
    return read.select("format", "count", F.col("infoHash").alias("info_hash"), "name", "size", F.when(F.col("categories").isNotNull(), F.array_join("categories", "|")).alias("categories"))


def seeding_limits(s, d):
    c, k = catalog(s, d), F.col("info_hash")
    ratio = F.when(k % 3 == 0, 1.5).when(k % 3 == 1, 0.0)
    own = F.when(k % 4 != 3, F.struct(ratio.alias("ratio"), F.when(k % 5 == 0, 60).alias("minutes")))
    node = F.struct(F.when(F.col("custkey") % 2 == 0, 2.0).alias("ratio"), F.when(F.col("custkey") % 3 == 0, 0).otherwise(1440).alias("minutes"))
    limit = C.seeding_limit(own, node, F.when(k % 7 < 2, k % 7 == 0))
    return c.select("info_hash", limit.alias("l")).select("info_hash", "l.ratio", "l.minutes")


def payload_kinds(s, d):
    """Texts behind the first bytes of an archive, of a database, of a database cut short, or as they are."""
    k = F.col("doc_id") % 4
    head = F.when(k == 0, F.lit(b"PM\x03")).when(k == 1, F.lit(b"SQLite format 3\0")).when(k == 2, F.lit(b"SQLite format 3")).otherwise(F.lit(b""))
    return table(s, d, "documents").select("doc_id", P.kind_of_bytes(F.concat(head, F.coalesce(F.col("text"), F.lit("")).cast("binary"))).alias("kind"))


def sql_tile_places(s, d):
    """Places, ids and parents through the SQL functions."""
    register_functions(s)
    return s.sql(
        """SELECT tile_id, p.z, p.x, p.y, tile_id(p.z, p.x, p.y) AS back, tile_parent(p.z, p.x, p.y, least(p.z, 2)).x AS parent_x, tile_parent(p.z, p.x, p.y, least(p.z, 2)).y AS parent_y
FROM (SELECT tile_id, tile_place(tile_id) AS p FROM {tiles})""",
        tiles=O.coverage_union(archive_tiles(s, d)),
    )


QUERIES = (mbtiles_tiles, mbtiles_zooms, recipe_problems, recipe_sources, cutline_segments, peer_catalogues, catalogue_lines, seeding_limits, payload_kinds, sql_tile_places)

_LINES = f"t AS (SELECT DISTINCT l_suppkey // {SUPPLIERS} AS k, l_linenumber + 4 AS z, l_orderkey % (1 << (l_linenumber + 4)) AS x, l_partkey % (1 << (l_linenumber + 4)) AS y FROM lineitem)"
_CAT = with_views("catalog")


def _segments_sql() -> str:
    rows = []
    for form, rings in enumerate(FORMS):
        for n, ring in enumerate(rings):
            ends = [*ring[1:], ring[0]]
            rows += [(form, n, i, *a, *b) for i, (a, b) in enumerate(zip(ring, ends, strict=True)) if a != b]
    end = lambda p: ", ".join(f"round({f(f'{c}{p} + {at}')}, 9) AS {n}" for f, c, at, n in ((_WX, "x", "(s_suppkey % 140 - 70)", "ab"[p - 1] + "x"), (_WY, "y", "(s_suppkey % 90 - 50)", "ab"[p - 1] + "y")))
    return f"""WITH steps(form, ring, seg, x1, y1, x2, y2) AS (VALUES {', '.join(str(r) for r in rows)})
SELECT 'shape.' || s_suppkey AS shape, ring, seg, {end(1)}, {end(2)} FROM supplier JOIN steps ON form = s_suppkey % 4"""


_RECIPE = f"""WITH s AS (SELECT l_orderkey, l_linenumber AS n, l_partkey AS k, l_discount AS opacity, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_discount) - 1 AS idx FROM lineitem),
r AS (SELECT o_orderkey, CASE WHEN o_orderkey % 17 = 0 THEN NULL WHEN o_orderkey % 19 = 0 THEN '  ' ELSE 'r' || o_orderkey END AS id, coalesce(n, 0) AS n, coalesce(bare, false) AS bare
  FROM orders LEFT JOIN (SELECT l_orderkey AS o_orderkey, count(*) AS n, bool_or(k % 29 = 0) AS bare FROM s GROUP BY 1) USING (o_orderkey)),
p AS (SELECT *, CASE WHEN trim(coalesce(id, '')) = '' THEN 'no id' WHEN n = 0 THEN 'no sources' WHEN bare THEN 'a source without category or archive' END AS problem FROM r)"""

ORACLE = {
    "mbtiles_tiles": f"WITH {_LINES} SELECT 's' || k || '.mbtiles' AS database, z, x, y, concat_ws('/', k, z, x, y) AS content FROM t",
    "mbtiles_zooms": f"WITH {_LINES} SELECT 's' || k || '.mbtiles' AS database, CASE WHEN k % 2 = 0 THEN 2 ELSE min(z) END AS min_zoom, max(z) AS max_zoom FROM t GROUP BY k",
    "recipe_problems": f"{_RECIPE} SELECT id, problem, n AS sources FROM p UNION ALL SELECT NULL, 'unreadable', 0 FROM (SELECT DISTINCT o_orderkey // {RECIPES_A_FILE} FROM orders)",
    "recipe_sources": f"{_RECIPE} SELECT id AS stack_id, idx, CASE WHEN s.n % 2 = 1 THEN 'c' || s.n END AS category, CASE WHEN s.n % 2 = 0 THEN 'a' || k END AS archive, opacity FROM p JOIN s ON l_orderkey = o_orderkey WHERE problem IS NULL",
    "cutline_segments": _segments_sql(),
    "peer_catalogues": f"{_CAT} SELECT custkey AS peer, CAST(info_hash AS VARCHAR) AS info_hash, name, size, array_to_string(categories, '|') AS categories FROM catalog WHERE custkey % 10 <> 0",
    "catalogue_lines": f"""{_CAT}, c AS (SELECT * FROM catalog WHERE info_hash % 3 <> 2 AND list_contains(categories, 'BUILDING'))
SELECT '{FORMAT}2' AS format, count(*) AS count, NULL AS info_hash, NULL AS name, NULL AS size, NULL AS categories FROM c UNION ALL SELECT NULL, NULL, CAST(info_hash AS VARCHAR), name, size, array_to_string(categories, '|') FROM c""",
    "seeding_limits": f"""{_CAT}, l AS (SELECT info_hash, custkey, CASE WHEN info_hash % 4 <> 3 THEN CASE info_hash % 3 WHEN 0 THEN 1.5 WHEN 1 THEN 0.0 END END AS r, CASE WHEN info_hash % 4 <> 3 AND info_hash % 5 = 0 THEN 60 END AS m,
  CASE WHEN custkey % 2 = 0 THEN 2.0 END AS nr, CASE WHEN custkey % 3 = 0 THEN 0 ELSE 1440 END AS nm FROM catalog),
u AS (SELECT *, CASE WHEN info_hash % 7 = 0 THEN 0 WHEN coalesce(r, 0) > 0 OR coalesce(m, 0) > 0 THEN 1 WHEN coalesce(nr, 0) > 0 OR nm > 0 THEN 2 ELSE 0 END AS who FROM l)
SELECT info_hash, CAST(CASE who WHEN 1 THEN r WHEN 2 THEN nr END AS DOUBLE) AS ratio, CASE who WHEN 1 THEN m WHEN 2 THEN nm END AS minutes FROM u""",
    "payload_kinds": "SELECT doc_id, CASE WHEN doc_id % 4 = 0 OR doc_id % 4 = 3 AND starts_with(text, 'PM') THEN 'pmtiles' WHEN doc_id % 4 = 1 THEN 'mbtiles' ELSE 'other' END AS kind FROM documents",
    "sql_tile_places": f"{_ZR}, {_ZXY} SELECT tile_id, z, x, y, tile_id AS back, x >> least(z, 2) AS parent_x, y >> least(z, 2) AS parent_y FROM places",
}
