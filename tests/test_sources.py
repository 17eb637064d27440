"""Connectors: archives written and read back, databases, recipes, shapes and catalogues."""

import json
import sqlite3

import pytest
from pyspark.sql import functions as F

from quadrel.functions import tiles as T
from quadrel.functions.register import register_functions
from quadrel.functions.rules import expand_template, kind_of_bytes
from quadrel.operators import raster as R
from quadrel.operators.catalog import seeding_limit
from quadrel.sources import mbtiles, pmtiles, records, text


def test_directory_round_trip():
    entries = [(0, 0, 10, 1), (1, 10, 300, 4), (9, 0, 10, 1), (2**40, 310, 70000, 2)]
    assert pmtiles.decode_directory(pmtiles.encode_directory(entries)) == entries
    assert pmtiles.decode_directory(pmtiles.encode_directory([])) == []


def test_archive_round_trip(spark, tmp_path):
    n = 9000
    rows = spark.range(n).select((F.col("id") * 3 - F.col("id") % 2).alias("tile_id"), F.when(F.col("id") % 10 < 4, F.lit("sea")).otherwise(F.concat(F.lit("tile-"), F.col("id").cast("string"))).alias("content"))
    rows = rows.unionByName(spark.range(50).select((F.col("id") + 100000).alias("tile_id"), F.lit("sea").alias("content")))
    report = pmtiles.write_archive(rows, str(tmp_path / "a.pmtiles"), {"max_zoom": 9, "tile_type": 1, "west": -1800000000}, {"name": "test"}, scratch=str(tmp_path / "parts"))
    assert report["addressed"] == n + 50
    assert report["contents"] == n * 6 // 10 + 1
    entries = pmtiles.scan(spark, str(tmp_path))
    back = pmtiles.tile_ids(pmtiles.read_tiles(entries, str(tmp_path)).select("archive", "tile_id", "offset", "length", "run_length"))
    assert back.count() == n + 50
    tiles = pmtiles.read_tiles(entries, str(tmp_path)).select(F.explode(F.sequence("tile_id", F.col("tile_id") + F.col("run_length") - 1)).alias("tile_id"), F.col("content").cast("string").alias("content"))
    assert tiles.exceptAll(rows).count() == 0 and rows.exceptAll(tiles).count() == 0
    assert entries.filter("tile_id >= 100000").agg(F.sum("run_length")).first()[0] == 50
    head = pmtiles.scan(spark, str(tmp_path), "headers").first()
    with open(tmp_path / "a.pmtiles", "rb") as f:
        raw = pmtiles.read_header(f)
    assert raw["root_length"] <= pmtiles.ROOT_LIMIT - pmtiles.HEADER and raw["leaf_length"] > 0
    few = rows.filter("tile_id < 300")
    assert pmtiles.write_archive(few, str(tmp_path / "flat/b.pmtiles") if (tmp_path / "flat").mkdir() is None else "", scratch=str(tmp_path / "parts"))["addressed"] == few.count()
    flat = pmtiles.read_tiles(pmtiles.scan(spark, str(tmp_path / "flat")), str(tmp_path / "flat")).select(F.explode(F.sequence("tile_id", F.col("tile_id") + F.col("run_length") - 1)).alias("tile_id"), F.col("content").cast("string").alias("content"))
    assert flat.exceptAll(few).count() == 0 and few.exceptAll(flat).count() == 0
    assert (head.format, head.max_zoom, head.west, head.addressed, json.loads(head.metadata)["name"]) == ("mvt", 9, -180.0, n + 50, "test")


def test_tile_database(spark, tmp_path):
    path = str(tmp_path / "t.mbtiles")
    db = sqlite3.connect(path)
    db.execute("CREATE TABLE metadata (name TEXT, value TEXT)")
    db.execute("CREATE TABLE tiles (zoom_level INT, tile_column INT, tile_row INT, tile_data BLOB)")
    db.execute("INSERT INTO metadata VALUES ('maxzoom', '5')")
    db.executemany("INSERT INTO tiles VALUES (?, ?, ?, ?)", [(2, x, y, f"{x}-{y}".encode()) for x in range(4) for y in range(4)])
    db.commit()
    db.close()
    tiles = mbtiles.scan(spark, path)
    assert tiles.count() == 16
    assert tiles.filter("x = 1 and y = 0").first().content == b"1-3"
    z = mbtiles.zoom_range(mbtiles.scan(spark, path, "metadata"), tiles).first()
    assert (z.min_zoom, z.max_zoom) == (2, 5)


def test_recipes_keep_their_problems(spark, tmp_path):
    (tmp_path / "r").mkdir()
    (tmp_path / "r/good.json").write_text(json.dumps({"id": "a", "sources": [{"category": "x"}, {"archive": "h", "opacity": 0.5}]}))
    (tmp_path / "r/bad.json").write_text(json.dumps({"id": "b", "sources": []}))
    recipes = records.load_recipes(spark, str(tmp_path / "r"))
    assert {x.id: x.problem for x in recipes.collect()} == {"a": None, "b": "no sources"}
    assert [(x.idx, x.category, x.archive) for x in records.recipe_sources(recipes).orderBy("idx").collect()] == [(0, "x", None), (1, None, "h")]


def test_shapes(spark, tmp_path):
    (tmp_path / "s").mkdir()
    ring = [[0, 0], [10, 0], [10, 10], [0, 10], [0, 0]]
    (tmp_path / "s/box.geojson").write_text(json.dumps({"type": "FeatureCollection", "features": [{"type": "Feature", "geometry": {"type": "MultiPolygon", "coordinates": [[ring], [[[20, 20], [30, 20], [30, 30.5]]]]}}]}))
    segs = records.load_shapes(spark, str(tmp_path / "s"))
    assert {(x.shape, x.ring) for x in segs.collect()} == {("box", 0)}  # the ring of three points is dropped
    assert segs.count() == 4


def test_shapes_by_type(spark):
    """Only polygons have rings; lines don't become any, and a shape without polygons is an error."""
    ring, hole, far = [[0, 0], [10, 0], [10, 10], [0, 0]], [[1, 1], [2, 1], [2, 2], [1, 1]], [[20, 20, 5], [30, 20, 5], [30, 30.5, 5], [21, 22, 5]]
    line = {"type": "LineString", "coordinates": far}
    many = {"type": "GeometryCollection", "geometries": [line, {"type": "Polygon", "coordinates": [ring, hole]}, {"type": "GeometryCollection", "geometries": [{"type": "MultiPolygon", "coordinates": [[far], [ring[:3]]]}]}]}
    nodes = {"bare": {"type": "Polygon", "coordinates": [ring]}, "feature": {"type": "Feature", "properties": {"coordinates": [ring]}, "geometry": many}, "nested": {"type": "FeatureCollection", "features": [{"type": "FeatureCollection", "features": [{"type": "Feature", "geometry": many}]}, {"type": "Feature", "geometry": line}]}}
    shapes = spark.createDataFrame([(k, json.dumps(v)) for k, v in nodes.items()], "shape string, value string")
    assert {r.shape: len(r.rings) for r in records.shape_rings(shapes).collect()} == {"bare": 1, "feature": 3, "nested": 3}
    assert {(r.shape, r["count"]) for r in records.shape_segments(shapes).groupBy("shape").count().collect()} == {("bare", 3), ("feature", 10), ("nested", 10)}
    with pytest.raises(Exception, match="no polygons in shape road"):
        records.shape_rings(spark.createDataFrame([("road", json.dumps(line))], "shape string, value string")).collect()


def test_links_resolve(spark):
    rows = [("x?a=1#f", "http://h/d/x?a=1#f"), ("?b", "http://h/d/i.html?b"), ("#f", "http://h/d/i.html?q#f"), ("//O.example/y", "http://o.example/y"), ("/z/./q/../r/", "http://h/z/r/"), ("..", "http://h/"), ("../../../up", "http://h/up"), ("HTTPS://A/b", "https://a/b"), ("ftp://a/b", None), ("http://a", "http://a/")]
    got = spark.createDataFrame(rows, "raw string, want string").select("want", text.resolved(F.col("raw"), F.lit("http://h/d/i.html?q#g")).alias("got")).collect()
    assert [(r.got or "").replace("HTTPS:", "https:") for r in got] == [r.want or "" for r in got]


def test_dated_templates(spark):
    at = F.lit("2024-03-05").cast("date")
    for form, want in {"{YYYY}-{MM}-{DD}": "2024-03-05", "{YYYY-MM-DD}": "2024-03-05", "{yy.m.d}": "24.3.5", "{Y}{YYY}": "20242024", "{key}/{}/{YYYY": "{key}/{}/{YYYY", "{YYYY--MM}": "{YYYY--MM}", "{DDMMYY}": "050324", "{YYYY MM}": "2024 03"}.items():
        assert spark.range(1).select(expand_template(F.lit(form), at)).first()[0] == want


def test_kinds_of_bytes(spark):
    rows = spark.createDataFrame([(b"PMTiles\x03rest",), (b"SQLite format 3\x00more",), (b"P",), (b"",), (None,)], "content binary")
    assert [r[0] for r in rows.select(kind_of_bytes(F.col("content"))).collect()] == ["pmtiles", "mbtiles", "other", "other", "other"]


def test_limits(spark):
    own, node = F.struct(F.lit(2.0).alias("ratio"), F.lit(0).alias("minutes")), F.struct(F.lit(0.0).alias("ratio"), F.lit(60).alias("minutes"))
    none = F.struct(F.lit(0.0).alias("ratio"), F.lit(-1).alias("minutes"))
    got = spark.range(1).select(*(seeding_limit(a, b, F.lit(f)).alias(k) for k, a, b, f in (("own", own, node, False), ("node", none, node, None), ("none", none, none, False), ("ever", own, node, True)))).first()
    assert (got.own.ratio, got.node.minutes, got.none, got.ever) == (2.0, 60, None, None)


def test_catalogues(spark):
    good = json.dumps({"format": "tile-catalog/1", "archives": [{"infoHash": "aa", "name": "n", "size": 4}]})
    bodies = spark.createDataFrame([("p", good), ("q", json.dumps({"format": "other", "archives": [{"infoHash": "bb"}]})), ("r", None)], "peer string, body string")
    assert [x.infoHash for x in records.catalogue_entries(bodies, "tile-catalog/").collect()] == ["aa"]


def test_registered_functions(spark):
    register_functions(spark)
    a = spark.sql("SELECT * FROM tiles_in_bounds(-10D, -10D, 10D, 10D, 0, 3)")
    from quadrel.operators.tiles import tiles_in_bounds

    b = tiles_in_bounds(spark.createDataFrame([(-10.0, -10.0, 10.0, 10.0)], "west double, south double, east double, north double"), 0, 3).select("z", "x", "y")
    assert sorted(map(tuple, a.collect())) == sorted(map(tuple, b.collect()))
    assert spark.sql("SELECT world_x(0D) AS x, world_y(0D) AS y").first() == (0.5, 0.5)
    places = T.with_places(spark.range(0, 6000, 7).withColumnRenamed("id", "tile_id"))
    places.createOrReplaceTempView("places")
    assert spark.sql("SELECT * FROM places WHERE tile_id(z, x, y) <> tile_id OR tile_zoom(tile_id) <> z OR first_tile_id(z) > tile_id OR tile_parent(z, x, y, 0).x <> x OR tile_column((tile_box(z, x, y).min_x + 1e-9) * 360 - 180, z) <> x").count() == 0
    row = spark.sql("SELECT tile_zoom(-1) AS none, bounds_ok(1, 2, 3, 4) AS ok, bounds_ok(3, 2, 1, 4) AS bad, bucket_seconds(0, 100, 30) AS b, tile_parent(3, 5, 6, 2) AS p, revision(array('a', NULL)) AS r").first()
    assert (row.none, row.ok, row.bad, row.b, tuple(row.p)) == (None, True, False, 3, (1, 1, 1))
    assert row.r == spark.range(1).select(T.revision(F.lit("a"), F.lit(None).cast("string"))).first()[0]


def test_first_ids(spark):
    got = spark.range(8).select(T.tile_id(F.lit(2), F.col("id") % 4, F.floor(F.col("id") / 4).cast("long")).alias("t"), T.zoom_of(F.lit(4).cast("long")).alias("z4"), T.zoom_of(F.lit(5).cast("long")).alias("z5")).collect()
    assert sorted(x.t for x in got) == [5, 6, 7, 8, 17, 18, 19, 20]
    assert (got[0].z4, got[0].z5) == (1, 2)


def test_missing_samples_carry_no_weight(spark):
    px = [None if i == 5 else float(i) for i in range(16)]
    df = spark.createDataFrame([(1, px), (2, [None] * 16)], "tile_id long, px array<double>")
    for kernel in R.KERNELS:
        out = {x.tile_id: x.px for x in R.resample(df, 8, kernel).collect()}
        assert len(out[1]) == 64 and all(v is None for v in out[2])
        assert kernel == "nearest" or all(v is not None for v in out[1])
    blurred = {x.tile_id: x.px for x in R.blur(df, 1.0).collect()}
    assert abs(blurred[1][5] - 5) < 2.5


def test_encoding_is_held_within_24_bits(spark):
    df = spark.createDataFrame([([-20000.0, None, 0.0, 1e9],)], "px array<double>")
    e = df.select(R.encode(F.col("px"), R.FACTORS["mapbox"]).alias("e")).first().e
    assert (e.r[3], e.g[3], e.b[3]) == (255, 255, 255)
    assert (e.r[0], e.r[1], (e.r[2] << 16) + (e.g[2] << 8) + e.b[2]) == (0, 0, 100000)


def test_layers_of_other_widths_and_parents(spark):
    """A 4 x 4 layer and a parent's square meet an 8 x 8 one; nearest pixels are copies of their source's."""
    wide, small = [float(i) for i in range(64)], [float(i) for i in range(16)]
    rows = [(1, 0, wide, 0, 0, 0), (1, 1, small, 0, 0, 0), (2, 0, wide, 1, 1, 0)]
    layers = spark.createDataFrame([(t, k, *(([v / 64 for v in px],) * 3), [1.0] * len(px), 1.0, "normal", *m) for t, k, px, *m in rows], "tile_id long, source_idx int, r array<double>, g array<double>, b array<double>, a array<double>, opacity double, blend string, levels int, sub_x int, sub_y int")
    got = {x.tile_id: [round(v * 64) for v in x.r] for x in R.merge_rgba(layers, 8, [], "nearest").collect()}
    assert got[1] == [i // 8 // 2 * 4 + i % 8 // 2 for i in range(64)]
    assert got[2] == [i // 8 // 2 * 8 + 4 + i % 8 // 2 for i in range(64)]
    heights = spark.createDataFrame([(t, k, px, 0.0, *m) for t, k, px, *m in rows], "tile_id long, source_idx int, px array<double>, adjustment double, levels int, sub_x int, sub_y int")
    assert {x.tile_id: [round(v) for v in x.px] for x in R.merge_elevation(heights, 8, [], "nearest").collect()} == got


def test_modes_and_encodings(spark):
    for mode, want in {"darken": 0.25, "lighten": 0.75, "multiply": 0.1875, "screen": 0.8125, "overlay": 0.375, "normal": 0.75}.items():
        assert spark.range(1).select(R.blended(F.lit(mode), F.lit(0.25), F.lit(0.75))).first()[0] == pytest.approx(want)
    assert R.factors("terrarium") == (256.0, 1.0, 1 / 256, 32768.0) and R.factors("custom", custom=(1, 2, 3, 4)) == (1, 2, 3, 4)
    assert R.factors("mapbox", interval=0.5, base=-100.0) == pytest.approx((32768, 128, 0.5, 100))
    df = spark.createDataFrame([([100.0, None, -50.5],)], "px array<double>")
    for f in (R.factors("terrarium"), R.factors("mapbox", interval=0.5, base=-100.0)):
        e = df.select(R.encode(F.col("px"), f).alias("e")).select("e.*").select(R.decode(F.col("r"), F.col("g"), F.col("b"), f).alias("px")).first().px
        assert e[0] == pytest.approx(100.0) and e[2] == pytest.approx(-50.5)


def test_bake_of_nothing_is_an_error(spark, tmp_path):
    from quadrel.operators import stack

    with pytest.raises(ValueError, match="no tile"):
        stack.bake(spark.createDataFrame([], "tile_id long, content binary"), F.col("content"), str(tmp_path / "none.pmtiles"))
