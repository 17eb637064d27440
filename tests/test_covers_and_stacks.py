"""Covers and runs against tiles one by one; stack answers by hand; small additions."""

import json

import numpy as np
import pytest
from pyspark.sql import functions as F

from quadrel.functions import register
from quadrel.functions import tiles as T
from quadrel.operators import catalog as C
from quadrel.operators import clip, cover, pieces, runs
from quadrel.operators import raster as R
from quadrel.operators import stack as ST
from quadrel.operators import tiles as O
from quadrel.sources import records

# Runs


def tiles_of(rows):
    return {i for a, n in rows for i in range(a, a + n)}


def merged(ids):
    out = []
    for i in sorted(ids):
        if out and out[-1][0] + out[-1][1] == i:
            out[-1][1] += 1
        else:
            out.append([i, 1])
    return [tuple(x) for x in out]


def test_runs_against_sets(spark):
    rng = np.random.default_rng(3)
    rows = [(int(k % 3), int(rng.integers(0, 3000)), int(rng.choice([1, 2, 40, 700]))) for k in range(120)] + [(0, 5000, 0)]
    entries = spark.createDataFrame(rows, "source_idx int, tile_id long, run_length long")
    by = {k: tiles_of((a, n) for s, a, n in rows if s == k) for k in range(3)}
    for bits in (4, 20):
        assert sorted(tuple(r) for r in runs.union_runs(entries, bits=bits).collect()) == merged(set.union(*by.values()))
        each = sorted((r.source_idx, r.tile_id, r.run_length) for r in runs.union_runs(entries, ["source_idx"], bits).collect())
        assert each == [(k, *x) for k in range(3) for x in merged(by[k])]
        got = {h: sorted((r.tile_id, r.run_length) for r in runs.overlap_runs(entries, 0, 1, bits).collect() if r.held_by == h) for h in ("both", "first")}
        assert got == {"both": merged(by[0] & by[1]), "first": merged(by[0] - by[1])}
        report = {r.z: (r.total, r.hits, r.misses) for r in runs.warm_runs(entries.filter("source_idx = 2"), entries.filter("source_idx = 0"), bits).collect()}
        zoom = lambda i: next(z for z in range(20) if i < (4 ** (z + 1) - 1) // 3)
        want = {z: (len(w := [i for i in by[2] if zoom(i) == z]), len([i for i in w if i in by[0]]), len([i for i in w if i not in by[0]])) for z in {zoom(i) for i in by[2]}}
        assert report == want
    assert runs.union_runs(entries.limit(0)).count() == 0


def test_a_planet_of_runs_is_a_few_rows(spark):
    """5.7 G tiles to zoom 16 as one run an archive."""
    whole = (4**17 - 1) // 3
    entries = spark.createDataFrame([(0, 0, whole), (1, 10**9, 10**9)], "source_idx int, tile_id long, run_length long")
    assert [tuple(r) for r in runs.union_runs(entries).collect()] == [(0, whole)]
    got = sorted(tuple(r) for r in runs.overlap_runs(entries, 0, 1).select("tile_id", "run_length", "held_by").collect())
    assert got == [(0, 10**9, "first"), (10**9, 10**9, "both"), (2 * 10**9, whole - 2 * 10**9, "first")]


# Covers


def test_rectangles_as_runs():
    rng = np.random.default_rng(5)
    for z in (0, 1, 3, 5):
        n = 1 << z
        a, b = np.sort(rng.integers(0, n, (20, 2)), axis=1).T, np.sort(rng.integers(0, n, (20, 2)), axis=1).T
        of, first, count = cover.rectangle_runs(z, a[0], a[1], b[0], b[1])
        x, y = (v.ravel() for v in np.meshgrid(np.arange(n), np.arange(n)))
        at = cover.curve(z, x, y)
        assert sorted(at.tolist()) == list(range(n * n))
        for k in range(20):
            inside = (x >= a[0][k]) & (x <= a[1][k]) & (y >= b[0][k]) & (y <= b[1][k])
            assert list(zip(first[of == k].tolist(), count[of == k].tolist())) == merged(at[inside].tolist())
    of, first, count = cover.rectangle_runs(16, *(np.array([v]) for v in (1000, 40000, 2000, 50000)))
    assert count.sum() == 39001 * 48001 and len(of) < 200_000


def test_box_runs_against_tiles(spark):
    boxes = spark.createDataFrame([(1, -10.0, 40.0, 30.0, 60.0), (2, -180.0, -85.0, 180.0, 85.0), (3, 10.0, 10.0, 10.0, 10.0)], "box int, west double, south double, east double, north double")
    want = O.tiles_in_bounds(boxes, 0, 5).select("box", T.tile_id(F.col("z"), F.col("x"), F.col("y")).alias("t"))
    got = cover.box_runs(boxes, 0, 5).select("box", F.explode(F.sequence("tile_id", F.col("tile_id") + F.col("run_length") - 1)).alias("t"))
    assert got.exceptAll(want).count() == 0 == want.exceptAll(got).count()
    assert cover.box_runs(boxes, 0, 5).filter("box = 2").count() == 6


def test_united_rectangles():
    rng = np.random.default_rng(6)
    for z, many in ((0, 3), (1, 4), (3, 10), (5, 1), (5, 60), (7, 400)):
        n = 1 << z
        for size in (1, 3, n):
            a, b = rng.integers(0, n, many), rng.integers(0, n, many)
            a1, b1 = np.minimum(a + rng.integers(0, size, many), n - 1), np.minimum(b + rng.integers(0, size, many), n - 1)
            first, count = cover.united_rectangles(z, a, a1, b, b1)
            x, y = (v.ravel() for v in np.meshgrid(np.arange(n), np.arange(n)))
            held = np.zeros(n * n, bool)
            for k in range(many):
                held |= (x >= a[k]) & (x <= a1[k]) & (y >= b[k]) & (y <= b1[k])
            assert list(zip(first.tolist(), count.tolist())) == merged(cover.curve(z, x[held], y[held]).tolist())
    for z in (14, 16, 18):  # sides that fit in one number at all levels, at some, at few
        sides = [np.array(v) << (z - 14) for v in ([1000, 1000, 30], [1900, 1100, 50], [2000, 2000, 40], [2500, 2900, 41])]
        first, count = cover.united_rectangles(z, *sides)
        of, at, n = cover.rectangle_runs(z, *sides)
        spans = np.concatenate([np.stack([at, np.ones_like(at)]), np.stack([at + n, -np.ones_like(at)])], axis=1)
        spans = spans[:, np.lexsort((-spans[1], spans[0]))]
        depth = np.cumsum(spans[1])
        stops = np.flatnonzero(depth == 0)
        starts = np.concatenate([[0], stops[:-1] + 1])
        assert first.tolist() == spans[0][starts].tolist() and (first + count).tolist() == spans[0][stops].tolist()


BOXES = "box int, west double, south double, east double, north double"


def test_boxes_united_against_tiles(spark):
    rng = np.random.default_rng(7)
    rows = [(-10.0, 40.0, 30.0, 60.0), (10.0, 10.0, 10.0, 10.0), (170.0, 0.0, -170.0, 5.0), (20.0, 5.0, 19.0, 6.0), (5.0, 50.0, 6.0, 49.0), (100.0, -89.0, 400.0, -80.0), (-500.0, 84.0, -179.0, 95.0), (179.9999, 1.0, 180.0, 1.5), (None, 3.0, 50.0, 4.0), (-60.0, None, -59.0, -30.0), (float("nan"), -20.0, -175.0, -19.0), (0.0, float("-inf"), 0.1, -84.9)]
    rows += [(float(w), float(s), float(w + a), float(s + b)) for w, s, a, b in zip(rng.uniform(-180, 180, 300), rng.uniform(-85, 85, 300), rng.exponential(2, 300), rng.exponential(2, 300))]
    boxes = spark.createDataFrame([(i, *r) for i, r in enumerate(rows * 3)], BOXES).repartition(3)
    for low, high in ((0, 7), (3, 3), (2, 9)):
        tiles = O.tiles_in_bounds(boxes, low, high).select(T.tile_id(F.col("z"), F.col("x"), F.col("y")).alias("t")).distinct()
        want = merged([r.t for r in tiles.collect()])
        assert sorted(tuple(r) for r in cover.boxes_union(boxes, low, high).select("tile_id", "run_length").collect()) == want
    assert cover.boxes_union(boxes.filter("false"), 0, 3).count() == 0


def test_copies_of_boxes_are_not_shuffled(spark, sf_dir, tmp_path):
    """The query sends what its boxes cover, not each box's runs: orders of the same boxes add no rows to its shuffles."""
    from quadrel.plans import queries

    def shuffled(folder):
        sc = spark.sparkContext._jsc.sc()
        stages = lambda: sc.statusStore().stageList(None, False, False, spark.sparkContext._gateway.new_array(spark._jvm.double, 0), None)
        sc.listenerBus().waitUntilEmpty()
        before = max((stages().apply(i).stageId() for i in range(stages().size())), default=-1)
        rows = sorted(tuple(r) for r in queries()["tiles_in_bounds_runs"](spark, str(folder)).collect())
        sc.listenerBus().waitUntilEmpty()
        after = stages()
        return rows, sum(s.shuffleWriteRecords() for s in map(after.apply, range(after.size())) if s.stageId() > before)

    orders = spark.read.parquet(f"{sf_dir}/orders.parquet").limit(50).coalesce(1)
    orders.write.parquet(str(tmp_path / "once" / "orders.parquet"))
    copies = orders.crossJoin(spark.range(40)).withColumn("o_orderkey", F.col("o_orderkey") + F.col("id") * 1009).drop("id")
    copies.coalesce(1).write.parquet(str(tmp_path / "copies" / "orders.parquet"))
    once, sent = shuffled(tmp_path / "once")
    again, sent_again = shuffled(tmp_path / "copies")
    assert once == again and once
    assert sent_again <= 2 * sent


SHAPES = {
    "star": [[(-60 + 40 * np.cos(a) * r, 20 + 25 * np.sin(a) * r) for a, r in zip(np.linspace(0, 2 * np.pi, 25)[:-1], [1, 0.4] * 12)]],
    "ring": [[(20.0, -40.0), (90.0, -40.0), (90.0, 10.0), (20.0, 10.0)], [(40.0, -30.0), (70.0, -30.0), (70.0, 0.0), (40.0, 0.0)]],
}


def test_covers_against_tiles_one_by_one(spark):
    points = [(n, k, i, float(x), float(y)) for n, rings in SHAPES.items() for k, ring in enumerate(rings) for i, (x, y) in enumerate(ring)]
    segs = clip.segments(spark.createDataFrame(points, "shape string, ring int, i int, lon double, lat double"))
    tiles = T.with_places(spark.range(0, 1365).select(F.col("id").alias("tile_id")))  # all to zoom 5
    want = clip.classify(tiles, segs)
    for cells in (1, 300, 20_000):
        got = cover.classify(tiles, segs, cells)
        assert got.exceptAll(want).count() == 0 == want.exceptAll(got).count()


# Stacks

GRID = "source_idx int, tile_id long, px array<double>"
RECIPE = "source_idx int, cutline string, adjustment double"


def places(spark, rows):
    return T.with_places(spark.createDataFrame(rows, "source_idx int, tile_id long"))


def test_only_squares_of_parents_are_blurred(spark):
    steps = [float(i % 8 > 3) * 100 for i in range(64)]
    layers = spark.createDataFrame([(1, 0, steps, 0.0, 0, 0, 0), (2, 0, steps, 0.0, 1, 0, 0), (3, 0, steps, 0.0, 2, 1, 1)], "tile_id long, source_idx int, px array<double>, adjustment double, levels int, sub_x int, sub_y int")
    got = {r.tile_id: r.px for r in R.merge_elevation(layers, 8, [], "bilinear", 1.0).collect()}
    hard = {r.tile_id: r.px for r in R.merge_elevation(layers, 8, [], "bilinear", 0.0).collect()}
    assert got[1] == steps and got[2] != hard[2]
    spread = lambda px: max(abs(px[i + 1] - px[i]) for i in range(7))
    assert spread(got[3]) < spread(hard[3])


def test_masks_of_each_source(spark):
    rows = [
        (1, 0, [5.0, 7.0, 9.0, 11.0], [99.0], [0], 0.0, [1, 1, 1, 1], [0] * 4, [0] * 4),
        (1, 1, [5.0, 7.0, 9.0, 11.0], [7.0], [R.color("#020000")], 0.5, [1, 1, 2, 1], [0] * 4, [0] * 4),
        (1, 2, [5.0, 7.0, 9.0, 11.0], [5.0, 7.0, 9.0], None, 1.0, [1, 1, 1, 1], [0] * 4, [0] * 4),
    ]
    layers = spark.createDataFrame(rows, "tile_id long, source_idx int, px array<double>, values array<double>, colors array<long>, adjustment double, r array<int>, g array<int>, b array<int>")
    assert [r.px for r in R.merge_elevation(layers, 2).collect()] == [[5.5, 7.0, 9.0, 12.0]]


def test_children_stand_in_only_as_a_whole(spark):
    ids = [(0, 0)] + [(0, t) for t in range(1, 5)] + [(1, 0)] + [(1, t) for t in range(1, 4)]
    held = places(spark, ids).withColumn("width", F.lit(2))
    grids = spark.createDataFrame([(k, t, [float(10 * k + t)] * 4) for k, t in ids], GRID)
    wanted = T.with_places(spark.createDataFrame([(0,)], "tile_id long"))
    one = lambda k, h=held: ST.stack_answer(wanted, h, grids, spark.createDataFrame([(k, None, 0.0)], RECIPE), 4, "elevation", kernel="nearest", sized=True).first()
    assert sorted(set(one(0).px)) == [1.0, 2.0, 3.0, 4.0] and not one(0).copied
    at = {(r.x, r.y): r.tile_id for r in held.filter("source_idx = 0 and z = 1").collect()}
    assert one(0).px == [float(at[c // 2, r // 2]) for r in range(4) for c in range(4)]
    assert set(one(1).px) == {10.0}
    assert set(one(0, held.withColumn("broken", F.col("tile_id") == 3)).px) == {0.0}  # one child can't be read


def test_required_sources_fail_a_tile_and_others_are_left_out(spark):
    held = places(spark, [(0, 1), (1, 1), (0, 2), (1, 2), (1, 3)]).withColumn("broken", ((F.col("tile_id") == 1) & (F.col("source_idx") == 1)) | ((F.col("tile_id") == 2) & (F.col("source_idx") == 0)))
    grids = spark.createDataFrame([(k, t, [float(10 * k + t)] * 4) for k in (0, 1) for t in (1, 2, 3)], GRID)
    wanted = T.with_places(spark.createDataFrame([(1,), (2,), (3,)], "tile_id long"))
    recipe = spark.createDataFrame([(0, None, True), (1, None, False)], "source_idx int, cutline string, required boolean")
    got = {r.tile_id: (r.copied, r.px[0]) for r in ST.stack_answer(wanted, held, grids, recipe, 2, "elevation").collect()}
    assert got == {1: (False, 1.0), 3: (True, 13.0)}  # beside an error nothing is copied
    reads, _ = ST.stack_reads(wanted, held, recipe)
    assert [tuple(r) for r in ST.failures(reads).collect()] == [(2, 0)]
    assert sorted(tuple(r) for r in ST.contributors(reads).collect()) == [(1, 0, "own"), (1, 1, "error"), (2, 0, "error"), (2, 1, "own"), (3, 1, "own")]


def test_what_keeps_a_tile_from_being_copied(spark):
    held = places(spark, [(0, 1)]).withColumn("width", F.lit(2))
    grids = spark.createDataFrame([(0, 1, [1.0] * 4, *([[9] * 4] * 3))], f"{GRID}, r array<int>, g array<int>, b array<int>")
    wanted = T.with_places(spark.createDataFrame([(1,)], "tile_id long"))

    def copied(row=None, output=None, **more):
        kinds = {"adjustment": "double", "opacity": "double", "blend": "string", "values": "array<double>", "colors": "array<long>", "encoding": "string", "format": "string"}
        row = row or {}
        recipe = spark.createDataFrame([(0, None, *row.values())], ", ".join(["source_idx int, cutline string", *(f"{k} {kinds[k]}" for k in row)]))
        return ST.stack_answer(wanted, held, grids, recipe, 2, "elevation", output=output, **more).first().copied

    assert copied() and copied({"adjustment": 0.0, "opacity": 1.0, "blend": "normal", "values": []}) and copied({"encoding": "mapbox", "format": "png"}, {"encoding": "mapbox", "format": "png"}) and copied({"adjustment": None})
    for row, output in (({"adjustment": 1.0}, None), ({"opacity": 0.5}, None), ({"blend": "screen"}, None), ({"values": [0.0]}, None), ({"colors": [1]}, None), ({"encoding": "mapbox"}, {"encoding": "terrarium"}), ({"format": "png"}, {"format": "webp"}), ({}, {"nodata": 0.0}), ({}, {"alpha": False})):
        assert not copied(row, output)
    assert not copied(sigma=1.0) and not copied(sized=True)


def test_bounds_clip_like_a_shape(spark):
    box = {"west": -90.0, "south": 0.0, "east": 0.0, "north": 66.5}
    recipe = spark.createDataFrame([(0, None, box), (1, None, None)], "source_idx int, cutline string, bounds struct<west:double,south:double,east:double,north:double>")
    named, shapes = ST.shapes_of(recipe, None)
    assert {r.source_idx: r.cutline for r in named.collect()} == {0: "bounds:0", 1: None} and shapes.count() == 4
    held = places(spark, [(0, 0), (1, 0)])
    grids = spark.createDataFrame([(0, 0, [1.0] * 64), (1, 0, [0.0] * 64)], GRID)
    px = ST.stack_answer(T.with_places(spark.createDataFrame([(0,)], "tile_id long")), held, grids, recipe.filter("source_idx = 0"), 8, "elevation").first().px
    assert {i for i, v in enumerate(px) if v is not None} == {r * 8 + c for r in (2, 3) for c in (2, 3)}


# Small additions


def test_places_of_ids_in_sql(spark):
    register.register_functions(spark)
    ids = [0, 1, 4, 5, 20, 21, 84, 12345, 10**9, 4**20]
    frame = spark.createDataFrame([(i,) for i in ids], "tile_id long")
    frame.createOrReplaceTempView("ids")
    want = {r.tile_id: (r.z, r.x, r.y) for r in T.with_places(frame).collect()}
    assert {r.tile_id: (r.z, r.x, r.y) for r in spark.sql("SELECT tile_id, tile_z(tile_id) AS z, tile_x(tile_id) AS x, tile_y(tile_id) AS y FROM ids").collect()} == want
    assert all(r.same for r in spark.sql("SELECT tile_id(p.z, p.x, p.y) = tile_id AS same FROM (SELECT tile_id, tile_place(tile_id) AS p FROM ids)").collect())
    assert spark.sql("SELECT tile_x(-1L) AS x").first().x is None


def test_offset_days_of_dated_sources(spark):
    sources = spark.createDataFrame([("a", -1), ("b", None), ("c", 2)], "source string, offset_days int")
    held = spark.createDataFrame([("a", "2024-01-08")], "source string, date string").withColumn("date", F.to_date("date"))
    got = C.expected_builds(sources, held, F.lit("2024-01-10").cast("date"), 3, 9).select("source", F.date_format("date", "dd").alias("d")).collect()
    assert sorted(tuple(r) for r in got) == [("a", "09"), ("b", "08"), ("b", "09"), ("b", "10"), ("c", "10"), ("c", "11"), ("c", "12")]


def test_catalogue_export(spark):
    rows = [(1, "a", 10, ["Planet"], True), (2, "b", 20, ["sea"], None), (3, "c", 30, ["planet"], False)]
    catalog = spark.createDataFrame(rows, "info_hash long, name string, size long, categories array<string>, published boolean")
    for category, want in ((None, [1, 2]), ("PLANET", [1]), ("none", [])):
        lines = [json.loads(r.value) for r in records.catalogue_export(catalog, "own/2", category).orderBy("nth").collect()]
        assert lines[0] == {"format": "own/2", "count": len(want)} and sorted(int(x["infoHash"]) for x in lines[1:]) == want


def test_deep_collections_are_errors_and_not_lost(spark):
    ring = [[[0, 0], [10, 0], [10, 10], [0, 0]]]

    def nested(depth):
        g = {"type": "Polygon", "coordinates": ring}
        for _ in range(depth):
            g = {"type": "GeometryCollection", "geometries": [{"type": "Polygon", "coordinates": ring}, g]}
        return g

    def count(value):
        return records.shape_segments(spark.createDataFrame([("s", json.dumps(value))], "shape string, value string")).count()

    for depth in range(5):
        assert count(nested(depth)) == 3 * (depth + 1)
    with pytest.raises(Exception, match="too deep"):
        count(nested(6))
    deep = {"type": "Feature", "geometry": nested(0)}
    for _ in range(7):
        deep = {"type": "FeatureCollection", "features": [deep]}
    with pytest.raises(Exception, match="too deep"):
        count(deep)


def test_sampled_pieces_are_read_by_range(spark, tmp_path):
    (tmp_path / "a").write_bytes(b"".join(bytes([k]) * 10 for k in range(20)))
    (tmp_path / "b").write_bytes(b"x" * 55)
    expected = spark.createDataFrame([("a", k, 10) for k in range(20)] + [("b", k, 10) for k in range(7)] + [("c", 0, 10)], "key string, piece int, length int")
    expected = expected.withColumn("sha1", F.sha1(F.concat(*([F.expr("unhex(lpad(hex(piece), 2, '0'))")] * 10))))
    claims = expected.select("key", "piece", ~((F.col("key") == "a") & F.col("piece").isin(7, 9)) | (F.col("key") == "z")).toDF("key", "piece", "held")
    wanted = pieces.sampled_pieces(expected, claims)
    assert sorted((r.key, r.piece) for r in wanted.collect()) == [("a", 0), ("a", 7), ("a", 9), ("b", 0), ("b", 3), ("b", 6), ("c", 0)]
    read = pieces.read_pieces(wanted.withColumn("path", F.concat(F.lit(f"{tmp_path}/"), "key")), 10)
    assert {r.key: (r.checked, r.passed) for r in pieces.sample_verified(wanted, read).collect()} == {"a": (3, 3), "b": (2, 0), "c": (0, 0)}
