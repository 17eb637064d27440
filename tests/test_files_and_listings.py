"""Files that tasks write, folders of tile databases, and listings by their own clock."""

import sqlite3
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from quadrel.sources import files, mbtiles
from quadrel.streaming import streams


def test_files_by_name(spark, tmp_path):
    rows = spark.createDataFrame([("a.json", "{}"), ("ü b.txt", None), ("a.json", "{}")], "name string, content string")
    assert files.write_files(rows, str(tmp_path / "f")) == 2
    assert {p.name: p.read_text() for p in (tmp_path / "f").iterdir()} == {"a.json": "{}", "ü b.txt": ""}
    assert files.write_files(rows.filter("name = 'a.json'").withColumn("content", F.lit("[]")), str(tmp_path / "f")) == 1
    assert (tmp_path / "f/a.json").read_text() == "[]"
    assert files.write_files(rows.limit(0), str(tmp_path / "none")) == 0


@pytest.mark.parametrize("name", ["../up", ".hidden", "", None])
def test_names_that_are_no_files(spark, tmp_path, name):
    with pytest.raises(Exception, match="not a file's name"):
        files.write_files(spark.createDataFrame([(name, "x")], "name string, content string"), str(tmp_path / "f"))


def test_folder_of_databases(spark, tmp_path):
    folder = str(tmp_path / "dbs with space #1")
    z = F.lit(9)
    tiles = spark.range(3000).select(F.concat(F.lit("d"), (F.col("id") % 3).cast("string"), F.lit(".mbtiles")).alias("database"), z.alias("z"), (F.col("id") % 512).alias("x"), F.floor(F.col("id") / 512).alias("y"), F.col("id").cast("string").alias("content"))
    empty = tiles.filter("x = 7 and y = 0").select("database", F.lit(3).alias("z"), F.lit(0).alias("x"), F.lit(0).alias("y"), F.lit(None).cast("string").alias("content"))
    tiles = tiles.unionByName(empty)
    meta = spark.createDataFrame([("d0.mbtiles", "minzoom", "2"), ("d0.mbtiles", "maxzoom", "many"), ("bare.mbtiles", "maxzoom", "4"), ("d2.mbtiles", "name", None)], "database string, name string, value string")
    for _ in range(2):  # what is written again replaces what was there
        assert mbtiles.write_databases(tiles, folder, meta) == 4
    got = mbtiles.scan_folder(spark, folder, tiles=100, files=1, tasks=5).withColumn("content", F.col("content").cast("string"))
    want = tiles.select("database", "z", F.col("x").cast("long").alias("x"), F.col("y").cast("long").alias("y"), "content")
    assert got.exceptAll(want).count() == 0 and want.exceptAll(got).count() == 0
    parts = mbtiles.folder_ranges(spark, folder, tiles=100)
    assert parts.agg(F.sum("tiles")).first()[0] == tiles.count() and parts.filter("tiles > 100").count() == 0
    assert parts.filter("path like '%d0.mbtiles' and z = 9").count() <= 2 * (1000 // 100 + 1)
    one = mbtiles.scan(spark, f"{folder}/d1.mbtiles")
    assert one.count() == want.filter("database = 'd1.mbtiles'").count()
    with sqlite3.connect(f"{folder}/d0.mbtiles") as db:  # rows count from the south in the format
        assert db.execute("SELECT tile_row FROM tiles WHERE zoom_level = 9 AND tile_column = 0 AND CAST(tile_data AS TEXT) = '0'").fetchone() == (511,)
    ranges = {r.database: (r.min_zoom, r.max_zoom) for r in mbtiles.zoom_ranges(mbtiles.folder_metadata(spark, folder), got).collect()}
    low = {r.database for r in empty.collect()}
    assert ranges == {"d0.mbtiles": (2, 9), "d1.mbtiles": (3 if "d1.mbtiles" in low else 9, 9), "d2.mbtiles": (3 if "d2.mbtiles" in low else 9, 9), "bare.mbtiles": (None, 4)}


def test_no_databases(spark, tmp_path):
    (tmp_path / "e").mkdir()
    assert mbtiles.scan_folder(spark, str(tmp_path / "e")).count() == 0
    assert mbtiles.folder_metadata(spark, str(tmp_path / "e")).count() == 0


def test_large_contents_come_in_batches(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(mbtiles, "BATCH_BYTES", 1000)
    tiles = spark.range(50).select(F.lit("big.mbtiles").alias("database"), F.lit(8).alias("z"), "id", (F.col("id") % 7).alias("y"), F.repeat(F.lit("x"), 400).alias("content")).withColumnRenamed("id", "x")
    mbtiles.write_databases(tiles, str(tmp_path / "b"))
    assert mbtiles.scan_folder(spark, str(tmp_path / "b")).agg(F.count("content"), F.sum(F.length("content"))).first()[:] == (50, 20000)


T0 = datetime(2024, 1, 1)


def _settled(spark, tmp_path, triggers, seconds=60):
    """Listings (path, seconds, length, modified) by trigger, through stood_still."""
    for i, rows in enumerate(triggers):
        at = lambda t: None if t is None else T0 + timedelta(seconds=t)
        frame = spark.createDataFrame([(p, at(t), n, at(m)) for p, t, n, m in rows], "path string, at timestamp, length long, modified timestamp").coalesce(1)
        frame.write.mode("append").parquet(str(tmp_path / f"in/t={i}"))
    schema = "path string, at timestamp, length long, modified timestamp"
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).option("latestFirst", False).parquet(str(tmp_path / "in/t=*"))
    out = streams.drained(streams.stood_still(stream, seconds, late="0 seconds"))
    return sorted((r.path, r.length) for r in out.collect())


def test_files_that_stood_still(spark, tmp_path):
    got = _settled(
        spark,
        tmp_path,
        [
            [("grows", 0, 1, 0), ("still", 0, 5, 0), ("once", 0, 9, 0), ("touched", 0, 3, 0), (None, 0, 1, 0), ("odd", 0, None, 0), ("odd", 0, 1, None)],
            [("grows", 30, 2, 30), ("still", 30, 5, 0), ("touched", 30, 3, 30)],
            [("grows", 65, 3, 60), ("still", 65, 5, 0), ("touched", 80, 3, 30), ("late", 100, 1, 100)],
            [("grows", 130, 3, 60), ("touched", 85, 4, 80), ("still", 130, 6, 125), ("late", 130, 2, 130)],
        ],
    )
    # grows: the third length from 65 to 130; still: at 65, once, whatever comes later; once: by the watermark; touched: never for 60 seconds together; late: not yet
    assert got == [("grows", 3), ("once", 9), ("still", 5)]


def test_listings_of_one_trigger_in_any_order(spark, tmp_path):
    rows = [("a", t, n, 0) for t, n in ((90, 2), (0, 1), (61, 2), (30, 1), (10, 1), (130, 2))]
    assert _settled(spark, tmp_path, [rows]) == [("a", 1)]  # 1 stood from 0 until the change seen at 61
