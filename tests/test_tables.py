"""Stored parts, histories, buckets, resumed bakes, archives that tasks write, watched folders: what is committed, what comes again, what is left alone."""

import os
import time

import pytest
from pyspark.sql import functions as F

from quadrel.operators import stack as ST
from quadrel.sources import pmtiles as Z
from quadrel.sources import tables as H
from quadrel.sources import watch as W

ROCKS = {"spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"}


def files_of(path):
    return {os.path.join(at, n): os.path.getmtime(os.path.join(at, n)) for at, _, names in os.walk(path) for n in names if n.endswith(".parquet")}


def test_parts_are_written_once(spark, tmp_path):
    parts = H.Parts(spark, str(tmp_path / "p"), "id long")
    assert parts.rows().count() == 0 and parts.put("a", spark.range(3)) and not parts.put("a", spark.range(9))
    broken = spark.range(4).select(F.when(F.col("id") > 2, F.raise_error(F.lit("broken")).cast("long")).otherwise(F.col("id")).alias("id"))
    with pytest.raises(Exception, match="broken"):
        parts.put("b", broken)
    assert parts.names() == ["a"] and parts.rows().count() == 3
    assert parts.put("b", spark.range(2)) and sorted(r.id for r in parts.rows().collect()) == [0, 0, 1, 1, 2]
    with pytest.raises(ValueError, match="name"):
        parts.put("../x", spark.range(1))
    parts.clear()
    assert parts.rows().count() == 0


def baked(spark, folder, wanted, asked, **more):
    def answers(part):
        asked.append(sorted(r.tile_id for r in part.collect()))
        return part.filter("tile_id % 7 <> 0").withColumn("content", F.concat(F.lit("t"), F.floor(F.col("tile_id") / 3).cast("string")))

    return ST.bake_on(wanted, answers, F.col("content"), str(folder), **more)


def test_resumed_bake_equals_a_whole_one(spark, tmp_path):
    """Ranges hold whole cells of 4096 ids; no finished one is answered again."""
    wanted = spark.range(0, 60_000, 3).select(F.col("id").alias("tile_id"))
    asked, whole = [], []
    _, left = baked(spark, tmp_path / "w", wanted, asked, rev="r1", tiles=3000, most=3)
    assert len(asked) == 3 and left > 0
    first = files_of(tmp_path / "w")
    with pytest.raises(Exception, match="stop"):  # broken off within a range
        ST.bake_on(wanted, lambda part: part.withColumn("content", F.raise_error(F.lit("stop")).cast("string")), F.col("content"), str(tmp_path / "w"), "r1", 3000)
    parts, left = baked(spark, tmp_path / "w", wanted, asked, rev="r1", tiles=3000)
    assert left == 0 and sorted(sum(asked, [])) == list(range(0, 60_000, 3)) and len(asked) > 4
    assert first.items() <= files_of(tmp_path / "w").items()
    again = []
    assert baked(spark, tmp_path / "w", wanted, again, rev="r1", tiles=3000)[1] == 0 and not again
    assert baked(spark, tmp_path / "w", wanted, [], rev="r2", tiles=3000, most=1)[1] > 0  # another revision starts anew
    one, _ = baked(spark, tmp_path / "v", wanted, whole, rev="r1", tiles=10**9)
    assert len(whole) == 1
    held = []
    for name, p in (("a", parts), ("b", one)):
        report = ST.bake_parts(p, str(tmp_path / f"{name}.pmtiles"), metadata={"name": "x"})
        assert report["addressed"] == 20_000 - len(range(0, 60_000, 21)) and p.names() == []
        entries = Z.scan(spark, str(tmp_path / f"{name}.pmtiles"))
        held.append(sorted((r.tile_id, r.run_length, bytes(r.content)) for r in Z.read_tiles(entries, str(tmp_path)).collect()))
    assert held[0] == held[1]


def test_tasks_write_an_archive_with_leaves(spark, tmp_path):
    tiles = spark.range(0, 40_000, 2).select(F.col("id").alias("tile_id"), F.sha2(F.col("id").cast("string"), 256).alias("content"))
    report = Z.write_archive(tiles, str(tmp_path / "all.pmtiles"))
    assert report["entries"] == 20_000 and sorted(os.listdir(tmp_path)) == ["all.pmtiles", "all.pmtiles.parts"]
    got = Z.read_tiles(Z.scan(spark, str(tmp_path)), str(tmp_path)).select("tile_id", F.col("content").cast("string").alias("content"))
    assert got.exceptAll(tiles).count() == 0 == tiles.exceptAll(got).count()
    with open(tmp_path / "all.pmtiles", "rb") as f:
        assert Z.read_header(f)["leaf_length"] > 0


def test_scan_in_two_stages_equals_the_other(spark, tmp_path):
    for k in range(3):
        tiles = spark.range(0, 6000 if k == 1 else 300, k + 1).select(F.col("id").alias("tile_id"), F.sha2(F.col("id").cast("string"), 256).alias("content"))
        Z.write_archive(tiles, str(tmp_path / f"{k}.pmtiles"))
    whole = Z.scan(spark, str(tmp_path))
    for bounds in ({}, {"low": 500, "high": 5000}, {"low": 10**9}):
        low, high = bounds.get("low", 0), bounds.get("high", 1 << 62)
        got, want = Z.scan_folder(spark, str(tmp_path), files=2, **bounds), whole.filter((F.col("tile_id") <= high) & (F.col("tile_id") + F.col("run_length") > low))
        assert got.exceptAll(want).count() == 0 == want.exceptAll(got).count()
    empty = tmp_path / "none"
    empty.mkdir()
    assert Z.scan_folder(spark, str(empty)).count() == 0


def test_history(spark, tmp_path):
    schema = "info_hash long, at long, down long, up long"
    history = H.History(spark, str(tmp_path / "h"), schema)
    assert history.rows().count() == 0 and history.prune(0) == []
    rows = [(1, 3600 * h + 15 * k, h, k) for h in range(5) for k in range(4)]
    a, b = spark.createDataFrame(rows[:10], schema), spark.createDataFrame(rows[10:], schema)
    history.append(a, 0)
    history.append(b, 1)
    before = files_of(tmp_path / "h")
    history.append(b, 1)
    assert files_of(tmp_path / "h") == before and sorted(map(tuple, history.rows().collect())) == rows
    history.folder.drop("hour=3")  # as if the second trigger had been broken off between its hours
    history.append(b, 1)
    assert sorted(map(tuple, history.rows().collect())) == rows
    assert history.prune(3600 * 2 + 20) == ["hour=0", "hour=1"] and history.prune(50) == []
    assert sorted(map(tuple, history.rows().collect())) == [r for r in rows if r[1] >= 3600 * 2 + 20]
    assert not [f for f in files_of(tmp_path / "h") if "hour=0" in f or "hour=1/" in f]


def test_buckets(spark, tmp_path):
    schema = "k long, v string"
    store = H.Buckets(spark, str(tmp_path / "b"), schema, "k", 8)
    newest = lambda old, new: new.unionByName(old.join(new, "k", "left_anti"))
    assert store.rows().count() == 0
    store.merge("one", spark.range(100).select(F.col("id").alias("k"), F.lit("a").alias("v")), newest)
    before = files_of(tmp_path / "b")
    wrote = store.merge("two", spark.createDataFrame([(5, "b")], schema), newest)
    assert len(wrote) == 1 and before.items() <= files_of(tmp_path / "b").items()
    assert {r.k: r.v for r in store.rows().collect()} == {k: "b" if k == 5 else "a" for k in range(100)}
    after = files_of(tmp_path / "b")
    assert store.merge("two", spark.createDataFrame([(6, "c")], schema), newest) == [] and files_of(tmp_path / "b") == after
    with pytest.raises(Exception, match="stop"):
        store.merge("three", spark.createDataFrame([(7, "d")], schema), lambda old, new: new.withColumn("v", F.raise_error(F.lit("stop")).cast("string")))
    assert store.rows().filter("v = 'd'").count() == 0
    assert store.merge("none", spark.createDataFrame([], schema), newest) == [] and store.rows().count() == 100
    for k in range(3):
        store.merge(f"more-{k}", spark.createDataFrame([(5, f"n{k}")], schema), newest)
    assert store.rows().filter("k = 5").first().v == "n2" and len(store.folder.names(wrote[0])) == 2


def test_rules_of_folders(spark):
    rules = [{"folder": "/in/", "name": "planet", "match": "planet-*.pmtiles", "latest": "/x/planet-latest.pmtiles"}, {"folder": "/in", "name": "rest"}, {"folder": "/other", "name": "other", "match": "?.pmtiles"}]
    rows = [("/in", "/in/planet-1.pmtiles", "planet"), ("/in", "/in/planet-latest.pmtiles", "rest"), ("/in", "/in/sub/b.pmtiles", "rest"), ("/other", "/other/a.pmtiles", "other"), ("/other", "/other/ab.pmtiles", None)]
    got = spark.createDataFrame([r[:2] for r in rows], "folder string, path string").withColumn("rule", W.first_rule(rules)).collect()
    assert [r.rule for r in got] == [r[2] for r in rows]


def test_a_growing_file_arrives_once_it_stands_still(spark, tmp_path):
    for k, v in ROCKS.items():
        spark.conf.set(k, v)
    folder = tmp_path / "in"
    folder.mkdir()
    (folder / "done.PMTiles").write_bytes(b"12345")
    (folder / "note.txt").write_bytes(b"1")
    grows = folder / "grows.pmtiles"
    stream = W.arrivals(spark, [{"folder": str(folder), "name": "all", "seconds": 5}])
    q = stream.writeStream.format("memory").queryName("arrived").outputMode("append").trigger(processingTime="700 milliseconds").option("checkpointLocation", str(tmp_path / "c")).start()
    try:
        until, size = time.time() + 90, 0
        while time.time() < until and not spark.table("arrived").filter("path like '%done%'").count():
            size += 1  # it grows at each listing until the other file has arrived
            grows.write_bytes(b"x" * size)
            time.sleep(0.5)
        assert not spark.table("arrived").filter("path like '%grows%'").count()
        while time.time() < until and spark.table("arrived").count() < 2:
            time.sleep(0.5)
        time.sleep(2)
        assert sorted((os.path.basename(r.path), r.length, r.rule) for r in spark.table("arrived").collect()) == [("done.PMTiles", 5, "all"), ("grows.pmtiles", size, "all")]
    finally:
        q.stop()
