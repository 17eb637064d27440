"""Queries over whole tables leave nothing out; test_queries holds their rows against SQL."""

from quadrel import plans

QUERIES = plans.queries()


def test_clips_of_all_tiles(spark, sf_dir):
    tiles = spark.read.parquet(f"{sf_dir}/lineitem.parquet").select("l_orderkey").distinct().count()
    assert QUERIES["clip_mask_all"](spark, sf_dir).select("tile_id").distinct().count() == tiles
    assert QUERIES["clip_sources_all"](spark, sf_dir).count() == 3 * tiles


def test_masks_of_all_pixels(spark, sf_dir):
    tiles = spark.read.parquet(f"{sf_dir}/lineitem.parquet").select("l_orderkey").distinct().count()
    pixels = QUERIES["clip_mask"](spark, sf_dir).select("tile_id", "i").distinct()
    assert pixels.count() == 64 * tiles


def test_all_grids_and_rows(spark, sf_dir):
    grids = spark.read.parquet(f"{sf_dir}/embeddings.parquet").count()
    for name in ("elevation_resample_all", "elevation_parent_all", "elevation_blur_all", "rgba_resample_all"):
        assert QUERIES[name](spark, sf_dir).select("tile_id", "source_idx").distinct().count() == grids
    assert QUERIES["engine_peers_all"](spark, sf_dir).count() == spark.read.parquet(f"{sf_dir}/lineitem.parquet").count()
    assert QUERIES["stack_impact_all"](spark, sf_dir).filter("info_hash % 7 <> 0").count() > 0
    assert QUERIES["save_cycles_all"](spark, sf_dir).agg({"written": "max"}).first()[0] > 12
