"""Coverage of archives: (source_idx, tile_id) rows and payloads."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import tiles as T
from . import runs


def coverage_union(tiles: DataFrame) -> DataFrame:
    """Distinct tile ids over all archives; the sink sorts them."""
    return tiles.select("tile_id").distinct()


def coverage_overlap(tiles: DataFrame, one, two) -> DataFrame:
    """Tiles that one archive has and the other has too, or lacks; a single shuffle serves both."""
    each = tiles.filter(F.col("source_idx").isin(one, two)).groupBy("tile_id").agg(F.bool_or(F.col("source_idx") == one).alias("_one"), F.bool_or(F.col("source_idx") == two).alias("_two"))
    return each.filter("_one").select("tile_id", F.when(F.col("_two"), "both").otherwise("first").alias("held_by"))


def priority_tiles(tiles: DataFrame, payload: str) -> DataFrame:
    """Of the sources that hold a tile the topmost wins."""
    return tiles.groupBy("tile_id").agg(F.max("source_idx").alias("source_idx"), F.max_by(payload, "source_idx").alias(payload), F.count(F.lit(1)).alias("held"))


def ancestor_tiles(wanted: DataFrame, held: DataFrame, most: int = 6) -> DataFrame:
    """For each wanted (z, x, y) the nearest held tile, itself or an ancestor up to `most` zooms above. Both sides have z, x, y; held has tile_id."""
    up = F.explode(F.sequence(F.lit(0), F.least(F.lit(most), F.col("z")).cast("int"))).alias("d")
    asked = wanted.select("*", up)
    p = T.parent(F.col("z"), F.col("x"), F.col("y"), F.col("d"))
    asked = asked.select("z", "x", "y", "d", p.alias("p")).select("z", "x", "y", "d", F.col("p.z").alias("pz"), F.col("p.x").alias("px"), F.col("p.y").alias("py"), F.col("p.dx").alias("dx"), F.col("p.dy").alias("dy"))
    found = asked.join(held.select(F.col("z").alias("pz"), F.col("x").alias("px"), F.col("y").alias("py"), F.col("tile_id").alias("from_id")), ["pz", "px", "py"])
    return found.groupBy("z", "x", "y").agg(F.max_by(F.struct("from_id", "pz", "dx", "dy"), "pz").alias("f")).select("z", "x", "y", "f.from_id", F.col("f.pz").alias("from_z"), F.col("f.dx").alias("sub_x"), F.col("f.dy").alias("sub_y"))


def assembled_children(wanted: DataFrame, held: DataFrame, levels: int = 1) -> DataFrame:
    """Wanted tiles of which all children some levels down are held. Children find their parents by arithmetic, so nothing is exploded."""
    span = 1 << levels
    children = held.select((F.col("z") - levels).alias("z"), F.floor(F.col("x") / span).cast("long").alias("x"), F.floor(F.col("y") / span).cast("long").alias("y"), F.col("tile_id")).filter("z >= 0")
    whole = children.distinct().groupBy("z", "x", "y").agg(F.count(F.lit(1)).alias("children"), F.min("tile_id").alias("first_child")).filter(F.col("children") == span * span)
    return wanted.join(whole, ["z", "x", "y"])


def tiles_in_bounds(boxes: DataFrame, low: int, high: int, limit: int | None = None) -> DataFrame:
    """Tiles of each box (west, south, east, north) over a range of zooms; limit caps all of them in order of z, x, y."""
    z = boxes.select("*", F.explode(F.sequence(F.lit(low), F.lit(high))).alias("z"))
    r = z.withColumn("_r", T.box_range(F.col("west"), F.col("south"), F.col("east"), F.col("north"), F.col("z"))).filter("_r.x0 <= _r.x1 and _r.y0 <= _r.y1")
    out = r.withColumn("x", F.explode(F.sequence("_r.x0", "_r.x1"))).withColumn("y", F.explode(F.sequence("_r.y0", "_r.y1"))).drop("_r")
    return out.orderBy("z", "x", "y").limit(limit) if limit is not None else out


def tile_counts(boxes: DataFrame, low: int, high: int, limit: int | None = None) -> DataFrame:
    """How many tiles a box has, in closed form."""
    n = sum((T.box_count(F.col("west"), F.col("south"), F.col("east"), F.col("north"), F.lit(z)) for z in range(low, high + 1)), F.lit(0).cast("long"))
    return boxes.withColumn("tiles", F.least(n, F.lit(limit)) if limit is not None else n)


def warm_report(wanted: DataFrame, covered: DataFrame) -> DataFrame:
    """Hits and misses by zoom of wanted tiles against a coverage, both with tile_id."""
    have = covered.select("tile_id").distinct().withColumn("_hit", F.lit(True))
    return wanted.join(have, "tile_id", "left").groupBy("z").agg(F.count(F.lit(1)).alias("total"), F.count_if("_hit").alias("hits"), F.count_if(F.col("_hit").isNull()).alias("misses"))


def content_dedup(payloads: DataFrame) -> DataFrame:
    """Distinct contents by SHA-256, the first tile of each, and how many tiles it serves. No payload is shuffled."""
    return payloads.select("tile_id", F.sha2(F.col("content").cast("binary"), 256).alias("digest"), F.octet_length("content").cast("long").alias("length")).groupBy("digest").agg(
        F.min("tile_id").alias("tile_id"), F.first("length").alias("length"), F.count(F.lit(1)).alias("tiles")
    )


def content_counts(payloads: DataFrame) -> DataFrame:
    """Tiles addressed, directory entries after run-length encoding, and distinct contents."""
    return tile_runs(payloads).agg(F.sum("run_length").alias("addressed"), F.count(F.lit(1)).alias("entries"), F.countDistinct("digest").alias("contents"))


def tile_runs(payloads: DataFrame) -> DataFrame:
    """Runs of consecutive tile ids with one content (gaps and islands), found within cells of ids: a content of many tiles, even of every second one, takes many tasks."""
    rows = payloads.select("tile_id", F.sha2(F.col("content").cast("binary"), 256).alias("digest"), F.lit(1).cast("long").alias("run_length"))
    return runs.union_runs(rows, ["digest"], 16)


def tile_offsets(contents: DataFrame, cell_bits: int = 12) -> DataFrame:
    """Where each content begins: the running sum of lengths in order of first tile. Sums run within cells of ids, then over the cells, so no task holds all rows."""
    cell = F.shiftright("tile_id", cell_bits)
    placed = contents.withColumn("_cell", cell)
    cells = placed.groupBy("_cell").agg(F.sum("length").alias("_n"))
    coarse = cells.withColumn("_top", F.shiftright("_cell", cell_bits))
    tops = coarse.groupBy("_top").agg(F.sum("_n").alias("_t")).withColumn("_before_top", F.coalesce(F.sum("_t").over(Window.orderBy("_top").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))  # a row for each 2 ** 24 ids
    bases = coarse.join(tops.drop("_t"), "_top").select("_cell", (F.col("_before_top") + F.coalesce(F.sum("_n").over(Window.partitionBy("_top").orderBy("_cell").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).alias("_base"))
    own = F.coalesce(F.sum("length").over(Window.partitionBy("_cell").orderBy("tile_id").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return placed.withColumn("_own", own).join(bases, "_cell").withColumn("offset", F.col("_base") + F.col("_own")).drop("_cell", "_own", "_base")


def clustered(entries: DataFrame, archive: str, order: str, cell_bits: int = 16) -> DataFrame:
    """Whether an archive's tile ids strictly ascend in order of arrival. Neighbours are compared within cells of arrival, then the cells' ends among themselves, so an archive takes many tasks."""
    cell = F.shiftright(F.col(order), cell_bits)
    w = Window.partitionBy(archive, "_cell").orderBy(order)
    marked = entries.withColumn("_cell", cell).withColumn("_bad", F.coalesce(F.col("tile_id") <= F.lag("tile_id").over(w), F.lit(False)))
    cells = marked.groupBy(archive, "_cell").agg(F.bool_or("_bad").alias("_bad"), F.count(F.lit(1)).alias("_n"), F.min_by("tile_id", order).alias("_first"), F.max_by("tile_id", order).alias("_last"))
    ends = cells.withColumn("_back", F.coalesce(F.col("_first") <= F.lag("_last").over(Window.partitionBy(archive).orderBy("_cell")), F.lit(False)))
    return ends.groupBy(archive).agg((~F.bool_or(F.col("_bad") | F.col("_back"))).alias("clustered"), F.sum("_n").alias("entries"))


def shared_domain(sources: DataFrame) -> DataFrame:
    """The zooms and the box that all sources have; no row if there are none."""
    out = sources.agg(F.max("min_zoom").alias("min_zoom"), F.min("max_zoom").alias("max_zoom"), F.max("west").alias("west"), F.max("south").alias("south"), F.min("east").alias("east"), F.min("north").alias("north"))
    return out.filter("min_zoom <= max_zoom and west < east and south < north")


def sample_domain(domain: DataFrame, n: int, seed: int = 1) -> DataFrame:
    """Seeded tiles of a shared domain, deeper zooms likelier (zoom by the square root of an even number); sampling is the feature."""
    u = lambda k: F.conv(F.substring(F.md5(F.concat_ws(":", F.lit(seed), F.lit(k), "i")), 1, 7), 16, 10).cast("long") / float(1 << 28)
    rows = domain.select("*", F.explode(F.sequence(F.lit(0), F.lit(n - 1))).alias("i"))
    z = (F.col("min_zoom") + F.floor(F.sqrt(u(0)) * (F.col("max_zoom") - F.col("min_zoom") + 1))).cast("int")
    lon, lat = F.col("west") + u(1) * (F.col("east") - F.col("west")), F.col("south") + u(2) * (F.col("north") - F.col("south"))
    return rows.withColumn("z", z).select("i", "z", T.tile_of(T.world_x(lon), F.col("z")).alias("x"), T.tile_of(T.world_y(lat), F.col("z")).alias("y"))


def with_zxy(tiles: DataFrame, column: str = "tile_id") -> DataFrame:
    """tiles with z, x, y of their ids."""
    return T.with_places(tiles, column)


def passthrough(contributions: DataFrame, needs_pixels: Column) -> DataFrame:
    """Tiles that exactly one source answers at their own zoom, with nothing to change: their payloads are copied, the rest goes to the pixel path."""
    return contributions.groupBy("tile_id").agg(F.count(F.lit(1)).alias("sources"), F.bool_or(needs_pixels).alias("_pixels"), F.max("source_idx").alias("source_idx")).select("tile_id", "sources", "source_idx", ((F.col("sources") == 1) & ~F.col("_pixels")).alias("copied"))
