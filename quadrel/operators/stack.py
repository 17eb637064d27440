"""Combined archives: the answer of a recipe for a set of tiles in height or colour, and its bake into one archive."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.tiles import parent, revision
from ..sources.tables import Parts, stored
from . import clip, raster
from .clip import few
from .tiles import passthrough


def source_rule(reads: DataFrame) -> DataFrame:
    """(tile_id, source_idx, name, outcome, required): a tile fails if a required source failed; other failures are skipped. Lists what each source gave."""
    return reads.groupBy("tile_id").agg(
        F.bool_or((F.col("outcome") == "error") & F.col("required")).alias("failed"), F.count_if(F.col("outcome") == "ok").alias("sources"),
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("source_idx", F.concat_ws("=", "name", "outcome").alias("t")))), lambda s: s["t"]), ",").alias("contributors"),
    )


def checked(reads: DataFrame) -> DataFrame:
    """The reads, failing the job at a required source's error."""
    return reads.filter(F.assert_true((F.col("outcome") != "error") | ~F.col("required"), "a required source can't be read").isNull())


def reads_of(wanted: DataFrame, held: DataFrame, most: int = 6) -> DataFrame:
    """(tile_id, source_idx, from_id, levels, sub_x, sub_y): for each wanted tile (tile_id, z, x, y) the tile that each source (source_idx, tile_id, z, x, y) answers it with, itself or its nearest ancestor up to `most` zooms above. Of held tiles with `broken` (they can't be read) the mark comes along: they end the climb."""
    up = wanted.withColumn("levels", F.explode(F.sequence(F.lit(0), F.least(F.lit(most), F.col("z")).cast("int"))))
    p = parent(F.col("z"), F.col("x"), F.col("y"), F.col("levels"))
    asked = up.select("tile_id", "levels", p.alias("p")).select("tile_id", "levels", F.col("p.z").alias("z"), F.col("p.x").alias("x"), F.col("p.y").alias("y"), F.col("p.dx").alias("sub_x"), F.col("p.dy").alias("sub_y"))
    broken = F.col("broken") if "broken" in held.columns else F.lit(False)
    found = asked.join(held.select("source_idx", "z", "x", "y", F.col("tile_id").alias("from_id"), broken.alias("broken")), ["z", "x", "y"])
    near = found.groupBy("tile_id", "source_idx").agg(F.min_by(F.struct("from_id", "levels", "sub_x", "sub_y", "broken"), "levels").alias("f"))
    return near.select("tile_id", "source_idx", "f.*")


def child_reads(reads: DataFrame, wanted: DataFrame, held: DataFrame, size: int, deepest: int = 24) -> DataFrame:
    """(tile_id, source_idx, from_id, dx, dy, span): the children that answer in a read's place.

    A source whose tile at the wanted zoom is `width` pixels wide keeps its detail log2(size / width) zooms further down. Held tiles find
    the tile that far above by arithmetic, one shuffle on it gathers them, and only whole sets of readable children count.
    """
    offset = F.round(F.log2(F.lit(size) / F.col("width"))).cast("int")
    asked = reads.filter("levels = 0 and not broken").join(held.select("source_idx", F.col("tile_id").alias("from_id"), "width"), ["source_idx", "from_id"]).withColumn("offset", offset).filter("offset > 0")
    asked = asked.join(wanted.select("tile_id", "z", "x", "y"), "tile_id").filter(F.col("z") + F.col("offset") <= deepest)
    zooms = F.sequence(F.lit(1), F.greatest(F.lit(1), offset))
    readable = held.filter(~F.col("broken")) if "broken" in held.columns else held
    # A child is as wide as the tile that it stands in for, so its own width says how far above that is.
    below = readable.filter(F.col("width") < size).select("source_idx", F.col("tile_id").alias("child_id"), "z", "x", "y", F.explode(zooms).alias("offset")).filter(F.col("z") >= F.col("offset"))
    up = F.call_function("shiftleft", F.lit(1).cast("long"), F.col("offset"))
    below = below.select("source_idx", "child_id", "offset", (F.col("z") - F.col("offset")).alias("z"), F.floor(F.col("x") / up).cast("long").alias("x"), F.floor(F.col("y") / up).cast("long").alias("y"), F.pmod(F.col("x"), up).alias("dx"), F.pmod(F.col("y"), up).alias("dy"))
    sets = below.dropDuplicates(["source_idx", "child_id", "offset"]).groupBy("source_idx", "z", "x", "y", "offset").agg(F.collect_list(F.struct("child_id", "dx", "dy")).alias("c"))
    whole = sets.withColumn("span", F.call_function("shiftleft", F.lit(1).cast("long"), F.col("offset"))).filter(F.size("c") == F.col("span") * F.col("span"))
    met = asked.select("tile_id", "source_idx", "z", "x", "y", "offset").join(whole, ["source_idx", "z", "x", "y", "offset"])
    return met.select("tile_id", "source_idx", "span", F.explode("c").alias("c")).select("tile_id", "source_idx", F.col("c.child_id").alias("from_id"), "c.dx", "c.dy", "span")


def routed(reads: DataFrame, needs_pixels: Column) -> DataFrame:
    """Reads with `copied` and `failed`. Copied: the tile has one source, which answers at the tile's own zoom, inside its shape, needs nothing of the pixels, and no source failed. Failed: a required source's tile can't be read. Decided on ids alone, before any grid is touched."""
    changes = needs_pixels | (F.col("levels") > 0) | (F.col("place") == "partial") | F.col("broken")
    own = reads.filter("place <> 'outside'")
    split = passthrough(own.select("tile_id", "source_idx", changes.alias("_needs")), F.col("_needs")).select("tile_id", "copied")
    required = F.col("required") if "required" in reads.columns else F.lit(False)
    failed = own.groupBy("tile_id").agg(F.bool_or(F.col("broken") & F.coalesce(required, F.lit(False))).alias("failed"))
    return own.join(split.join(failed, "tile_id"), "tile_id")


def changes_of(recipe: DataFrame, output: dict, sigma: float = 0.0) -> Column:
    """Whether what a recipe asks of a source, or its output of all, alters stored pixels. output: encoding, nodata, format and alpha, as far as they are asked for; of a source the columns that it has."""
    have = set(recipe.columns)
    asks = F.lit(sigma > 0 or output.get("nodata") is not None or output.get("alpha") is False)
    for name, nothing in (("adjustment", 0.0), ("opacity", 1.0), ("blend", "normal")):
        if name in have:
            asks |= F.coalesce(F.col(name) != nothing, F.lit(False))
    for name in ("values", "colors"):
        if name in have:
            asks |= F.coalesce(F.size(name) > 0, F.lit(False))
    if output.get("encoding"):
        asks |= ~F.col("encoding").eqNullSafe(output["encoding"]) if "encoding" in have else F.lit(True)
    if output.get("format"):
        asks |= ~F.col("format").eqNullSafe(output["format"]) if "format" in have else F.lit(True)
    return asks


def shapes_of(recipe: DataFrame, shapes: DataFrame | None) -> tuple[DataFrame, DataFrame | None]:
    """The recipe with a cutline for every source that is clipped, and the shapes with those of the sources' own bounds (west, south, east, north in degrees): a box is a shape of four corners. A cutline goes before bounds."""
    if "bounds" not in recipe.columns:
        return recipe, shapes
    name = F.concat(F.lit("bounds:"), F.col("source_idx").cast("string"))
    corners = ((0, "west", "north"), (1, "east", "north"), (2, "east", "south"), (3, "west", "south"))
    boxed = recipe.filter("cutline is null and bounds is not null")
    points = boxed.select(name.alias("shape"), F.lit(0).alias("ring"), F.explode(F.array(*(F.struct(F.lit(i).alias("i"), F.col(f"bounds.{x}").alias("lon"), F.col(f"bounds.{y}").alias("lat")) for i, x, y in corners))).alias("p")).select("shape", "ring", "p.*")
    boxes = clip.segments(points)
    return recipe.withColumn("cutline", F.coalesce("cutline", F.when(F.col("bounds").isNotNull(), name))), boxes if shapes is None else shapes.unionByName(boxes)


def answer(layers: DataFrame, needs_pixels: Column, size: int, mask: list[float], kernel: str = "bilinear", sigma: float = 0.0) -> DataFrame:
    """(tile_id, px, copied): tiles that one source answers unchanged are copied, the rest are merged. The split is decided on ids alone, before any grid is touched."""
    split = passthrough(layers.select("tile_id", "source_idx", needs_pixels.alias("_needs")), F.col("_needs")).select("tile_id", "copied")
    routed = layers.join(split, "tile_id")
    copied = routed.filter("copied").select("tile_id", "px", F.lit(True).alias("copied"))
    merged = raster.merge_elevation(routed.filter(~F.col("copied")).select("tile_id", "source_idx", "adjustment", "px"), size, mask, kernel, sigma)
    return copied.unionByName(merged.select("tile_id", "px", F.lit(False).alias("copied")))


def _placed(reads: DataFrame, recipe: DataFrame, places: DataFrame | None) -> DataFrame:
    """Reads with their source's settings and where their tile lies to its shape; outside of one that is missing."""
    rows = reads.join(few(recipe, "sources of a recipe"), "source_idx")
    if places is not None:
        rows = rows.join(places.withColumnRenamed("shape", "cutline"), ["tile_id", "cutline"], "left")
    else:
        rows = rows.withColumn("place", F.lit(None).cast("string"))
    return rows.withColumn("place", F.when(F.col("cutline").isNull(), "inside").otherwise(F.coalesce("place", F.lit("outside"))))


def stack_reads(wanted: DataFrame, held: DataFrame, recipe: DataFrame, shapes: DataFrame | None = None, output: dict | None = None, sigma: float = 0.0, most: int = 6, sized: bool = False) -> tuple[DataFrame, DataFrame | None]:
    """The reads of a recipe with its settings, place, copied and failed, and the shapes that clip them. With `sized` (a width is asked for) nothing is copied, for a stored width is known to none before decoding."""
    recipe, shapes = shapes_of(recipe, shapes)
    if "changes" not in recipe.columns:
        recipe = recipe.withColumn("changes", changes_of(recipe, output or {}, sigma))
    places = clip.classify(wanted, shapes) if shapes is not None else None
    placed = stored(_placed(reads_of(wanted, held, most), recipe, places), "reads")  # ids only; each of the steps that follow uses them
    return stored(routed(placed, F.col("changes") | F.lit(sized)), "routed"), shapes


def failures(reads: DataFrame) -> DataFrame:
    """(tile_id, source_idx): required sources that keep a tile from being answered."""
    return reads.filter("failed and broken and required").select("tile_id", "source_idx")


def contributors(reads: DataFrame, children: DataFrame | None = None) -> DataFrame:
    """(tile_id, source_idx, gave): error, own, up3 (a parent's square three zooms up) or down1 (children one zoom down) for each source that was asked."""
    gave = F.when(F.col("broken"), "error").when(F.col("levels") > 0, F.concat(F.lit("up"), F.col("levels").cast("string"))).otherwise("own")
    out = reads.select("tile_id", "source_idx", gave.alias("gave"))
    if children is None:
        return out
    down = children.groupBy("tile_id", "source_idx").agg(F.concat(F.lit("down"), F.log2(F.max("span")).cast("int").cast("string")).alias("_down"))
    return out.join(down, ["tile_id", "source_idx"], "left").select("tile_id", "source_idx", F.coalesce("_down", "gave").alias("gave"))


def stack_answer(wanted: DataFrame, held: DataFrame, grids: DataFrame, recipe: DataFrame, size: int, space: str, shapes: DataFrame | None = None, values: list[float] = (), colors: list[str] = (), kernel: str = "bilinear", sigma: float = 0.0, most: int = 6, output: dict | None = None, sized: bool = False) -> DataFrame:
    """What a recipe answers for wanted tiles (tile_id, z, x, y): (tile_id, copied, and px or r, g, b, a).

    held: coverage (source_idx, tile_id, z, x, y; with `sized` also width; broken where a tile can't be read). grids: (source_idx, tile_id and px, or r, g, b, a of 0 to 1).
    recipe: a row for each source (source_idx, cutline, and as far as asked for bounds, required, adjustment, values, colors, encoding, format, opacity, blend; `changes` says
    outright whether it alters pixels). shapes: segments of the cutlines. Each source answers with the tile, with `sized` its whole set of children where it is
    narrower than `size`, or its nearest ancestor's square, clipped by its shape or bounds; single unchanged answers are copied. Sources that can't be read are
    left out, and tiles where such a one is required have no row (failures() lists them).
    """
    reads, shapes = stack_reads(wanted, held, recipe, shapes, output, sigma, most, sized)
    names = ["px"] if space == "elevation" else list("rgba")
    extra = ["r", "g", "b"] if space == "elevation" and "r" in grids.columns else []
    pictures = grids.select("source_idx", F.col("tile_id").alias("from_id"), *names, *extra)
    able = reads.filter("not broken and not failed")
    rows = able.join(pictures, ["source_idx", "from_id"])
    if sized:
        below = child_reads(able.select("tile_id", "source_idx", "from_id", "levels", "broken"), wanted, held, size)
        made = below.join(pictures, ["source_idx", "from_id"]).withColumn("width", F.sqrt(F.size(names[0])).cast("int"))
        whole = raster.stitched(made, ["tile_id", "source_idx"], names + extra)
        rows = rows.join(whole.select("tile_id", "source_idx", *(F.col(n).alias(f"_{n}") for n in names + extra)), ["tile_id", "source_idx"], "left").withColumns({n: F.coalesce(f"_{n}", n) for n in names + extra}).drop(*(f"_{n}" for n in names + extra))
    copied = rows.filter("copied").select("tile_id", F.lit(True).alias("copied"), *names)
    rest = rows.filter(~F.col("copied"))
    if shapes is not None:
        cut = reads.filter("place = 'partial' and not copied").select("tile_id").distinct().join(wanted, "tile_id")
        rest = rest.join(clip.masks(cut, shapes, size).withColumnRenamed("shape", "cutline"), ["tile_id", "cutline"], "left").withColumn("mask", F.when(F.col("place") == "partial", F.col("mask")))
    merged = raster.merge_elevation(rest, size, list(values), kernel, sigma) if space == "elevation" else raster.merge_rgba(rest, size, list(colors), kernel)
    return copied.unionByName(merged.select("tile_id", F.lit(False).alias("copied"), *names))


def bake(answers: DataFrame, encoded: Column, destination: str, header: dict | None = None, metadata: dict | None = None) -> dict:
    """Write a recipe's answers (tile_id, ...) as one archive; encoded makes a tile's bytes of an answer's columns. Without any tile it is an error. Reports what the archive holds."""
    from ..sources.pmtiles import write_archive

    report = write_archive(answers.select("tile_id", encoded.alias("content")), destination, header, metadata)
    if not report["addressed"]:
        raise ValueError("the recipe answers no tile")
    return report


BAKED = "tile_id long, content binary"


def ranges_of(wanted: DataFrame, tiles: int, bits: int = 12) -> list[tuple[int, int]]:
    """Ranges of ids (first, last) that hold about so many wanted tiles each, by counts of cells of ids; the driver sees a row for each cell that is as full as a range, and fewer."""
    size = max(1, tiles)
    cells = wanted.groupBy(F.shiftright("tile_id", bits).alias("cell")).agg(F.count(F.lit(1)).alias("n"), F.min("tile_id").alias("low"), F.max("tile_id").alias("high"))
    out: list[list[int]] = []
    for r in cells.orderBy("cell").toLocalIterator():
        if out and out[-1][2] + r.n <= size:
            out[-1][1:] = [r.high, out[-1][2] + r.n]
        else:
            out.append([r.low, r.high, r.n])
    return [(low, high) for low, high, _ in out]


def bake_on(wanted: DataFrame, answers: Callable[[DataFrame], DataFrame], encoded: Column, work: str, rev: str, tiles: int = 1_000_000, most: int | None = None) -> tuple[Parts, int]:
    """Go on with a bake: the answers of wanted tiles, range by range of ids, each committed under its range by a rename.

    Ranges that an earlier run of the same revision has finished are neither answered nor read again; a bake of another revision has
    a folder of its own. `most` ends it after so many ranges. The parts, and how many ranges are left.
    """
    spark = wanted.sparkSession
    parts = Parts(spark, f"{work}/{rev}", BAKED)
    done = spark.createDataFrame([(rev, *map(int, n.split("-"))) for n in parts.names()], "revision string, first_id long, last_id long")
    # What is left is written once, by ranges of ids, so that a range reads its own rows and asks for nothing again.
    todo = stored(to_bake(wanted, done, rev).repartitionByRange("tile_id").sortWithinPartitions("tile_id"), "to-bake")
    left = ranges_of(todo, tiles)
    for first, last in left[:most]:
        part = todo.filter(F.col("tile_id").between(first, last))
        parts.put(f"{first:020d}-{last:020d}", answers(part).select(F.col("tile_id").cast("long").alias("tile_id"), encoded.cast("binary").alias("content")))
    return parts, max(0, len(left) - (len(left) if most is None else most))


def bake_parts(parts: Parts, destination: str, header: dict | None = None, metadata: dict | None = None) -> dict:
    """Write a finished bake's parts as one archive and clear them."""
    report = bake(parts.rows(), F.col("content"), destination, header, metadata)
    parts.clear()
    return report


def to_bake(wanted: DataFrame, done: DataFrame, rev: str) -> DataFrame:
    """Wanted tiles without those that an earlier run of the same revision has written; done holds (revision, first_id, last_id) ranges cut to the same cells of 4096 ids."""
    cell = lambda c: F.shiftright(c, 12)
    ranges = done.filter(F.col("revision") == rev).select(F.explode(F.sequence(cell(F.col("first_id")), cell(F.col("last_id")))).alias("_of"), "first_id", "last_id")
    return wanted.withColumn("_cell", cell(F.col("tile_id"))).join(ranges, (F.col("_cell") == F.col("_of")) & F.col("tile_id").between(F.col("first_id"), F.col("last_id")), "left_anti").drop("_cell")


def bake_report(wanted: DataFrame, answered: DataFrame) -> DataFrame:
    """Tiles written and skipped; no tile at all is an error of the caller's recipe."""
    have = answered.select("tile_id").distinct().withColumn("_ok", F.lit(True))
    return wanted.join(have, "tile_id", "left").agg(F.count_if("_ok").alias("written"), F.count_if(F.col("_ok").isNull()).alias("skipped")).withColumn("failed", F.col("written") == 0)


def stack_revision(stack: DataFrame) -> DataFrame:
    """A digest of each recipe and of the archives that it resolves to, in order."""
    parts = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("idx", "info_hash"))), lambda s: F.coalesce(s["info_hash"].cast("string"), F.lit(""))), ":")
    return stack.groupBy("stack_id").agg(parts.alias("_p")).select("stack_id", revision(F.col("stack_id"), F.col("_p")).alias("revision"))
