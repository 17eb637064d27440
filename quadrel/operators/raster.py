"""Raster algebra on tile grids.

A grid is an array of doubles in rows, from the north-west; null is no data. Point-wise operators are array expressions.
Resampling, blurring and premultiplied resampling weigh many neighbours of a pixel, which array expressions would look up one
by one; they are NumPy kernels over Arrow batches of whole grids.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from functools import cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Red, green and blue factors and shift of the public elevation encodings; fixed values.
FACTORS = {"mapbox": (6553.6, 25.6, 0.1, 10000.0), "terrarium": (256.0, 1.0, 1.0 / 256.0, 32768.0)}
KERNELS = {"nearest": 0, "bilinear": 1, "cubic": 2, "lanczos": 3}


def factors(encoding: str = "mapbox", interval: float | None = None, base: float | None = None, custom: tuple[float, ...] | None = None) -> tuple[float, float, float, float]:
    if encoding == "custom":
        return custom
    if encoding == "mapbox" and (interval or base is not None):
        step = interval or 0.1
        return step * 65536, step * 256, step, -(-10000.0 if base is None else base)
    return FACTORS[encoding]


def decode(r: Column, g: Column, b: Column, f: tuple[float, ...]) -> Column:
    """Heights of three channel arrays."""
    return F.transform(F.arrays_zip(r.alias("r"), g.alias("g"), b.alias("b")), lambda p: p["r"] * f[0] + p["g"] * f[1] + p["b"] * f[2] - f[3])


def encode(px: Column, f: tuple[float, ...]) -> Column:
    """struct of r, g, b arrays: heights in steps of the smallest factor, held within 24 bits; no data is 0."""
    step = min(f[:3])
    units = F.transform(px, lambda h: F.when(h.isNull(), F.lit(0)).otherwise(F.greatest(F.lit(0), F.least(F.lit((1 << 24) - 1), F.floor((h + f[3]) / step + 0.5)))).cast("long"))
    part = lambda n: F.transform(units, lambda u: F.shiftright(u, n).bitwiseAND(F.lit(255)).cast("int"))
    return F.struct(part(16).alias("r"), part(8).alias("g"), part(0).alias("b"))


def mask_heights(px: Column, values: list[float] | Column) -> Column:
    """No data where a height is one of the values (a list, or a column of arrays), to a thousandth."""
    wanted = F.transform(values, lambda v: F.floor(v * 1000 + 0.5)) if isinstance(values, Column) else F.array(*(F.lit(math.floor(v * 1000 + 0.5)) for v in values)).cast("array<long>")
    return F.transform(px, lambda h: F.when(~F.coalesce(F.array_contains(wanted, F.floor(h * 1000 + 0.5)), F.lit(False)), h))


def color(text: str) -> int:
    """#rrggbb, #rgb or "r,g,b" as one number."""
    t = text.strip().lstrip("#")
    if "," in t:
        r, g, b = (int(x) for x in t.split(","))
    else:
        t = "".join(c * 2 for c in t) if len(t) == 3 else t
        r, g, b = int(t[:2], 16), int(t[2:4], 16), int(t[4:6], 16)
    return r << 16 | g << 8 | b


def _packed(p: Column) -> Column:
    return p["r"].cast("long") * 65536 + p["g"] * 256 + p["b"]


def colors_of(colors: list[str] | Column) -> Column:
    """Colours as numbers: of a list of texts, or of a column that has them as color() gives them."""
    return colors if isinstance(colors, Column) else F.array(*(F.lit(color(c)) for c in colors)).cast("array<long>")


def mask_colors(px: Column, r: Column, g: Column, b: Column, colors: list[str] | Column) -> Column:
    wanted = colors_of(colors)
    return F.transform(F.arrays_zip(px.alias("h"), r.alias("r"), g.alias("g"), b.alias("b")), lambda p: F.when(~F.coalesce(F.array_contains(wanted, _packed(p)), F.lit(False)), p["h"]))


def adjust(px: Column, by: float) -> Column:
    return F.transform(px, lambda h: h + by)


def fill(px: Column, nodata: float = -10000.0) -> Column:
    return F.transform(px, lambda h: F.coalesce(h, F.lit(nodata)))


def empty(px: Column) -> Column:
    return ~F.exists(px, lambda h: h.isNotNull())


def paint(layers: DataFrame) -> DataFrame:
    """(tile_id, source_idx, px) layers painted bottom-up: each pixel takes its topmost value; tiles without any are left out. A tile has as many layers as its recipe has sources."""
    stacked = layers.groupBy("tile_id").agg(F.array_sort(F.collect_list(F.struct(F.col("source_idx").alias("i"), "px"))).alias("l"))
    painted = F.aggregate(F.slice(F.col("l"), 2, F.greatest(F.lit(0), F.size("l") - 1)), F.col("l")[0]["px"], lambda acc, x: F.zip_with(x["px"], acc, lambda top, below: F.coalesce(top, below)))
    return stacked.select("tile_id", painted.alias("px")).filter(~empty(F.col("px")))


def assemble(children: DataFrame, span: int, width: int) -> DataFrame:
    """(tile_id, dx, dy, px) children of width x width stitched to one grid; only whole sets of span * span."""
    return stitched(children.withColumns({"span": F.lit(span), "width": F.lit(width)}), ["tile_id"], ["px"]).select("tile_id", "px")


def stitched(children: DataFrame, keys: list[str], names: list[str]) -> DataFrame:
    """Children (keys, dx, dy, span, width and the grids in names) as one grid for each key, by slices of their rows; only whole sets of span * span."""
    own = F.struct("dy", "dx", *names)
    sets = children.groupBy(*keys).agg(F.array_sort(F.collect_set(own)).alias("c"), F.max("span").alias("span"), F.max("width").alias("width")).filter(F.size("c") == F.col("span") * F.col("span"))
    upto = lambda n: F.sequence(F.lit(0), F.col(n).cast("int") - 1)

    def grid(name: str) -> Column:
        part = lambda dy, row, dx: F.slice(F.get(F.col("c"), dy * F.col("span").cast("int") + dx)[name], row * F.col("width").cast("int") + 1, F.col("width").cast("int"))
        line = lambda dy, row: F.flatten(F.transform(upto("span"), lambda dx: part(dy, row, dx)))
        return F.flatten(F.transform(upto("span"), lambda dy: F.flatten(F.transform(upto("width"), lambda row: line(dy, row)))))

    return sets.select(*keys, *(grid(n).alias(n) for n in names))


def _weight(kernel: str, x: np.ndarray) -> np.ndarray:
    x = np.abs(x)
    if kernel == "nearest":
        return (x <= 0.5).astype(float)
    if kernel == "bilinear":
        return np.clip(1 - x, 0, None)
    if kernel == "cubic":
        a = -0.5
        return np.where(x <= 1, (a + 2) * x**3 - (a + 3) * x**2 + 1, np.where(x < 2, a * x**3 - 5 * a * x**2 + 8 * a * x - 4 * a, 0))
    return np.where(x < 3, np.sinc(x) * np.sinc(x / 3), 0)


@cache
def weights(kernel: str, source: int, target: int, origin: float = 0.0, extent: float | None = None) -> np.ndarray:
    """Matrix [target, source] of a kernel's weights for resampling `extent` source pixels from `origin`; samples beyond the edge repeat it."""
    extent = source if extent is None else extent
    at = origin + (np.arange(target) + 0.5) * extent / target - 0.5
    out, reach = np.zeros((target, source)), max(1, KERNELS[kernel])
    for k in range(1 - reach, reach + 1):
        i = np.floor(at).astype(int) + k
        np.add.at(out, (np.arange(target), np.clip(i, 0, source - 1)), _weight(kernel, at - i))
    return out


@cache
def gauss(size: int, sigma: float) -> np.ndarray:
    """Matrix of a Gaussian's weights over three deviations, with clamped edges."""
    reach, n = max(1, math.ceil(3 * sigma)), np.arange(size)
    out = np.zeros((size, size))
    for k in range(-reach, reach + 1):
        np.add.at(out, (n, np.clip(n + k, 0, size - 1)), math.exp(-(k * k) / (2 * sigma * sigma)))
    return out


def _weighted(stack: np.ndarray, rows: np.ndarray | None, columns: np.ndarray | None) -> np.ndarray:
    """Separable weighing of a stack's data and of its presence, by rows and columns or one of them; what is missing carries no weight."""
    known = ~np.isnan(stack)
    data, there = np.where(known, stack, 0), known.astype(float)
    if rows is not None:
        data, there = rows @ data, rows @ there
    if columns is not None:
        data, there = data @ columns.T, there @ columns.T
    with np.errstate(invalid="ignore", divide="ignore"):
        return np.where(np.abs(there) > 1e-9, data / there, np.nan)


def _numbers(column: pa.Array, kind: type = np.float64) -> np.ndarray:
    return np.asarray(pc.fill_null(column, 0).to_numpy(zero_copy_only=False), kind)


def _on_grids(df: DataFrame, names: list[str], keys: list[str], kernel: Callable[..., list[np.ndarray]]) -> DataFrame:
    """df with the grids in `names` replaced; all other columns pass, null grids stay null.

    kernel(stacks, side, *keys) gets all grids of a batch that share their width and keys, as one stack [n, side, side] for each name.
    """
    schema = df.schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = {n: batch.column(batch.schema.get_field_index(n)) for n in names}
            lengths = _numbers(pc.list_value_length(lists[names[0]]), np.int64)
            flat = {n: x.flatten().cast(pa.float64()).to_numpy(zero_copy_only=False) for n, x in lists.items()}
            starts = np.cumsum(lengths) - lengths
            made, sizes = [], np.zeros(len(lengths), np.int64)
            groups, of = np.unique(np.column_stack([lengths, *(_numbers(batch.column(batch.schema.get_field_index(k))) for k in keys)]), axis=0, return_inverse=True)
            for g, (length, *key) in enumerate(groups.tolist()):
                if length:
                    rows, side = np.flatnonzero(of.ravel() == g), math.isqrt(int(length))
                    at = starts[rows][:, None] + np.arange(int(length))
                    out = kernel([flat[n][at].reshape(-1, side, side) for n in names], side, *key)
                    made.append((rows, [x.reshape(len(rows), -1) for x in out]))
                    sizes[rows] = made[-1][1][0].shape[1]
            ends, columns = np.cumsum(sizes), list(batch.columns)
            for k, n in enumerate(names):
                values = np.empty(ends[-1] if len(ends) else 0)
                for rows, out in made:
                    values[(ends - sizes)[rows][:, None] + np.arange(out[k].shape[1])] = out[k]
                columns[batch.schema.get_field_index(n)] = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], ends]).astype(np.int32)), pa.array(values, mask=np.isnan(values)), mask=pc.is_null(lists[n]))
            yield pa.RecordBatch.from_arrays(columns, names=batch.schema.names)

    return df.mapInArrow(run, schema)


def resample(df: DataFrame, size: int, kernel: str = "bilinear", column: str = "px") -> DataFrame:
    """Grids at another size."""
    return _on_grids(df, [column], [], lambda stacks, side: [_weighted(stacks[0], w := weights(kernel, side, size), w)])


def _square(stack: np.ndarray, side: int, size: int, kernel: str, levels: float, sub_x: float, sub_y: float) -> np.ndarray:
    """A parent's square at `size` pixels: of its 2^levels by 2^levels the one at sub_x, sub_y."""
    part = side / 2**levels
    return _weighted(stack, weights(kernel, side, size, sub_y * part, part), weights(kernel, side, size, sub_x * part, part))


SQUARE = ["levels", "sub_x", "sub_y"]


def resample_parent(df: DataFrame, kernel: str = "bilinear", column: str = "px") -> DataFrame:
    """Grids of a parent's square at the parent's size: columns sub_x, sub_y, levels say which of its 2^levels by 2^levels squares."""
    return _on_grids(df, [column], SQUARE, lambda stacks, side, *key: [_square(stacks[0], side, side, kernel, *key) if key[0] else stacks[0]])


def blur(df: DataFrame, sigma: float, column: str = "px", distance: str | None = None) -> DataFrame:
    """Gaussian blur with clamped edges, columns first and then rows; sigma grows with a column of zoom distances, and 0 changes nothing."""

    def run(stacks: list[np.ndarray], side: int, times: float = 1.0) -> list[np.ndarray]:
        if sigma * times <= 0:
            return stacks
        w = gauss(side, sigma * times)
        return [_weighted(_weighted(stacks[0], None, w), w, None)]

    return _on_grids(df, [column], [distance] if distance else [], run)


def to_channels(values: Column) -> Column:
    """Bytes as 0 to 1."""
    return F.transform(values, lambda v: v / 255.0)


def to_bytes(values: Column) -> Column:
    return F.transform(values, lambda v: F.floor(F.greatest(F.lit(0.0), F.least(F.lit(1.0), v)) * 255 + 0.5).cast("int"))


def mask_layer(r: Column, g: Column, b: Column, a: Column, colors: list[str] | Column) -> Column:
    """Alpha with 0 where the colour is one of the list; channels are 0 to 1."""
    wanted = colors_of(colors)
    byte = lambda v: F.floor(v * 255 + 0.5).cast("long")
    return F.transform(F.arrays_zip(r.alias("r"), g.alias("g"), b.alias("b"), a.alias("a")), lambda p: F.when(F.array_contains(wanted, byte(p["r"]) * 65536 + byte(p["g"]) * 256 + byte(p["b"])), F.lit(0.0)).otherwise(p["a"]))


def blended(mode: Column, below: Column, above: Column) -> Column:
    """The six separable blend modes of the compositing standard, on channels of 0 to 1."""
    return (
        F.when(mode == "multiply", below * above)
        .when(mode == "screen", below + above - below * above)
        .when(mode == "darken", F.least(below, above))
        .when(mode == "lighten", F.greatest(below, above))
        .when(mode == "overlay", F.when(below <= 0.5, 2 * below * above).otherwise(1 - 2 * (1 - below) * (1 - above)))
        .otherwise(above)
    )


def composite(layers: DataFrame) -> DataFrame:
    """(tile_id, source_idx, r, g, b, a, opacity, blend) layers composed source-over in order; channels are 0 to 1. Tiles that stay transparent are left out. The work is done by pixel arrays within a tile's row."""
    pixel = F.arrays_zip("r", "g", "b", "a")
    stacked = layers.groupBy("tile_id").agg(F.array_sort(F.collect_list(F.struct(F.col("source_idx").alias("i"), pixel.alias("p"), "opacity", "blend"))).alias("l"))

    def over(acc: Column, layer: Column) -> Column:
        def one(back: Column, src: Column) -> Column:
            sa = src["a"] * layer["opacity"]
            out = sa + back["a"] * (1 - sa)
            mix = lambda c: F.when(out <= 0, F.lit(0.0)).otherwise((sa * ((1 - back["a"]) * src[c] + back["a"] * blended(layer["blend"], back[c], src[c])) + (1 - sa) * back["a"] * back[c]) / out).alias(c)
            return F.struct(mix("r"), mix("g"), mix("b"), out.alias("a"))

        return F.zip_with(acc, layer["p"], one)

    clear = F.transform(F.col("l")[0]["p"], lambda p: F.struct(*(F.lit(0.0).alias(c) for c in "rgba")))
    done = stacked.select("tile_id", F.aggregate("l", clear, over).alias("p")).filter(F.exists("p", lambda p: p["a"] > 0))
    return done.select("tile_id", *(F.transform("p", lambda p: p.getField(c)).alias(c) for c in "rgba"))  # noqa: B023


def resample_layer(df: DataFrame, size: int, kernel: str = "bilinear", square: bool = False) -> DataFrame:
    """r, g, b, a grids at another size; colours are weighed by their alpha, so clear pixels lend none. With `square` of a parent's grid that square only which columns sub_x, sub_y and levels name."""

    def run(stacks: list[np.ndarray], side: int, levels: float = 0, sub_x: float = 0, sub_y: float = 0) -> list[np.ndarray]:
        part = side / 2**levels
        rows, columns = weights(kernel, side, size, sub_y * part, part), weights(kernel, side, size, sub_x * part, part)
        whole = np.outer(rows.sum(1), columns.sum(1))
        *colours, a = stacks
        alpha = rows @ a @ columns.T / whole
        out = []
        for c in colours:
            value = rows @ (c * a) @ columns.T / whole
            out.append(np.clip(np.divide(value, alpha, out=np.zeros_like(value), where=alpha > 1e-6), 0, 1))
        return [*out, np.clip(alpha, 0, 1)]

    return _on_grids(df, list("rgba"), SQUARE if square else [], run)


def sized_layers(layers: DataFrame, size: int, kernel: str = "bilinear") -> DataFrame:
    """Colour layers at one size: those of another width, and squares of parents (columns levels, sub_x, sub_y), are resampled; the rest pass untouched."""
    off = (F.size("a") != size * size) | (F.col("levels") > 0)
    return layers.filter(~off).unionByName(resample_layer(layers.filter(off), size, kernel, square=True))


def sized_heights(layers: DataFrame, size: int, kernel: str = "bilinear", column: str = "px") -> DataFrame:
    """Height layers at one size: those of another width are brought to it first, then squares of parents (columns levels, sub_x, sub_y) are cut at that size; the rest pass untouched."""

    def run(stacks: list[np.ndarray], side: int, *key: float) -> list[np.ndarray]:
        whole = stacks[0] if side == size else _weighted(stacks[0], w := weights(kernel, side, size), w)
        return [_square(whole, size, size, kernel, *key) if key[0] else whole]

    off = (F.size(column) != size * size) | (F.col("levels") > 0)
    return layers.filter(~off).unionByName(_on_grids(layers.filter(off), [column], SQUARE, run))


def clipped(layers: DataFrame, column: str, nothing) -> DataFrame:
    """layers with a value of `nothing` where their coverage mask (column `mask`, null: all inside) is 0."""
    inside = F.when(F.col("mask").isNull(), F.col(column)).otherwise(F.zip_with(F.col(column), F.col("mask"), lambda v, m: F.when(m == 1, v).otherwise(F.lit(nothing))))
    return layers.withColumn(column, inside)


def merge_elevation(layers: DataFrame, size: int, mask: list[float] = (), kernel: str = "bilinear", sigma: float = 0.0, distance: str = "levels") -> DataFrame:
    """Height layers (tile_id, source_idx, adjustment, px) in the fixed order: mask heights and colours, adjust, resize, cut squares of parents, blur those by sigma for each zoom between, clip, paint.

    A source's own masks are columns `values` (heights) and `colors` (numbers as color() gives them, with r, g, b bytes beside px); `mask` is for those
    without. Of the columns levels, sub_x, sub_y (squares of parents) and mask (coverage) those may be missing that nothing needs.
    """
    have = set(layers.columns)
    rows = layers.withColumns({c: F.lit(0) for c in SQUARE if c not in have} | ({} if "adjustment" in have else {"adjustment": F.lit(0.0)}))
    out = mask_heights(F.col("px"), F.coalesce("values", F.array(*map(F.lit, mask)).cast("array<double>")) if "values" in have else list(mask))
    if "colors" in have:
        out = mask_colors(out, F.col("r"), F.col("g"), F.col("b"), F.coalesce("colors", F.array().cast("array<long>")))
    masked = rows.withColumn("px", F.zip_with(out, F.array_repeat(F.coalesce("adjustment", F.lit(0.0)), F.size("px")), lambda h, a: h + a))
    sized = sized_heights(masked.drop("r", "g", "b"), size, kernel)
    soft = blur(sized, sigma, distance=distance) if sigma > 0 else sized
    return paint(clipped(soft, "px", None) if "mask" in have else soft)


def merge_rgba(layers: DataFrame, size: int, colors: list[str] = (), kernel: str = "bilinear") -> DataFrame:
    """Colour layers (tile_id, source_idx, r, g, b, a of 0 to 1, opacity, blend) in the fixed order: mask colours, resample, clip, compose. A source's own `colors`, and columns that are missing, as in merge_elevation."""
    have = set(layers.columns)
    usual = {"opacity": F.lit(1.0), "blend": F.lit("normal")}
    rows = layers.withColumns({c: F.lit(0) for c in SQUARE if c not in have} | {c: v for c, v in usual.items() if c not in have})
    own = F.coalesce("colors", colors_of(colors)) if "colors" in have else list(colors)
    masked = rows.withColumn("a", mask_layer(F.col("r"), F.col("g"), F.col("b"), F.col("a"), own)) if "colors" in have or colors else rows
    sized = sized_layers(masked, size, kernel)
    return composite(clipped(sized, "a", 0.0) if "mask" in have else sized)
