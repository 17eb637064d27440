"""Recipes, shapes and catalogues that arrive as JSON."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.clip import segments

RECIPE = (
    "id string, title string, space string, minzoom int, maxzoom int, bounds array<double>, resampling string, gaussianBlurSigma double, "
    "sources array<struct<category:string,archive:string,encoding:string,maskValues:array<double>,maskColors:array<string>,heightAdjustment:double,opacity:double,blend:string,cutline:string,bounds:array<double>,required:boolean>>, _corrupt_record string"
)
CATALOGUE = "format string, archives array<struct<infoHash:string,name:string,size:long,categories:array<string>,magnet:string,createdAt:string>>"
#: Geometries within collections, and collections within collections, that are looked into; a shape that goes deeper is an error.
DEPTH = 4


def load_recipes(spark: SparkSession, path: str) -> DataFrame:
    """Recipes with their problems (null: none); invalid ones are kept."""
    rows = spark.read.schema(RECIPE).option("multiLine", True).json(path)
    problem = F.when(F.col("_corrupt_record").isNotNull(), "unreadable").when(F.coalesce(F.trim("id"), F.lit("")) == "", "no id").when(F.coalesce(F.size("sources"), F.lit(0)) < 1, "no sources").when(F.exists("sources", lambda s: s["category"].isNull() & s["archive"].isNull()), "a source without category or archive")
    return rows.withColumn("problem", problem)


def recipe_sources(recipes: DataFrame) -> DataFrame:
    """Sources of valid recipes, bottom first."""
    return recipes.filter("problem is null").select(F.col("id").alias("stack_id"), F.posexplode("sources").alias("idx", "s")).select("stack_id", "idx", "s.*")


def load_shapes(spark: SparkSession, path: str) -> DataFrame:
    """Segments of a folder of GeoJSON files; a shape's name is its file's stem."""
    text = spark.read.option("wholetext", True).text(path).select(F.regexp_extract(F.col("_metadata.file_name"), r"^(.*?)(\.[^.]*)?$", 1).alias("shape"), "value")
    return shape_segments(text)


def _geometry(depth: int) -> str:
    inner = f",geometries:array<{_geometry(depth - 1)}>" if depth else ""
    return f"struct<type:string,coordinates:string{inner}>"


def _node(depth: int) -> str:
    """A geometry, feature or collection of features, as a type for from_json; coordinates stay text until their depth is known."""
    inner = f",features:array<{_node(depth - 1)}>" if depth else ""
    return f"struct<type:string,coordinates:string,geometries:array<{_geometry(DEPTH - 1)}>,geometry:{_geometry(DEPTH)}{inner}>"


def _none() -> Column:
    return F.array().cast("array<array<array<double>>>")


def _rings(g: Column, depth: int) -> Column:
    """Rings of polygons and of collections of them; other geometries have none."""
    own = F.when(g["type"] == "Polygon", F.from_json(g["coordinates"], "array<array<array<double>>>")).when(g["type"] == "MultiPolygon", F.flatten(F.from_json(g["coordinates"], "array<array<array<array<double>>>>")))
    if depth:
        own = own.when(g["type"] == "GeometryCollection", F.flatten(F.transform(g["geometries"], lambda x: _rings(x, depth - 1))))
    else:
        own = own.when(g["type"] == "GeometryCollection", F.raise_error(F.lit("collections nested too deep")).cast("array<array<array<double>>>"))
    return F.coalesce(own, _none())


def _rings_of(node: Column, depth: int) -> Column:
    own = F.when(node["type"] == "Feature", _rings(node["geometry"], DEPTH)).otherwise(_rings(node, DEPTH))
    if depth:
        return F.when(node["features"].isNotNull(), F.flatten(F.transform(node["features"], lambda x: _rings_of(x, depth - 1)))).otherwise(own)
    return F.when(node["type"] == "FeatureCollection", F.raise_error(F.lit("collections nested too deep")).cast("array<array<array<double>>>")).otherwise(own)


def shape_rings(shapes: DataFrame) -> DataFrame:
    """(shape, rings) of (shape, value) rows of GeoJSON text: rings of four points or more of all polygons, in order. A shape without any is an error."""
    rings = F.filter(_rings_of(F.from_json("value", _node(DEPTH)), DEPTH), lambda r: F.size(r) >= 4)
    found = shapes.select("shape", rings.alias("rings"))
    return found.select("shape", F.when(F.coalesce(F.size("rings"), F.lit(0)) > 0, F.col("rings")).otherwise(F.raise_error(F.concat(F.lit("no polygons in shape "), F.coalesce("shape", F.lit("null"))))).alias("rings"))


def shape_segments(shapes: DataFrame) -> DataFrame:
    """(shape, value) rows of GeoJSON text as segments."""
    ring = shape_rings(shapes).select("shape", F.posexplode("rings").alias("ring", "r"))
    return segments(ring.select("shape", "ring", F.posexplode("r").alias("i", "p")).select("shape", "ring", "i", F.col("p")[0].alias("lon"), F.col("p")[1].alias("lat")))


def catalogue_entries(bodies: DataFrame, format_prefix: str) -> DataFrame:
    """Archives of peers' catalogues (peer, body); bodies whose format doesn't begin with the prefix that the caller knows are refused."""
    parsed = bodies.select("peer", F.from_json("body", CATALOGUE).alias("c")).filter(F.col("c.format").startswith(format_prefix))
    return parsed.select("peer", F.explode("c.archives").alias("a")).select("peer", "a.*")


def catalogue_export(catalog: DataFrame, name: str = "archives/1", category: str | None = None) -> DataFrame:
    """One JSON line for each published archive (null `published`: it is), of one category if one is asked for, after a line with the format's name and how many follow."""
    rows = catalog
    if "published" in catalog.columns:
        rows = rows.filter(F.coalesce("published", F.lit(True)))
    if category is not None:
        rows = rows.filter(F.exists("categories", lambda c: F.lower(c) == category.lower()))
    head = rows.agg(F.count(F.lit(1)).alias("count")).select(F.lit(0).alias("nth"), F.to_json(F.struct(F.lit(name).alias("format"), "count")).alias("value"))
    return head.unionByName(rows.select(F.lit(1).alias("nth"), F.to_json(F.struct(F.col("info_hash").cast("string").alias("infoHash"), "name", "size", "categories")).alias("value")))
