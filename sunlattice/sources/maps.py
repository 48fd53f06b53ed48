"""Map dumps and GeoJSON: element tables, and the layers that they split into.

A dump is one JSON document a file; a folder of dumps is read in parallel, a
file a task. Fields that are missing are null, and elements without what a
layer needs are in no layer.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sunlattice.functions import attributes

_LINE = "array<struct<lat double, lon double>>"
ELEMENTS = f"elements array<struct<type string, id bigint, lat double, lon double, tags map<string, string>, nodes array<bigint>, geometry {_LINE}, members array<struct<role string, geometry {_LINE}>>>>"
FEATURES = "features array<struct<geometry struct<type string, coordinates string>, properties map<string, string>>>"


def elements(spark: SparkSession, *paths: str) -> DataFrame:
    """part, file, pos, type, id, lat, lon, tags, nodes, geometry, members of the elements of dumps, one path after the other."""
    out = None
    for part, path in enumerate(paths):
        rows = spark.read.schema(ELEMENTS).json(path, multiLine=True).select(F.lit(part).alias("part"), F.col("_metadata.file_path").alias("file"), F.posexplode("elements").alias("pos", "e"))
        rows = rows.select("part", "file", "pos", "e.*").withColumn("tags", F.coalesce("tags", F.expr("map()").cast("map<string,string>")))
        out = rows if out is None else out.unionByName(rows)
    return out


def tag(name: str) -> Column:
    return F.try_element_at("tags", F.lit(name))


def split_map(rows: DataFrame) -> dict[str, DataFrame]:
    """buildings (rings of role and pts), plants, tree_rows and roads (line); an element goes to the first layer whose tag it has."""
    where = ("part", "file", "pos", "id", "tags")
    drawn = F.filter(F.coalesce("members", F.array().cast(rows.schema["members"].dataType)), lambda m: m.geometry.isNotNull())
    rings = F.when((F.col("type") == "way") & F.col("geometry").isNotNull(), F.array(F.struct(F.lit("outer").alias("role"), F.col("geometry").alias("pts"))))
    rings = rings.when(F.col("type") == "relation", F.transform(drawn, lambda m: F.struct(F.coalesce(m.role, F.lit("outer")).alias("role"), m.geometry.alias("pts"))))
    layer = attributes.first_match([(tag("building").isNotNull(), "building"), (tag("natural") == "tree", "tree"), ((tag("natural") == "tree_row") & F.col("geometry").isNotNull(), "tree_row"), (tag("highway").isNotNull() & F.col("geometry").isNotNull(), "road")])
    rows = rows.withColumn("layer", layer)
    of = lambda name: rows.filter(F.col("layer") == name)
    return {
        "buildings": of("building").withColumn("rings", rings).filter(F.size("rings") > 0).select(*where, "rings"),
        "plants": of("tree").select(*where, "lat", "lon"),
        "tree_rows": of("tree_row").select(*where, F.col("geometry").alias("line")),
        "roads": of("road").select(*where, F.col("geometry").alias("line"), tag("highway").alias("highway")),
    }


def split_transit(rows: DataFrame) -> dict[str, DataFrame]:
    """nodes with their kind of stop, ways that have a highway tag, tags of routes."""
    nodes = rows.filter("type = 'node'").select("part", "file", "pos", "id", "lat", "lon", "tags", F.coalesce(tag("name"), F.lit("?")).alias("name"), attributes.stop_kind(F.col("tags")).alias("kind"))
    ways = rows.filter((F.col("type") == "way") & tag("highway").isNotNull()).select("part", "file", "pos", "id", "tags", "nodes", "geometry")
    return {"nodes": nodes, "ways": ways, "routes": rows.filter("type = 'relation'").select("part", "file", "pos", "id", "tags")}


def walk_segments(ways: DataFrame) -> DataFrame:
    """u, v, their places, cost factor and tags of the segments of ways that people may walk, in order of the ways.

    Ways whose nodes and places differ in number are left out.
    """
    fit = ways.filter(attributes.walkable(F.col("tags")) & (F.size("nodes") == F.size("geometry")) & (F.size("nodes") > 1))
    pair = F.transform(F.sequence(F.lit(0), F.size("nodes") - 2), lambda k: F.struct(k.alias("k"), F.col("nodes")[k].alias("u"), F.col("nodes")[k + 1].alias("v"), F.col("geometry")[k].alias("a"), F.col("geometry")[k + 1].alias("b")))
    rows = fit.withColumn("s", F.explode(pair))
    highway = tag("highway")
    return rows.select(F.struct("part", "file", "pos", "s.k").alias("ordinal"), "s.u", "s.v", "s.a", "s.b", attributes.cost_factor(highway).alias("factor"), F.struct(F.coalesce(tag("name"), F.lit("")).alias("name"), highway.alias("highway"), attributes.covered(F.col("tags")).alias("covered")).alias("tag"))


def _features(spark: SparkSession, path: str) -> DataFrame:
    rows = spark.read.schema(FEATURES).json(path, multiLine=True)
    rows = rows.select(F.col("_metadata.file_path").alias("file"), F.posexplode("features").alias("pos", "f"))
    return rows.select("file", "pos", F.col("f.geometry.type").alias("type"), F.col("f.geometry.coordinates").alias("coordinates"), F.col("f.properties").alias("properties"))


def feature_points(spark: SparkSession, path: str) -> DataFrame:
    """file, pos, lon, lat, properties of point features; further coordinates are left, a missing one is null."""
    at = F.from_json("coordinates", "array<double>")
    return _features(spark, path).filter("type = 'Point'").select("file", "pos", F.get(at, F.lit(0)).alias("lon"), F.get(at, F.lit(1)).alias("lat"), "properties")


def feature_rings(spark: SparkSession, path: str, lines: bool = False) -> DataFrame:
    """file, pos, ring (lon, lat), properties of polygons, by their outer ring; lines too if they are asked for."""
    outer = F.get(F.from_json("coordinates", "array<array<array<double>>>"), F.lit(0))
    pts = F.when(F.col("type") == "Polygon", outer)
    if lines:
        pts = pts.when(F.col("type") == "LineString", F.from_json("coordinates", "array<array<double>>"))
    rows = _features(spark, path).withColumn("pts", pts).filter("pts is not null")
    return rows.select("file", "pos", F.transform("pts", lambda p: F.struct(F.get(p, F.lit(0)).alias("lon"), F.get(p, F.lit(1)).alias("lat"))).alias("ring"), "properties")
