"""Drawings, scenarios, sun cubes and result tables as files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

OBJECTS = "OBJECTS array<struct<object string, entity string, name string, handle string, layer array<bigint>, point array<double>, ins_pt array<double>, points array<array<double>>>>"
#: The fields of a scenario file.
SCENARIO = "name string, trees array<array<double>>, sails array<array<double>>, sail_h double, sail_crown double, sail_cells array<array<double>>, sail_tau double, window array<double>, canopy_area_m2 double, solution string, point string, level double"

#: Heights of sails on posts and of sheets (metres), crown of a sail, share of light through a sheet.
SAIL_HEIGHT, SHEET_HEIGHT, SAIL_CROWN, SHEET_LIGHT = 4.1, 6.0, 6.8, 0.28


def drawing_objects(spark: SparkSession, path: str) -> DataFrame:
    """tile, pos, entity, layer (its name, '?' if unknown), at, points of the objects of drawings in JSON, a file a tile.

    A layer's handle is its last number; an object refers to it by the third of its own.
    """
    rows = spark.read.schema(OBJECTS).json(path, multiLine=True).select(F.col("_metadata.file_path").alias("tile"), F.posexplode("OBJECTS").alias("pos", "o")).select("tile", "pos", "o.*")
    handle = F.regexp_extract("handle", r"(\d+)\D*$", 1).try_cast("bigint")
    layers = rows.filter("object = 'LAYER' and name is not null").groupBy("tile", handle.alias("ref")).agg(F.max_by("name", "pos").alias("found"))
    used = rows.filter("entity is not null").withColumn("ref", F.get("layer", F.lit(2)))
    return used.drop("layer").join(layers, ["tile", "ref"], "left").select("tile", "pos", "entity", F.coalesce("found", F.lit("?")).alias("layer"), F.coalesce("point", "ins_pt").alias("at"), "points")


def ring_rows(objects: DataFrame, layers: list[str]) -> DataFrame:
    """tile, pos, kind, x, y, z for operators.sequences.polylines: heads on other layers close a ring and open none."""
    head = (F.col("entity") == "POLYLINE_3D") & F.col("layer").isin(layers)
    kind = F.when(head, "head").when(F.col("entity").isin("POLYLINE_3D", "SEQEND"), "end").when(F.col("entity") == "VERTEX_3D", "vertex")
    return objects.withColumn("kind", kind).filter("kind is not null").select("tile", "pos", "kind", *[F.get("at", F.lit(k)).alias(c) for k, c in enumerate("xyz")])


def inserted_points(objects: DataFrame, layers: dict[str, str]) -> DataFrame:
    """tile, pos, kind, x, y, z of single points, the kind by their layer."""
    kinds = F.create_map(*[F.lit(v) for kv in layers.items() for v in kv])
    rows = objects.filter("entity = 'INSERT' and at is not null").withColumn("kind", F.try_element_at(kinds, "layer")).filter("kind is not null")
    return rows.select("tile", "pos", "kind", *[F.get("at", F.lit(k)).alias(c) for k, c in enumerate("xyz")])


def boundary_lines(objects: DataFrame, layers: dict[str, str], digits: int = 2) -> DataFrame:
    """tile, class, pos, points (x, y) of flat lines with two points or more, for operators.sequences.chain_rings."""
    kinds = F.create_map(*[F.lit(v) for kv in layers.items() for v in kv])
    rows = objects.filter("entity = 'LWPOLYLINE' and size(points) >= 2").withColumn("class", F.try_element_at(kinds, "layer")).filter("class is not null")
    return rows.select("tile", "class", "pos", F.transform("points", lambda p: F.struct(F.bround(p[0], digits).alias("x"), F.bround(p[1], digits).alias("y"))).alias("points"))


def scenarios(spark: SparkSession, path: str) -> dict[str, DataFrame]:
    """plants (name, x, y, h, crown, evergreen) and sheet cells (name, x, y, h, light) that scenario files, one scenario each, add; sails count as evergreen crowns."""
    rows = spark.read.text(path, wholetext=True).select(F.from_json("value", SCENARIO).alias("s")).select("s.*")
    tree = rows.select("name", F.explode("trees").alias("t")).select("name", *[F.get("t", F.lit(k)).alias(c) for k, c in enumerate(["x", "y", "h", "crown"])], F.lit(False).alias("evergreen"))
    sail = rows.select("name", F.coalesce("sail_h", F.lit(SAIL_HEIGHT)).alias("h"), F.coalesce("sail_crown", F.lit(SAIL_CROWN)).alias("crown"), F.explode("sails").alias("t"))
    sail = sail.select("name", F.get("t", F.lit(0)).alias("x"), F.get("t", F.lit(1)).alias("y"), "h", "crown", F.lit(True).alias("evergreen"))
    sheet = rows.select("name", F.coalesce("sail_h", F.lit(SHEET_HEIGHT)).alias("h"), F.coalesce("sail_tau", F.lit(SHEET_LIGHT)).alias("light"), F.explode("sail_cells").alias("t"))
    return {"plants": tree.unionByName(sail), "sheets": sheet.select("name", F.get("t", F.lit(0)).alias("x"), F.get("t", F.lit(1)).alias("y"), "h", "light")}


def write_cube(cells: DataFrame, path: str) -> None:
    """Cells (scenario, month, i, j, hours, insol, midday), in folders by scenario and month."""
    cells.repartition("scenario", "month").write.partitionBy("scenario", "month").mode("overwrite").parquet(path)


def read_cube(spark: SparkSession, path: str, months: tuple[int, ...] = (6, 7, 8)) -> DataFrame:
    """scenario, i, j and the mean of the months that are asked for; other months' folders are not read."""
    cells = spark.read.parquet(path).filter(F.col("month").isin(*months))
    return cells.groupBy("scenario", "i", "j").agg(*[F.avg(c).alias(c) for c in ("hours", "insol", "midday") if c in cells.columns])


def write_features(rows: DataFrame, path: str) -> None:
    """Points (lon, lat, properties) as GeoJSON features, one a line."""
    geometry = F.struct(F.lit("Point").alias("type"), F.array("lon", "lat").alias("coordinates"))
    rows.select(F.to_json(F.struct(F.lit("Feature").alias("type"), geometry.alias("geometry"), F.col("properties"))).alias("value")).write.mode("overwrite").text(path)


def markdown_rows(rows: DataFrame, digits: dict[str, int]) -> DataFrame:
    """A column `line`: each row of a result as a row of a Markdown table, numbers with their digits."""
    cells = [F.format_number(F.col(f"`{c}`"), digits[c]) if c in digits else F.col(f"`{c}`").cast("string") for c in rows.columns]
    return rows.select(F.concat(F.lit("| "), F.concat_ws(" | ", *[F.coalesce(c, F.lit("-")) for c in cells]), F.lit(" |")).alias("line"))


def write_flows(path: str, edges: DataFrame, origins: DataFrame, destinations: DataFrame) -> None:
    """The result of a routing as three tables in a folder; a later run replaces them."""
    for name, rows in (("edges", edges), ("origins", origins), ("destinations", destinations)):
        rows.write.mode("overwrite").parquet(f"{path}/{name}")
    origins.groupBy("mode").agg(F.sum("w").alias("w")).write.mode("overwrite").parquet(f"{path}/modal_split")


def read_flows(spark: SparkSession, path: str, name: str = "edges") -> DataFrame:
    """edges, origins, destinations or modal_split of a routing."""
    return spark.read.parquet(f"{path}/{name}")


def write_scenarios(rows: DataFrame, path: str) -> None:
    """Scenarios (name and any of the fields of SCENARIO) as JSON, one a line; fields without a value are left out."""
    rows.select(F.to_json(F.struct(*[F.col(f"`{c}`") for c in rows.columns])).alias("value")).write.mode("overwrite").text(path)


def write_drawing(path: str, rings: DataFrame, points: DataFrame, covers: DataFrame) -> None:
    """What is read off drawings, as tables: rings by layer, points by kind, flat rings by class."""
    for name, rows, part in (("rings", rings, "layer"), ("points", points, "kind"), ("covers", covers, "class")):
        rows.write.mode("overwrite").partitionBy(part).parquet(f"{path}/{name}")


def read_drawing(spark: SparkSession, path: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{path}/{name}")


def element_counts(rows: DataFrame, kind: str) -> DataFrame:
    """How many rows of each kind there are, and how many have nothing in each column."""
    return rows.groupBy(kind).agg(F.count("*").alias("n"), *[F.count(F.when(F.col(f"`{c}`").isNull(), 1)).alias(f"no_{c}") for c in rows.columns if c != kind])
