"""Areas and masks as tables of cells, and what is told of them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sunlattice.functions import geometry
from sunlattice.operators import spatial

#: Widths of roads (metres) by class, and the classes that are walked on.
ROAD_WIDTH = {"motorway": 16.0, "trunk": 14.0, "primary": 12.0, "secondary": 10.0, "tertiary": 8.0, "unclassified": 6.0, "residential": 6.0, "living_street": 5.0, "service": 4.0, "track": 3.0, "pedestrian": 5.0, "footway": 2.5, "cycleway": 2.5, "path": 2.0, "steps": 2.0}
WALKED = ("pedestrian", "footway", "path", "steps")


def road_width(kind: Column) -> Column:
    """Width by class; null for what is no road."""
    return F.try_element_at(F.create_map(*[F.lit(v) for kv in ROAD_WIDTH.items() for v in kv]), kind)


def polygon_cells(rings: DataFrame, xmin: float, ymax: float, res: float, ny: int, nx: int) -> DataFrame:
    """id, i, j: cells of a grid whose centre is in a ring (id, ring), from each ring's own box."""
    x, y = (F.transform("ring", lambda p: p[c]) for c in ("x", "y"))
    span = lambda low, high, most: F.sequence(F.greatest(F.lit(0), F.least(F.lit(most - 1), F.floor(low / res).cast("int"))), F.greatest(F.lit(0), F.least(F.lit(most - 1), F.floor(high / res).cast("int"))))
    cells = rings.withColumn("i", F.explode(span(ymax - F.array_max(y), ymax - F.array_min(y), ny))).withColumn("j", F.explode(span(F.array_min(x) - xmin, F.array_max(x) - xmin, nx)))
    inside = geometry.contains(F.col("ring"), xmin + (F.col("j") + 0.5) * res, ymax - (F.col("i") + 0.5) * res)
    return cells.filter(inside).select("id", F.col("i").cast("long").alias("i"), F.col("j").cast("long").alias("j"))


def road_cells(segments: DataFrame, xmin: float, ymax: float, res: float) -> DataFrame:
    """Distinct kind, i, j under discs of half a road's width every cell along segments (kind, ax, ay, bx, by); unknown kinds are no roads."""
    half = road_width(F.col("kind")) / 2
    length = F.hypot(F.col("bx") - F.col("ax"), F.col("by") - F.col("ay"))
    rows = segments.withColumns({"half": half, "len": length}).filter("half is not null and len > 0")
    rows = rows.withColumn("k", F.explode(F.sequence(F.lit(0), F.floor(F.col("len") / res + 0.5).cast("int"))))
    f = F.least(F.col("k") * res / F.col("len"), F.lit(1.0))
    rows = rows.select("kind", "half", (F.col("ax") + f * (F.col("bx") - F.col("ax"))).alias("x"), (F.col("ay") + f * (F.col("by") - F.col("ay"))).alias("y"))
    return discs(rows, xmin, ymax, res, "half").select("kind", "i", "j").distinct()


def discs(points: DataFrame, xmin: float, ymax: float, res: float, radius: str) -> DataFrame:
    """Rows of points (x, y, a radius) for each cell whose centre is in their disc, the edge included."""
    r = F.col(radius)
    span = lambda a: F.sequence(F.floor((a - r) / res).cast("long"), F.floor((a + r) / res).cast("long"))
    near = points.withColumn("i", F.explode(span(F.lit(ymax) - F.col("y")))).withColumn("j", F.explode(span(F.col("x") - xmin)))
    dx, dy = xmin + (F.col("j") + 0.5) * res - F.col("x"), ymax - (F.col("i") + 0.5) * res - F.col("y")
    return near.filter(dx * dx + dy * dy <= r * r)


def crown_squares(crowns: DataFrame, xmin: float, ymax: float, res: float, ny: int, nx: int) -> DataFrame:
    """Distinct i, j in the squares around the cells of crowns (x, y, r); crowns outside the grid count for nothing."""
    i, j = geometry.cell_of(F.col("x"), F.col("y"), xmin, ymax, res)
    rows = crowns.select(i.alias("ci"), j.alias("cj"), F.greatest(F.lit(1), F.bround(F.col("r") / res).cast("int")).alias("k")).filter(F.col("ci").between(0, ny - 1) & F.col("cj").between(0, nx - 1))
    rows = rows.withColumn("di", F.explode(F.sequence(-F.col("k"), F.col("k")))).withColumn("dj", F.explode(F.sequence(-F.col("k"), F.col("k"))))
    out = rows.select((F.col("ci") + F.col("di")).cast("long").alias("i"), (F.col("cj") + F.col("dj")).cast("long").alias("j"))
    return out.filter(F.col("i").between(0, ny - 1) & F.col("j").between(0, nx - 1)).distinct()


def flagged(cells: DataFrame, **masks: DataFrame) -> DataFrame:
    """cells (i, j) with a boolean column for each mask (i, j): unions, differences and common parts are then expressions."""
    for name, mask in masks.items():
        cells = cells.join(mask.select("i", "j").distinct().withColumn(name, F.lit(True)), ["i", "j"], "left").withColumn(name, F.coalesce(name, F.lit(False)))
    return cells


def candidates(cells: DataFrame, campus: DataFrame, corridor: DataFrame, crowns: DataFrame, near_roofs: DataFrame, paved: tuple[int, ...], green: tuple[int, ...], bonus: float = 0.12, least_sun: float = 0.3) -> DataFrame:
    """i, j, weight, free_plant, free_sail of cells (i, j, cover, roof, sun, flow): where objects of each kind may stand.

    The weight is the flow against its maximum, and a bonus for walkable ground
    near the campus; roofs have none. Objects keep off roofs, crowns and dark
    cells; plants keep off what is near roofs too.
    """
    rows = flagged(cells, campus=campus, corridor=corridor, crown=crowns, near=near_roofs)
    top = cells.agg(F.max("flow").alias("top")).withColumn("one", F.lit(1))
    rows = rows.withColumn("one", F.lit(1)).join(F.broadcast(top), "one")
    walkable = F.col("cover").isin(*paved, *green) & ~F.col("roof")
    weight = F.col("flow") / F.greatest("top", F.lit(1e-9)) + F.when(F.col("campus") & walkable, bonus).otherwise(0.0)
    free = (F.col("campus") | F.col("corridor")) & ~F.col("roof") & ~F.col("crown") & (F.col("sun") > least_sun)
    return rows.select("i", "j", F.when(F.col("roof"), 0.0).otherwise(weight).alias("weight"), (free & ~F.col("near") & F.col("cover").isin(*paved, *green)).alias("free_plant"), (free & F.col("cover").isin(*paved)).alias("free_sail"))


def ground_areas(areas: DataFrame, roofs: DataFrame, xmin: float, ymax: float, res: float) -> DataFrame:
    """id, cells (on the ground), cx, cy: the mean of the ground cells of each area (id, i, j), of all its cells where none is on the ground."""
    marked = areas.join(roofs.select("i", "j").distinct().withColumn("roof", F.lit(True)), ["i", "j"], "left")
    x, y, ground = xmin + (F.col("j") + 0.5) * res, ymax - (F.col("i") + 0.5) * res, F.col("roof").isNull()
    mean = lambda v: F.coalesce(F.avg(F.when(ground, v)), F.avg(v))
    return marked.groupBy("id").agg(F.count(F.when(ground, 1)).alias("cells"), mean(x).alias("cx"), mean(y).alias("cy"))


def union_centre(areas: DataFrame, roofs: DataFrame, xmin: float, ymax: float, res: float) -> DataFrame:
    """One row, cells and their mean cx, cy, of the union of areas without roofs: a cell in several areas counts once."""
    union = areas.select("i", "j").distinct().join(roofs.select("i", "j"), ["i", "j"], "left_anti")
    return union.agg(F.count("*").alias("cells"), F.avg(xmin + (F.col("j") + 0.5) * res).alias("cx"), F.avg(ymax - (F.col("i") + 0.5) * res).alias("cy"))


def clipped(edges: DataFrame, rings: DataFrame) -> DataFrame:
    """Edges (id, ax, ay, bx, by, ...) whose middle is in a ring (id, ring)."""
    middle = edges.select(F.col("id").alias("rid"), ((F.col("ax") + F.col("bx")) / 2).alias("rx"), ((F.col("ay") + F.col("by")) / 2).alias("ry"))
    inside = spatial.in_rings(rings.withColumn("part", F.lit(0)), middle).select(F.col("rid").alias("id")).distinct()
    return edges.join(inside, "id", "left_semi")


def thin_labels(rows: DataFrame, apart: float, least: float) -> DataFrame:
    """Rows (name, x, y, w) to label: w of `least` or more, the heaviest of a name, none nearer than `apart` to a heavier one that is kept."""
    own = Window.partitionBy("name").orderBy(F.desc("w"), "x", "y")
    one = rows.filter(F.col("w") >= least).withColumn("place", F.row_number().over(own)).filter("place = 1").drop("place")
    # One row a name from here on.
    ordered = one.withColumn("id", F.row_number().over(Window.orderBy(F.desc("w"), "name")).cast("long"))
    return spatial.first_wins(ordered, apart).drop("id")
