"""Zones around chosen buildings: their cells, what is near them, and the plants inside."""

from __future__ import annotations

from math import pi

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sunlattice.functions import geometry
from sunlattice.operators import layers


def kept_building(named: Column, ring: Column, excluded: list[tuple[float, float, float]] = ()) -> Column:
    """Whether a named building's mean corner is in none of the excluded discs (x, y, r), their edge not included.

    Not known to be named, or without corners: no.
    """
    mean = lambda c: F.aggregate(ring, F.lit(0.0), lambda a, p: a + p[c]) / F.nullif(F.size(ring), F.lit(0))
    out = F.coalesce(named, F.lit(False)) & mean("x").isNotNull() & mean("y").isNotNull()
    for x, y, r in excluded:
        out &= geometry.distance(mean("x"), mean("y"), F.lit(x), F.lit(y)) >= r
    return F.coalesce(out, F.lit(False))


def building_cells(buildings: DataFrame, roofs: DataFrame, xmin: float, ymax: float, res: float, ny: int, nx: int) -> DataFrame:
    """i, j of roofs (i, j) under buildings (ordinal, rings of role and ring).

    Of the rings over a cell the last decides: buildings by ordinal, within each the
    inner rings after all others, else in their order. That is not the order in
    which heights are painted. No buildings or roofs give no cells.
    """
    each = buildings.select("ordinal", F.posexplode("rings").alias("k", "r"))
    inner = F.coalesce(F.col("r.role") == "inner", F.lit(False))
    rings = each.select((F.col("ordinal") * layers.RINGS + F.col("k")).cast("long").alias("id"), F.struct(F.col("ordinal"), inner.alias("inner"), F.col("k")).alias("turn"), F.col("r.ring").alias("ring"))
    last = layers.ring_cells(rings, xmin, ymax, res, ny, nx).groupBy("i", "j").agg(F.max("turn").alias("turn"))
    return last.filter(~F.col("turn.inner")).select("i", "j").join(roofs.select("i", "j"), ["i", "j"], "left_semi")


def within(cells: DataFrame, radius: float, ny: int, nx: int) -> DataFrame:
    """Distinct i, j of a grid of ny by nx whose centre is within `radius` (in cells) of a cell's, the edge included.

    By runs: each run of neighbours in a row reaches a run in each of the rows
    around it, and runs that touch are joined before they become cells. So
    2 * radius + 1 rows are made a run, in place of a disc a cell. A window holds one
    row of the grid. Rows without a place count for nothing, repeated ones once.
    """
    row = Window.partitionBy("i").orderBy("j")
    one = cells.filter("i is not null and j is not null").select(F.col("i").cast("long").alias("i"), F.col("j").cast("long").alias("j")).distinct()
    runs = one.withColumn("run", F.col("j") - F.row_number().over(row)).groupBy("i", "run").agg(F.min("j").alias("first"), F.max("j").alias("last"))
    most = int(radius)
    reach = F.floor(F.sqrt(F.lit(float(radius) ** 2) - F.col("d") * F.col("d")))
    spans = runs.withColumn("d", F.explode(F.sequence(F.lit(-most), F.lit(most)))).select((F.col("i") + F.col("d")).alias("i"), F.greatest(F.col("first") - reach, F.lit(0)).alias("first"), F.least(F.col("last") + reach, F.lit(nx - 1)).alias("last"))
    spans = spans.filter(F.col("i").between(0, ny - 1) & (F.col("first") <= F.col("last")))
    # Runs of a row that begin alike are one before they are sorted.
    spans = spans.groupBy("i", "first").agg(F.max("last").alias("last"))
    along = Window.partitionBy("i").orderBy("first")
    before = F.max("last").over(along.rowsBetween(Window.unboundedPreceding, -1))
    parts = spans.withColumn("fresh", F.coalesce(F.col("first") > before + 1, F.lit(True)).cast("int")).withColumn("part", F.sum("fresh").over(along))
    joined = parts.groupBy("i", "part").agg(F.min("first").alias("first"), F.max("last").alias("last"))
    return joined.select("i", F.explode(F.sequence("first", "last")).alias("j"))


def zone(buildings: DataFrame, roofs: DataFrame, xmin: float, ymax: float, res: float, ny: int, nx: int, metres: float = 60.0) -> DataFrame:
    """i, j of the ground within `metres` of buildings (ordinal, rings); roofs (i, j) are no ground."""
    near = within(building_cells(buildings, roofs, xmin, ymax, res, ny, nx), metres / res, ny, nx)
    return near.join(roofs.select("i", "j"), ["i", "j"], "left_anti")


def plants_inside(plants: DataFrame, cells: DataFrame, xmin: float, ymax: float, res: float) -> DataFrame:
    """The plants (x, y, ...) whose cell is one of cells (i, j); each repeated plant stays, one without a place does not."""
    i, j = geometry.cell_of(F.col("x"), F.col("y"), xmin, ymax, res)
    row = "cell"
    while row in plants.columns:
        row += "_"
    rows = plants.withColumn(row, F.struct(i.cast("long").alias("i"), j.cast("long").alias("j")))
    return rows.join(cells.select(F.struct(F.col("i").cast("long").alias("i"), F.col("j").cast("long").alias("j")).alias(row)), row, "left_semi").select(*plants.columns)


def green_totals(inside: DataFrame, new_plants: DataFrame, new_sheets: DataFrame, crown: float, side: float, share: float) -> DataFrame:
    """scenario, plants, canopy_m2: plants inside a zone, and what is added by plants (of a crown's width) or sheets (of a side, of which a share shades).

    All new plants count, wherever they are; sheets add no plant. Three rows, with 0 for empty tables.
    """
    n = lambda rows, name: rows.agg(F.count("*").alias(name))
    # Three rows of one number each.
    one = n(inside, "had").join(n(new_plants, "p")).join(n(new_sheets, "s"))
    rows = F.array(
        F.struct(F.lit("baseline").alias("scenario"), F.col("had").alias("plants"), F.lit(0.0).alias("canopy_m2")),
        F.struct(F.lit("trees").alias("scenario"), (F.col("had") + F.col("p")).alias("plants"), (F.col("p") * (pi * (crown / 2) ** 2)).alias("canopy_m2")),
        F.struct(F.lit("sails").alias("scenario"), F.col("had").alias("plants"), (F.col("s") * (side * side * share)).alias("canopy_m2")),
    )
    return one.select(F.inline(rows))
