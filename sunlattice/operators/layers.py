"""The layers of a grid from what was surveyed and mapped: rings to spans of cells, buildings and crowns to heights, areas and roads to ground classes."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sunlattice.functions import attributes
from sunlattice.operators import areas, raster

#: Fixed order of painting: a later class of an area goes over an earlier one.
AREA_ORDER = ("grass", "sport", "asphalt", "water")
AREA_CLASS = {"grass": raster.GRASS, "sport": raster.SPORT, "asphalt": raster.ASPHALT, "water": raster.WATER}
#: Classes of surveyed surfaces.
SURVEYED = ("footpath", "asphalt", "sport", "water", "grass")
#: Rings of one building at most: orders of rings are told apart by it.
RINGS = 1 << 20


def ring_spans(rings: DataFrame, xmin: float, ymax: float, res: float, ny: int, nx: int) -> DataFrame:
    """The columns of rings but `ring`, with i, first and last: runs of columns of each row whose centres are in the ring.

    rings: ring (corners x, y) and other columns, `id` telling rings apart. Scan
    lines: each edge gives its crossing of the rows that it passes, a row's
    crossings are sorted, and every second gap between them is inside. So the work
    follows the outline and what is in it, not the box. A centre on a crossing
    belongs to what is right of it. Rings close themselves; those of under three
    corners, or with a null one, have no cells.
    """
    keep = [c for c in rings.columns if c != "ring"]
    n, ring = F.size("ring"), F.col("ring")
    whole = rings.filter(n > 2).filter(~F.exists(ring, lambda p: p.x.isNull() | p.y.isNull()))
    edge = F.explode(F.transform(F.sequence(F.lit(0), n - 1), lambda k: F.struct(ring[k].x.alias("ax"), ring[k].y.alias("ay"), ring[(k + 1) % n].x.alias("bx"), ring[(k + 1) % n].y.alias("by"))))
    edges = whole.select(*keep, edge.alias("e")).select(*keep, "e.*").filter("ay <> by")
    # A row more at each end, as the test below decides.
    row = lambda y, more: F.floor((ymax - y) / res - 0.5) + more
    edges = edges.withColumns({"top": F.greatest(row(F.greatest("ay", "by"), 0), F.lit(0)), "low": F.least(row(F.least("ay", "by"), 1), F.lit(ny - 1))}).filter("top <= low")
    y = ymax - (F.col("i") + 0.5) * res
    crossed = edges.withColumn("i", F.explode(F.sequence("top", "low"))).filter((F.col("ay") > y) != (F.col("by") > y))
    at = F.col("ax") + (F.col("bx") - F.col("ax")) * F.try_divide(y - F.col("ay"), F.col("by") - F.col("ay"))
    # As many as the ring has edges, at most.
    lines = crossed.groupBy(*keep, "i").agg(F.sort_array(F.collect_list(at)).alias("c"))
    pair = F.explode(F.transform(F.sequence(F.lit(0), F.floor(F.size("c") / 2).cast("int") - 1), lambda k: F.struct(F.col("c")[2 * k].alias("lo"), F.col("c")[2 * k + 1].alias("hi"))))
    gaps = lines.select(*keep, "i", pair.alias("g")).select(*keep, "i", "g.*")
    centre = lambda j: xmin + (j + 0.5) * res
    step = lambda x: F.ceil((x - xmin) / res - 0.5)

    def least(x: Column) -> Column:
        """The first column whose centre is at x or right of it."""
        j = step(x)
        return F.when(centre(j - 1) >= x, j - 1).when(centre(j) >= x, j).otherwise(j + 1)

    spans = gaps.select(*keep, F.col("i").cast("long").alias("i"), F.greatest(least(F.col("lo")), F.lit(0)).alias("first"), F.least(least(F.col("hi")) - 1, F.lit(nx - 1)).alias("last"))
    return spans.filter("first <= last")


def ring_cells(rings: DataFrame, xmin: float, ymax: float, res: float, ny: int, nx: int) -> DataFrame:
    """The columns of rings but `ring`, with i and j of each cell whose centre is in the ring."""
    spans = ring_spans(rings, xmin, ymax, res, ny, nx)
    return spans.withColumn("j", F.explode(F.sequence("first", "last"))).drop("first", "last")


def building_rings(buildings: DataFrame, volumes: DataFrame) -> DataFrame:
    """id, kind, h, ring of buildings (ordinal, height, rings of role and ring) and of surveyed volumes (id, height, ring).

    A building of several rings, or whose first is an inner one, is painted ring by
    ring in order; of any other its only ring counts. `id` follows the order of
    painting; volumes come after all.
    """
    several = (F.size("rings") > 1) | (F.col("rings")[0].role == "inner")
    each = buildings.select("ordinal", "height", several.alias("several"), F.posexplode("rings").alias("k", "r"))
    kind = F.when(~F.col("several"), "simple").when(F.col("r.role") == "outer", "outer").otherwise("inner")
    own = each.select((F.col("ordinal") * RINGS + F.col("k")).cast("long").alias("id"), kind.alias("kind"), F.col("height").cast("double").alias("h"), F.col("r.ring").alias("ring"))
    # Volumes only ever raise a cell, so their order does not matter; negative ids keep them apart.
    return own.unionByName(volumes.select((-1 - F.col("id")).cast("long").alias("id"), F.lit("simple").alias("kind"), F.col("height").cast("double").alias("h"), "ring"))


def heights(buildings: DataFrame, volumes: DataFrame, plants: DataFrame, xmin: float, ymax: float, res: float, ny: int, nx: int) -> DataFrame:
    """i, j, roof, green_top, green_bottom, leaf_top, leaf_bottom of the cells under anything; null where a kind has nothing.

    buildings and volumes as in `building_rings`; plants: x, y, h, crown,
    evergreen (null: no). Plants without a place, height or crown are left out, and
    so is what lies beyond the grid. One aggregate puts the layers together.
    """
    grid = (xmin, ymax, res, ny, nx)
    under = ring_cells(building_rings(buildings, volumes), *grid).withColumnRenamed("id", "ordinal")
    roofs = raster.paint_rings(under).filter("h > 0")
    rooted = plants.filter("x is not null and y is not null and h is not null and crown is not null")
    rooted = rooted.select((F.col("x") - xmin).alias("x"), (ymax - F.col("y")).alias("y"), "h", "crown", F.coalesce("evergreen", F.lit(False)).alias("evergreen"))
    none = F.lit(None).cast("double")
    parts = [roofs.select("i", "j", F.col("h").alias("roof"), *[none.alias(c) for c in ("green_top", "green_bottom", "leaf_top", "leaf_bottom")])]
    for kind, own in (("green", rooted.filter("evergreen")), ("leaf", rooted.filter("not evergreen"))):
        crown = raster.stamp_crowns(own, res).filter(F.col("i").between(0, ny - 1) & F.col("j").between(0, nx - 1))
        named = {f"{kind}_top": F.col("top"), f"{kind}_bottom": F.col("bottom")}
        parts.append(crown.select("i", "j", *[named.get(c, none).alias(c) for c in ("roof", "green_top", "green_bottom", "leaf_top", "leaf_bottom")]))
    every = reduce(DataFrame.unionByName, parts)
    return every.groupBy("i", "j").agg(*[F.max(c).alias(c) for c in ("roof", "green_top", "green_bottom", "leaf_top", "leaf_bottom")])


def road_class(kind: Column) -> Column:
    """Class of the ground that a road is painted with; null for what is no road."""
    return F.when(areas.road_width(kind).isNotNull(), F.when(kind.isin(*areas.WALKED), raster.FOOTPATH).otherwise(raster.ASPHALT))


def road_stamps(segments: DataFrame, xmin: float, ymax: float, res: float) -> DataFrame:
    """ordinal, class, i, j under discs of half a road's width along segments (ordinal of the road, kind, ax, ay, bx, by); one of no length is a single disc."""
    length = F.hypot(F.col("bx") - F.col("ax"), F.col("by") - F.col("ay"))
    rows = segments.withColumns({"half": areas.road_width(F.col("kind")) / 2, "class": road_class(F.col("kind")), "len": length}).filter("half is not null and len is not null")
    # Steps of a cell, as far as half a cell beyond the end, where they are held to it.
    rows = rows.withColumn("k", F.explode(F.sequence(F.lit(0), F.greatest(F.ceil((F.col("len") + res / 2) / res) - 1, F.lit(0)))))
    f = F.when(F.col("len") > 0, F.least(F.col("k") * res / F.col("len"), F.lit(1.0))).otherwise(0.0)
    rows = rows.select("ordinal", "class", "half", (F.col("ax") + f * (F.col("bx") - F.col("ax"))).alias("x"), (F.col("ay") + f * (F.col("by") - F.col("ay"))).alias("y"))
    return areas.discs(rows, xmin, ymax, res, "half").select("ordinal", "class", "i", "j")


def covers(mapped: DataFrame, roads: DataFrame, survey: DataFrame, roofs: DataFrame, xmin: float, ymax: float, res: float, ny: int, nx: int) -> DataFrame:
    """i, j, cover of the cells under anything; all others are paved.

    mapped: id, tags, ring of land areas. roads: ordinal, kind, ax, ay, bx, by.
    survey: id, class, ring of surveyed surfaces. roofs: i, j. The order of painting
    is told by what counts of each layer in a cell: the last class of areas, the
    road of the highest ordinal, each surveyed class, a roof. So one aggregate
    does it. Other tags, kinds and classes paint nothing.
    """
    grid = (xmin, ymax, res, ny, nx)
    rank = F.array_position(F.array(*[F.lit(c) for c in AREA_ORDER]), attributes.ground_class(F.col("tags"))).cast("int")
    land = ring_cells(mapped.select("id", rank.alias("rank"), "ring").filter("rank > 0"), *grid).select("i", "j", "rank")
    way = road_stamps(roads, xmin, ymax, res).filter(F.col("i").between(0, ny - 1) & F.col("j").between(0, nx - 1)).select("i", "j", F.struct("ordinal", "class").alias("road"))
    seen = ring_cells(survey.filter(F.col("class").isin(*SURVEYED)).select("id", "class", "ring"), *grid).select("i", "j", F.col("class").alias("surveyed"))
    every = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), [land, way, seen, roofs.select("i", "j", F.lit(True).alias("roof"))])
    has = lambda c: F.coalesce(F.bool_or(F.col("surveyed") == c), F.lit(False)).alias(f"has_{c}")
    folded = every.groupBy("i", "j").agg(F.max("rank").alias("rank"), F.max("road").alias("road"), *[has(c) for c in SURVEYED], F.coalesce(F.bool_or("roof"), F.lit(False)).alias("roof"))
    area = F.try_element_at(F.array(*[F.lit(AREA_CLASS[c]) for c in AREA_ORDER]), F.col("rank"))
    cover = raster.paint_cover(area, F.col("road.class"), *[F.col(f"has_{c}") for c in SURVEYED], F.col("roof"))
    return folded.select("i", "j", cover.cast("int").alias("cover"))
