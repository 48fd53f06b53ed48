"""Site models from maps, surveys and censuses: heights, plants, where walks begin and end."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sunlattice.functions import attributes, geometry
from sunlattice.operators import sequences, spatial

#: Heights of survey volumes are held to these (metres).
LOWEST, HIGHEST = 2.5, 80.0


def survey_heights(buildings: DataFrame, samples: DataFrame, ground: DataFrame, radius: float = 40.0) -> DataFrame:
    """id, height, source of buildings (id, part, ring, fallback), the rows of one building being its outer rings.

    Heights are the third quartile of the levels of the samples (rid, rx, ry, z)
    inside, above the ground near the corner mean of the first ring; 'fallback'
    where no sample is inside.
    """
    inside = spatial.in_rings(buildings.select("id", "part", "ring"), samples)
    level = inside.groupBy("id").agg(F.percentile("z", F.lit(0.75)).alias("z"))
    first = buildings.groupBy("id").agg(F.min_by("ring", "part").alias("ring"), F.min_by("fallback", "part").alias("fallback"))
    cx, cy = geometry.corner_mean(F.col("ring"))
    found = first.join(level, "id").withColumn("x", cx).withColumn("y", cy)
    base = spatial.local_median(found.select("id", "x", "y"), ground, radius).select("id", F.col("z").alias("base"))
    known = found.join(base, "id").select("id", F.greatest(F.lit(LOWEST), F.least(F.lit(HIGHEST), F.col("z") - F.col("base"))).alias("survey"))
    return first.join(known, "id", "left").select("id", F.coalesce("survey", "fallback").alias("height"), F.when(F.col("survey").isNotNull(), "survey").otherwise("fallback").alias("source"))


def unmapped_volumes(buildings: DataFrame, volumes: DataFrame, ground: DataFrame, radius: float = 40.0) -> DataFrame:
    """rid, height of survey volumes (rid, rx, ry, z) in no building that stand out of the ground."""
    inside = spatial.in_rings(buildings.select("id", "part", "ring"), volumes).select("rid").distinct()
    rest = volumes.join(inside, "rid", "left_anti").select(F.col("rid").alias("id"), F.col("rx").alias("x"), F.col("ry").alias("y"), F.col("z").alias("top"))
    base = spatial.local_median(rest.select("id", "x", "y"), ground, radius).select("id", F.col("z").alias("base"))
    rows = rest.join(base, "id").withColumn("h", F.col("top") - F.col("base")).filter(F.col("h") >= LOWEST)
    return rows.select(F.col("id").alias("rid"), F.least(F.lit(HIGHEST), F.col("h")).alias("height"))


def merged_plants(mapped: DataFrame, census: DataFrame, stems: DataFrame, survey: DataFrame, reach: float = 8.0) -> DataFrame:
    """source, key, x, y, h, crown, evergreen of plants from four sources, in their order; what is too near to a kept one goes.

    mapped (id, x, y, h, crown, evergreen) and census (id, x, y, h, crown); stems
    and survey (id, x, y). Mapped and survey plants take what they lack from the
    nearest census tree within reach, whose own row then is not used again if a
    mapped tree took it; what is still missing is the census median. Heights
    under 2 m and crowns under 1 m in the census, and zeros, are missing.
    """
    known = census.select(F.col("id").alias("rid"), F.col("x").alias("rx"), F.col("y").alias("ry"), F.when(F.col("h") >= 2, F.col("h")).alias("ch"), F.when(F.col("crown") >= 1, F.col("crown")).alias("cc"))
    middle = spatial.whole_median(known, "ch", "cc").withColumnsRenamed({"ch": "mh", "cc": "mc"})

    def near(points: DataFrame) -> DataFrame:
        return spatial.nearest_within(points.select("id", "x", "y"), known.select("rid", "rx", "ry"), reach).join(known.select("rid", "ch", "cc"), "rid").select("id", "rid", "ch", "cc")

    def rows(points: DataFrame, source: int, apart: float, h, crown, evergreen) -> DataFrame:
        return points.select(F.struct(F.lit(source).alias("source"), F.col("id").cast("long").alias("key")).alias("id"), "x", "y", h.alias("h"), crown.alias("crown"), F.coalesce(evergreen, F.lit(False)).alias("evergreen"), F.lit(apart).alias("apart"))

    none, no = F.lit(None).cast("double"), F.lit(False)
    of_mapped = near(mapped).checkpoint()
    fill = lambda own, other: F.coalesce(attributes.present(F.col(own)), F.col(other))
    unused = known.join(of_mapped.select("rid").distinct(), "rid", "left_anti").select(F.col("rid").alias("id"), F.col("rx").alias("x"), F.col("ry").alias("y"), "ch", "cc")
    parts = [
        rows(mapped.join(of_mapped, "id", "left"), 0, 0.0, fill("h", "ch"), fill("crown", "cc"), F.col("evergreen")),
        rows(unused, 1, 4.0, F.col("ch"), F.col("cc"), no),
        rows(stems, 2, 3.5, none, none, no),
        rows(survey.join(near(survey), "id", "left"), 3, 8.0, F.col("ch"), F.col("cc"), no),
    ]
    all_ = parts[0].union(parts[1]).union(parts[2]).union(parts[3]).checkpoint()
    kept = spatial.first_wins_within(all_, 8.0)
    # One row of medians.
    kept = kept.withColumn("one", F.lit(1)).join(F.broadcast(middle.withColumn("one", F.lit(1))), "one")
    return kept.select("id.source", "id.key", "x", "y", F.coalesce("h", "mh").alias("h"), F.coalesce("crown", "mc").alias("crown"), "evergreen")


def walk_origins(stops: DataFrame, extent: tuple[float, float, float, float], split: dict[str, float], cutoff: float = 650.0, radius: float = 300.0, gain: float = 50.0, merge: float = 60.0, entrance: float = 150.0) -> DataFrame:
    """mode, name, x, y, w: where walks begin, from stops (id, kind, name, x, y) near an extent (xmin, xmax, ymin, ymax).

    Tram and bus stops of one name are merged first. Stops beyond the cutoff go,
    and those that a stop of their mode clearly nearer to the extent makes
    needless. A mode's share is dealt evenly over its stops, a metro station's
    over its entrances; shares of modes without stops go to the others.
    """
    away = geometry.rectangle_distance(F.col("x"), F.col("y"), *extent)
    parts = None
    for mode in split:
        of = stops.filter(F.col("kind") == mode).select("id", "name", "x", "y")
        if mode in ("tram", "bus"):
            of = sequences.cluster_named(of, merge).select(F.col("cluster").alias("id"), "name", "x", "y")
        of = spatial.undominated(of.withColumn("d", away).filter(F.col("d") < cutoff).checkpoint(), radius, gain)
        of = of.select(F.lit(mode).alias("mode"), "id", "name", "x", "y")
        parts = of if parts is None else parts.unionByName(of)
    parts = parts.checkpoint()
    # Pairs of places, with the number of doors at one: rows a stop and door are made last and not shuffled.
    spots = stops.filter("kind = 'metro_entrance'").groupBy(F.col("x").alias("rx"), F.col("y").alias("ry")).agg(F.count("*").alias("doors"))
    near = spatial.near_join(parts.filter("mode = 'metro'").select("x", "y").distinct(), spots, entrance, inclusive=False).drop("d2")
    near = near.groupBy("x", "y").agg(F.collect_list(F.struct("rx", "ry", "doors")).alias("near"), F.sum("doors").alias("n")).withColumn("mode", F.lit("metro"))
    share = F.create_map(*[F.lit(v) for kv in split.items() for v in kv])
    # A row a mode.
    sizes = parts.groupBy("mode").agg(F.count_distinct("id").alias("stops")).withColumn("share", share[F.col("mode")])
    total = sizes.agg(F.sum("share").alias("total")).withColumn("one", F.lit(1))
    sizes = sizes.withColumn("one", F.lit(1)).join(F.broadcast(total), "one")
    rows = parts.join(near, ["mode", "x", "y"], "left").join(F.broadcast(sizes), "mode")
    rows = rows.select("mode", "name", "x", "y", (F.col("share") / F.col("total") / F.col("stops") / F.coalesce("n", F.lit(1))).alias("w"), F.explode_outer("near").alias("near"))
    rows = rows.withColumn("again", F.explode(F.sequence(F.lit(1), F.coalesce("near.doors", F.lit(1)))))
    return rows.select("mode", "name", F.coalesce("near.rx", "x").alias("x"), F.coalesce("near.ry", "y").alias("y"), "w")


def walk_destinations(buildings: DataFrame, entrances: DataFrame, extent: tuple[float, float, float, float], excluded: list[tuple[float, float, float]] = ()) -> DataFrame:
    """id, x, y, area, w, doors of buildings (id, ring, nodes, levels, height): weight by area times storeys.

    Those whose centre is out of the extent or nearer to an excluded place than
    its radius (x, y, r) are left out. Doors are the entrances (id, x, y) among a
    building's nodes, in their order, repeated ones repeatedly; else the centre.
    """
    cx, cy = geometry.centroid(F.col("ring"))
    rows = buildings.withColumn("x", cx).withColumn("y", cy).withColumn("area", F.abs(geometry.signed_area(F.col("ring"))))
    rows = rows.filter(geometry.in_box(F.col("x"), F.col("y"), *extent))
    for x, y, r in excluded:
        rows = rows.filter(geometry.distance(F.col("x"), F.col("y"), F.lit(x), F.lit(y)) >= r)
    rows = rows.withColumn("raw", F.col("area") * attributes.floors(F.col("levels"), F.col("height")))
    at = rows.select("id", F.posexplode("nodes").alias("pos", "node")).join(entrances.select(F.col("id").alias("node"), F.col("x").alias("ex"), F.col("y").alias("ey")), "node")
    doors = at.groupBy("id").agg(F.sort_array(F.collect_list(F.struct("pos", "ex", "ey"))).alias("found"))
    # One row.
    total = rows.agg(F.sum("raw").alias("total")).withColumn("one", F.lit(1))
    rows = rows.join(doors, "id", "left").withColumn("one", F.lit(1)).join(F.broadcast(total), "one")
    listed = F.coalesce(F.transform("found", lambda d: F.struct(d.ex.alias("x"), d.ey.alias("y"))), F.array(F.struct("x", "y")))
    return rows.select("id", "x", "y", "area", F.try_divide("raw", "total").alias("w"), listed.alias("doors"))
