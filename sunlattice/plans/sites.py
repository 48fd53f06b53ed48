"""Heights, plants, rings, where walks begin and end, exposure of routes and points."""

from __future__ import annotations

import math

from pyspark.sql import functions as F

from sunlattice.functions import geometry
from sunlattice.operators import graph, placement, raster, sequences, sites
from sunlattice.plans import flows, ordered, rasters, relations
from sunlattice.plans.registry import query
from sunlattice.session import table

INSIDE_SQL = f"""{relations.RINGS_SQL}, {relations.POINTS_SQL}, smp AS (SELECT id AS rid, x AS rx, y AS ry, (110 + id % 45)::DOUBLE AS z FROM c), gnd AS (SELECT rx, ry, (100 + rid % 9)::DOUBLE AS z FROM s),
hit AS (SELECT e.id, rid, any_value(z) AS z, any_value(rx) AS rx, any_value(ry) AS ry FROM smp JOIN e ON (ay > ry) <> (by_ > ry) AND rx < ax + (bx - ax) * (ry - ay) / (by_ - ay) GROUP BY ALL HAVING count(*) % 2 = 1)"""


def _survey(spark, sf_dir):
    points, ground = relations._points(spark, sf_dir)
    samples = points.select(F.col("id").alias("rid"), F.col("x").alias("rx"), F.col("y").alias("ry"), (110 + F.col("id") % 45).cast("double").alias("z"))
    buildings = relations._rings(spark, sf_dir).withColumn("part", F.lit(0)).withColumn("fallback", (10 + F.col("id") % 7).cast("double"))
    return buildings, samples, ground.withColumn("z", (100 + F.col("rid") % 9).cast("double"))


@query(f"""WITH {INSIDE_SQL}, l AS (SELECT id, quantile_cont(z, 0.75) AS z FROM hit GROUP BY 1), m AS (SELECT id, avg(ax) AS x, avg(ay) AS y FROM e GROUP BY 1),
g AS (SELECT m.id, median(z) AS z, count(*) AS n FROM m JOIN gnd ON (x - rx) * (x - rx) + (y - ry) * (y - ry) <= 1600 GROUP BY 1)
SELECT m.id, round(CASE WHEN l.z IS NULL THEN 10 + m.id % 7 ELSE greatest(2.5, least(80, l.z - CASE WHEN g.n >= 3 THEN g.z ELSE (SELECT median(z) FROM gnd) END)) END, 6) AS height, CASE WHEN l.z IS NULL THEN 'fallback' ELSE 'survey' END AS source
FROM m LEFT JOIN l USING (id) LEFT JOIN g USING (id)""")
def survey_heights(spark, sf_dir):
    """Heights of buildings from survey points inside them."""
    return sites.survey_heights(*_survey(spark, sf_dir)).select("id", F.round("height", 6).alias("height"), "source")


@query(f"""WITH {INSIDE_SQL}, r2 AS (SELECT * FROM smp WHERE rid NOT IN (SELECT rid FROM hit)),
g AS (SELECT r2.rid, median(gnd.z) AS z, count(*) AS n FROM r2 JOIN gnd ON (r2.rx - gnd.rx) * (r2.rx - gnd.rx) + (r2.ry - gnd.ry) * (r2.ry - gnd.ry) <= 1600 GROUP BY 1),
h AS (SELECT rid, r2.z - CASE WHEN g.n >= 3 THEN g.z ELSE (SELECT median(z) FROM gnd) END AS h FROM r2 LEFT JOIN g USING (rid)) SELECT rid, round(least(80, h), 6) AS height FROM h WHERE h >= 2.5""")
def unmapped_volumes(spark, sf_dir):
    """Survey volumes in no mapped building."""
    return sites.unmapped_volumes(*_survey(spark, sf_dir)).select("rid", F.round("height", 6).alias("height"))


@query(f"""WITH {relations.RINGS_SQL}, q AS (SELECT id, sum(ax * by_ - bx * ay) / 2 AS a, sum((ax + bx) * (ax * by_ - bx * ay)) AS sx, sum((ay + by_) * (ax * by_ - bx * ay)) AS sy FROM e GROUP BY 1),
d AS (SELECT id, abs(a) AS area, sx / (6 * a) AS x, sy / (6 * a) AS y, abs(a) * CASE WHEN id % 5 <> 0 THEN id % 5 ELSE greatest(1, round_even((10 + id) / 4.0, 0)) END AS raw FROM q),
k AS (SELECT * FROM d WHERE x BETWEEN 0 AND 300 AND y BETWEEN 0 AND 150 AND sqrt((x - 100) * (x - 100) + (y - 40) * (y - 40)) >= 30),
n AS (SELECT id, unnest([id, id + 5, id * 3 % 40, id]) AS node FROM k), f AS (SELECT id, count(*) AS doors FROM n JOIN supplier ON node = s_suppkey AND s_suppkey % 3 = 0 GROUP BY 1)
SELECT k.id, round(x, 6) AS x, round(y, 6) AS y, round(area, 6) AS area, round(raw / sum(raw) OVER (), 8) AS w, coalesce(doors, 1) AS doors FROM k LEFT JOIN f USING (id)""")
def walk_destinations(spark, sf_dir):
    """Buildings that people walk to, with weights and doors."""
    k = F.col("id")
    buildings = relations._rings(spark, sf_dir).select(k, "ring", F.array(k, k + 5, k * 3 % 40, k).cast("array<long>").alias("nodes"), (k % 5).cast("double").alias("levels"), (10 + k).cast("double").alias("height"))
    entrances = table(spark, sf_dir, "supplier").filter("s_suppkey % 3 = 0").select(F.col("s_suppkey").alias("id"), *relations._xy("s_suppkey"))
    found = sites.walk_destinations(buildings, entrances, (0.0, 300.0, 0.0, 150.0), [(100.0, 40.0, 30.0)])
    return found.select("id", *[F.round(c, 6).alias(c) for c in ("x", "y", "area")], F.round("w", 8).alias("w"), F.size("doors").cast("long").alias("doors"))


@query()
def walk_origins(spark, sf_dir):
    """Stops that walks begin at, with weights; tested against brute force."""
    k = F.col("c_custkey")
    kind = F.element_at(F.array(*[F.lit(x) for x in ("metro", "train", "tram", "bus", "metro_entrance")]), (k % 5 + 1).cast("int"))
    stops = table(spark, sf_dir, "customer").select(k.alias("id"), kind.alias("kind"), F.concat(F.lit("stop "), (k % 40).cast("string")).alias("name"), *relations._xy("c_custkey"))
    return sites.walk_origins(stops, (250.0, 350.0, 250.0, 350.0), {"metro": 0.55, "train": 0.2, "tram": 0.15, "bus": 0.1}, cutoff=200.0, radius=60.0, gain=20.0, merge=30.0, entrance=25.0)


@query()
def merged_plants(spark, sf_dir):
    """Plants of a map, a census, rows and a survey, each once; tested against brute force."""
    c, s = relations._points(spark, sf_dir)
    mapped = s.select(F.col("rid").alias("id"), F.col("rx").alias("x"), F.col("ry").alias("y"), (F.col("rid") % 4 * 5).cast("double").alias("h"), F.lit(None).cast("double").alias("crown"), (F.col("rid") % 7 == 0).alias("evergreen"))
    census = c.withColumn("h", (F.col("id") % 25).cast("double")).withColumn("crown", (F.col("id") % 9).cast("double"))
    row = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("id"), *relations._xy("s_suppkey"))
    o = row.select("id", F.col("x").alias("ax"), F.col("y").alias("ay"), (F.col("x") + 5 + F.col("id") % 23).alias("bx"), (F.col("y") + F.col("id") % 19).alias("by"))
    stems = sequences.stems(o, 4.0).select((F.col("id") * 1000 + F.col("k")).alias("id"), "x", "y")
    survey = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), *relations._xy("p_partkey"))
    return sites.merged_plants(mapped, census, stems, survey)


@query("""WITH c AS (SELECT l_partkey % 50 AS i, l_orderkey % 40 AS j, l_orderkey * 10 + l_linenumber AS ordinal, l_linenumber % 3 AS kind, l_quantity AS h FROM lineitem),
m AS (SELECT i, j, max(ordinal) FILTER (kind = 1) AS emptied FROM c GROUP BY ALL)
SELECT i, j, coalesce(max(h) FILTER (kind = 2 OR kind = 0 AND (emptied IS NULL OR ordinal > emptied)), 0) AS h FROM c JOIN m USING (i, j) GROUP BY ALL""")
def ring_holes(spark, sf_dir):
    """Heights on cells under buildings with holes and without."""
    kind = F.element_at(F.array(F.lit("outer"), F.lit("inner"), F.lit("simple")), (F.col("l_linenumber") % 3 + 1).cast("int"))
    line = table(spark, sf_dir, "lineitem")
    return raster.paint_rings(line.select((F.col("l_partkey") % 50).alias("i"), (F.col("l_orderkey") % 40).alias("j"), (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("ordinal"), kind.alias("kind"), F.col("l_quantity").alias("h")))


@query("""WITH c AS (SELECT l_linenumber AS month, l_suppkey * 7 % 60 AS i, l_partkey * 11 % 60 AS j, (l_partkey + l_orderkey) % 5 <> 0 AS ground, l_discount AS hours FROM lineitem),
p AS (SELECT n_nationkey AS name, n_nationkey * 3.0 AS x, n_nationkey * 2.0 + 10 AS y FROM nation)
SELECT name, month, round(avg(hours), 6) AS hours FROM p JOIN c ON ((j + 0.5) * 1.5 - x) * ((j + 0.5) * 1.5 - x) + (90 - (i + 0.5) * 1.5 - y) * (90 - (i + 0.5) * 1.5 - y) <= 225 WHERE ground GROUP BY ALL""")
def disc_sun(spark, sf_dir):
    """Mean sun of the ground within 15 m of points, by month."""
    line = table(spark, sf_dir, "lineitem")
    cells = line.select(F.col("l_linenumber").alias("month"), (F.col("l_suppkey") * 7 % 60).alias("i"), (F.col("l_partkey") * 11 % 60).alias("j"), ((F.col("l_partkey") + F.col("l_orderkey")) % 5 != 0).alias("ground"), F.col("l_discount").alias("hours"))
    k = F.col("n_nationkey")
    points = table(spark, sf_dir, "nation").select(k.alias("name"), (k * 3.0).alias("x"), (k * 2.0 + 10).alias("y"))
    return raster.disc_means(cells, points, 15.0, 0.0, 90.0, 1.5, ["hours"]).select("name", "month", F.round("hours", 6).alias("hours"))


@query(f"""WITH {ordered.SEGMENTS_SQL}, {rasters.GRID_SQL}, s AS (SELECT id, flow, len, ax, ay, bx, by_, m, unnest(generate_series(0, m - 1)) AS k FROM (SELECT *, greatest(2, trunc(len / 2.0::DOUBLE)::BIGINT + 1) AS m FROM n)),
c AS (SELECT id, flow, len, trunc(round((90 - (ay + k / (m - 1)::DOUBLE * (by_ - ay))) / 1.5::DOUBLE, 9))::BIGINT AS i, trunc(round((ax + k / (m - 1)::DOUBLE * (bx - ax)) / 1.5::DOUBLE, 9))::BIGINT AS j FROM s)
SELECT id, round(avg(v), 6) AS sun, round(any_value(flow) * any_value(len) * avg(v), 4) AS exposure FROM c LEFT JOIN grid USING (i, j) GROUP BY id""")
def edge_exposure(spark, sf_dir):
    """Flow times length times mean sun of street segments; null where no sample has sun, the segment stays."""
    seg = ordered._segments(spark, sf_dir)
    s = raster.segment_samples(seg, 2.0).withColumn("i", F.round((90 - F.col("y")) / 1.5, 9).cast("long")).withColumn("j", F.round(F.col("x") / 1.5, 9).cast("long"))
    sun = s.join(rasters._grid(spark, sf_dir), ["i", "j"], "left").groupBy("id").agg(F.first("len").alias("len"), F.avg("v").alias("sun"))
    return sun.join(seg.select("id", "flow"), "id").select("id", F.round("sun", 6).alias("sun"), F.round(F.col("flow") * F.col("len") * F.col("sun"), 4).alias("exposure"))


@query("""SELECT s_suppkey % 10 AS tile, s_suppkey % 2 AS class, CAST((4 + s_suppkey % 3) * (4 + s_suppkey % 3) AS DOUBLE) AS area, count(*) AS n, sum(4)::BIGINT AS corners FROM supplier WHERE s_suppkey % 5 <> 0 GROUP BY ALL""")
def chained_rings(spark, sf_dir):
    """Rings from the loose sides of squares, some turned round; squares that lack a side give none."""
    k, side = F.col("s_suppkey"), 4 + F.col("s_suppkey") % 3
    at = lambda x, y: F.struct((k * 20 + x).cast("double").alias("x"), (k % 50 * 20 + y).cast("double").alias("y"))
    a, b, c, d = at(F.lit(0), F.lit(0)), at(side, F.lit(0)), at(side, side), at(F.lit(0), side)
    sides = F.array(F.struct((k * 8).alias("pos"), F.array(a, b).alias("points")), F.struct((k * 8 + 3).alias("pos"), F.array(c, b).alias("points")), F.struct((k * 8 + 1).alias("pos"), F.array(c, d).alias("points")), F.struct((k * 8 + 5).alias("pos"), F.array(d, a).alias("points")))
    rows = table(spark, sf_dir, "supplier").withColumn("s", F.explode(sides)).filter((k % 5 != 0) | (F.col("s.pos") % 8 != 5))
    rings = sequences.chain_rings(rows.select((k % 10).alias("tile"), (k % 2).alias("class"), "s.pos", "s.points"))
    area = F.abs(geometry.signed_area(F.col("ring")))
    return rings.groupBy("tile", "class", area.alias("area")).agg(F.count("*").alias("n"), F.sum(F.size("ring")).alias("corners"))


@query()
def building_usage(spark, sf_dir):
    """Walks between all pairs of buildings on the edges of their routes; tested against brute force."""
    doors = table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("id"), (F.col("n_nationkey") * 3 % 20 + 1).cast("long").alias("node"), ((F.col("n_nationkey") % 5 + 1) / 75.0).alias("w"))
    edges = graph.undirected(flows._segments(spark, sf_dir)).checkpoint()
    paths = graph.shortest_paths(edges, doors.select(F.col("node").alias("source")).distinct()).checkpoint()
    return graph.pair_usage(paths, doors).select("a", "b", F.round("flow", 8).alias("flow"))


@query()
def seeded_place(spark, sf_dir):
    """Placement with a share of the objects near given places first, and what that costs; tested against brute force."""
    cells = rasters._grid(spark, sf_dir).select(F.lit("tree").alias("kind"), "i", "j", F.col("v").alias("sun"), ((F.col("i") * 7 + F.col("j") * 3) % 11 / 10.0).alias("weight"))
    kernel = [(a, b, math.exp(-(a * a + b * b) / 4.0) * 0.85) for a, b in raster.disc(3.0)]
    seeded = placement.greedy(cells, kernel, 3.0, 20, seeds=((10.0, 10.0, 6.0, 3), (45.0, 30.0, 6.0, 3)))
    return placement.sacrifice(seeded, placement.greedy(cells, kernel, 3.0, 20)).select("kind", "placed", *[F.round(c, 6).alias(c) for c in ("benefit", "benefit_free", "sacrifice")])
