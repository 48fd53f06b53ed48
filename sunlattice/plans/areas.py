"""Masks, areas, roads, nearest nodes, doors and what is picked out of results."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from sunlattice.operators import areas, graph, raster
from sunlattice.operators.nearest import nearest
from sunlattice.plans import flows
from sunlattice.plans.registry import query
from sunlattice.plans.relations import POINTS_SQL, RINGS_SQL, _points, _rings, _xy
from sunlattice.session import table

XMIN, YMAX, RES, NY, NX = 0.0, 180.0, 1.5, 120, 340

CELLS_SQL = f"""{RINGS_SQL}, box AS (SELECT id, min(ax) AS x0, max(ax) AS x1, min(ay) AS y0, max(ay) AS y1 FROM e GROUP BY 1),
grid AS (SELECT b.id, i, j, (j + 0.5) * 1.5::DOUBLE AS x, 180 - (i + 0.5) * 1.5::DOUBLE AS y FROM box b, generate_series(0, 119) a(i), generate_series(0, 339) d(j) WHERE (j + 1.5) * 1.5 >= x0 AND (j - 0.5) * 1.5 <= x1 AND 180 - (i - 0.5) * 1.5 >= y0 AND 180 - (i + 1.5) * 1.5 <= y1),
area AS (SELECT g.id, i, j, any_value(x) AS x, any_value(y) AS y FROM grid g JOIN e ON e.id = g.id AND (ay > y) <> (by_ > y) AND x < ax + (bx - ax) * (y - ay) / (by_ - ay) GROUP BY ALL HAVING count(*) % 2 = 1),
roof AS (SELECT DISTINCT p_partkey * 7 % 120 AS i, p_partkey * 11 % 340 AS j FROM part)"""


def _areas(spark, sf_dir):
    return areas.polygon_cells(_rings(spark, sf_dir), XMIN, YMAX, RES, NY, NX)


def _roofs(spark, sf_dir):
    k = F.col("p_partkey")
    return table(spark, sf_dir, "part").select((k * 7 % NY).alias("i"), (k * 11 % NX).alias("j")).distinct()


@query(f"WITH {CELLS_SQL} SELECT id, i, j FROM area")
def polygon_cells(spark, sf_dir):
    """Cells whose centre is in a polygon."""
    return _areas(spark, sf_dir)


@query(f"""WITH {CELLS_SQL} SELECT id, count(*) FILTER (r.i IS NULL) AS cells, round(coalesce(avg(x) FILTER (r.i IS NULL), avg(x)), 6) AS cx, round(coalesce(avg(y) FILTER (r.i IS NULL), avg(y)), 6) AS cy
FROM area a LEFT JOIN roof r ON r.i = a.i AND r.j = a.j GROUP BY id""")
def activity_areas(spark, sf_dir):
    """Ground cells of areas and their mean place."""
    found = areas.ground_areas(_areas(spark, sf_dir), _roofs(spark, sf_dir), XMIN, YMAX, RES)
    return found.select("id", "cells", F.round("cx", 6).alias("cx"), F.round("cy", 6).alias("cy"))


@query(f"WITH {CELLS_SQL}, u AS (SELECT DISTINCT i, j, x, y FROM area) SELECT count(*) AS cells, round(avg(x), 6) AS cx, round(avg(y), 6) AS cy FROM u WHERE (i, j) NOT IN (SELECT (i, j) FROM roof)")
def activity_centre(spark, sf_dir):
    """Mean place of the ground cells of all areas."""
    found = areas.union_centre(_areas(spark, sf_dir), _roofs(spark, sf_dir), XMIN, YMAX, RES)
    return found.select("cells", F.round("cx", 6).alias("cx"), F.round("cy", 6).alias("cy"))


KINDS = ("primary", "residential", "footway", "steps", "proposed")
ROADS_SQL = """w(kind, half) AS (VALUES ('primary', 6.0::DOUBLE), ('residential', 3.0::DOUBLE), ('footway', 1.25::DOUBLE), ('steps', 1.0::DOUBLE)),
seg AS (SELECT ['primary', 'residential', 'footway', 'steps', 'proposed'][s_suppkey % 5 + 1] AS kind, (s_suppkey * 13 % 307)::DOUBLE AS ax, (s_suppkey * 29 % 173)::DOUBLE AS ay, (s_suppkey * 13 % 307 + s_suppkey % 17)::DOUBLE AS bx, (s_suppkey * 29 % 173 + s_suppkey % 11)::DOUBLE AS by_ FROM supplier),
l AS (SELECT seg.*, half, sqrt((bx - ax) * (bx - ax) + (by_ - ay) * (by_ - ay)) AS len FROM seg JOIN w USING (kind)),
p AS (SELECT kind, half, ax + least(k * 1.5 / len, 1) * (bx - ax) AS x, ay + least(k * 1.5 / len, 1) * (by_ - ay) AS y FROM (SELECT *, unnest(generate_series(0, floor(len / 1.5 + 0.5)::BIGINT)) AS k FROM l WHERE len > 0)),
c AS (SELECT kind, half, x, y, floor((180 - y) / 1.5)::BIGINT + di AS i, floor(x / 1.5)::BIGINT + dj AS j FROM p, generate_series(-5, 5) a(di), generate_series(-5, 5) b(dj)),
road AS (SELECT DISTINCT kind, i, j FROM c WHERE ((j + 0.5) * 1.5 - x) * ((j + 0.5) * 1.5 - x) + (180 - (i + 0.5) * 1.5 - y) * (180 - (i + 0.5) * 1.5 - y) <= half * half)"""


@query(f"WITH {ROADS_SQL} SELECT kind, i, j FROM road")
def road_discs(spark, sf_dir):
    """Cells under roads, by class."""
    k = F.col("s_suppkey")
    kind = F.element_at(F.array(*map(F.lit, KINDS)), (k % 5 + 1).cast("int"))
    at = [x.cast("double").alias(n) for x, n in ((k * 13 % 307, "ax"), (k * 29 % 173, "ay"), (k * 13 % 307 + k % 17, "bx"), (k * 29 % 173 + k % 11, "by"))]
    return areas.road_cells(table(spark, sf_dir, "supplier").select(kind.alias("kind"), *at), XMIN, YMAX, RES)


SQUARES_SQL = """crown AS (SELECT DISTINCT ci + di AS i, cj + dj AS j FROM (SELECT trunc((180 - y) / 1.5)::BIGINT AS ci, trunc(x / 1.5)::BIGINT AS cj, greatest(1, round_even(r / 1.5, 0)::BIGINT) AS k FROM (SELECT (s_suppkey * 41 % 530)::DOUBLE AS x, (s_suppkey * 23 % 190)::DOUBLE AS y, (1 + s_suppkey % 7)::DOUBLE AS r FROM supplier)),
 generate_series(-5, 5) a(di), generate_series(-5, 5) b(dj) WHERE ci BETWEEN 0 AND 119 AND cj BETWEEN 0 AND 339 AND abs(di) <= k AND abs(dj) <= k AND ci + di BETWEEN 0 AND 119 AND cj + dj BETWEEN 0 AND 339)"""


def _crowns(spark, sf_dir):
    k = F.col("s_suppkey")
    return table(spark, sf_dir, "supplier").select((k * 41 % 530).cast("double").alias("x"), (k * 23 % 190).cast("double").alias("y"), (1 + k % 7).cast("double").alias("r"))


@query(f"WITH {SQUARES_SQL} SELECT i, j FROM crown")
def crown_squares(spark, sf_dir):
    """Cells that existing crowns keep new objects out of."""
    return areas.crown_squares(_crowns(spark, sf_dir), XMIN, YMAX, RES, NY, NX)


@query(f"""WITH {CELLS_SQL}, {SQUARES_SQL}, flow AS (SELECT o_orderkey * 7 % 120 AS i, o_custkey * 11 % 340 AS j, max(o_totalprice) AS flow FROM orders GROUP BY ALL),
near AS (SELECT DISTINCT i + di AS i, j + dj AS j FROM roof, generate_series(-2, 2) a(di), generate_series(-2, 2) b(dj) WHERE di * di + dj * dj <= 4),
c AS (SELECT x.i, y.j, (x.i * 3 + y.j * 5) % 6 AS cover, r.i IS NOT NULL AS roof, ((x.i * 7 + y.j) % 10) / 10.0::DOUBLE AS sun, coalesce(flow, 0) AS flow, a.i IS NOT NULL AS campus, coalesce(flow, 0) > 150000 AS corridor, k.i IS NOT NULL AS crown, n.i IS NOT NULL AS near
 FROM generate_series(0, 119) x(i) CROSS JOIN generate_series(0, 339) y(j) LEFT JOIN roof r ON r.i = x.i AND r.j = y.j LEFT JOIN flow f ON f.i = x.i AND f.j = y.j LEFT JOIN (SELECT DISTINCT i, j FROM area) a ON a.i = x.i AND a.j = y.j LEFT JOIN crown k ON k.i = x.i AND k.j = y.j LEFT JOIN near n ON n.i = x.i AND n.j = y.j)
SELECT i, j, round(CASE WHEN roof THEN 0 ELSE flow / (SELECT max(flow) FROM c) + CASE WHEN campus AND cover IN (0, 2, 3) THEN 0.12::DOUBLE ELSE 0 END END, 8) AS weight,
 (campus OR corridor) AND NOT roof AND NOT crown AND sun > 0.3 AND NOT near AND cover IN (0, 2, 3) AS free_plant, (campus OR corridor) AND NOT roof AND NOT crown AND sun > 0.3 AND cover IN (0, 2) AS free_sail FROM c""")
def candidate_masks(spark, sf_dir):
    """Where plants and sails may stand, and what a place there is worth."""
    o, roofs = table(spark, sf_dir, "orders"), _roofs(spark, sf_dir)
    flow = o.groupBy((F.col("o_orderkey") * 7 % NY).alias("i"), (F.col("o_custkey") * 11 % NX).alias("j")).agg(F.max("o_totalprice").alias("flow"))
    cells = spark.range(NY * NX).select(F.floor(F.col("id") / NX).alias("i"), (F.col("id") % NX).alias("j")).join(flow, ["i", "j"], "left").withColumn("flow", F.coalesce("flow", F.lit(0.0)))
    cells = areas.flagged(cells, roof=roofs).withColumns({"cover": (F.col("i") * 3 + F.col("j") * 5) % 6, "sun": (F.col("i") * 7 + F.col("j")) % 10 / 10.0})
    found = areas.candidates(cells, _areas(spark, sf_dir), cells.filter("flow > 150000"), areas.crown_squares(_crowns(spark, sf_dir), XMIN, YMAX, RES, NY, NX), raster.dilate(roofs, 2.0), (raster.PAVED, raster.FOOTPATH), (raster.GRASS,))
    return found.select("i", "j", F.round("weight", 8).alias("weight"), "free_plant", "free_sail")


@query(f"""WITH {POINTS_SQL}, d AS (SELECT id, rid, (x - rx) * (x - rx) + (y - ry) * (y - ry) AS d2 FROM c, s) SELECT id, arg_min(rid, (d2, rid)) AS rid, round(min(d2), 6) AS d2 FROM d GROUP BY id""")
def nearest_any(spark, sf_dir):
    """The nearest node of each place, however far it is."""
    points, nodes = _points(spark, sf_dir)
    return nearest(points, nodes.select("rid", "rx", "ry")).select("id", "rid", F.round("d2", 6).alias("d2"))


@query("""WITH c AS (SELECT c_custkey AS id, CASE WHEN c_custkey % 89 <> 1 THEN (c_custkey * 37 % 211) * CASE WHEN c_custkey % 97 = 0 THEN 100000 ELSE 3 END END::DOUBLE AS x, (c_custkey * 61 % 197 * 3)::DOUBLE AS y FROM customer),
s AS (SELECT s_suppkey AS rid, CASE WHEN s_suppkey % 13 <> 0 THEN s_suppkey * 53 % 307 END::DOUBLE AS rx, CASE WHEN s_suppkey % 17 = 0 THEN -1000000 ELSE s_suppkey * 29 % 311 END::DOUBLE AS ry FROM supplier),
d AS (SELECT id, rid, (x - rx) * (x - rx) + (y - ry) * (y - ry) AS d2 FROM c, s WHERE x IS NOT NULL AND rx IS NOT NULL) SELECT id, arg_min(rid, (d2, rid)) AS rid, min(d2) AS d2 FROM d GROUP BY id""")
def nearest_outliers(spark, sf_dir):
    """The nearest node where places lie far off or have none."""
    c, s = F.col("c_custkey"), F.col("s_suppkey")
    points = table(spark, sf_dir, "customer").select(c.alias("id"), F.when(c % 89 != 1, c * 37 % 211 * F.when(c % 97 == 0, 100000).otherwise(3)).cast("double").alias("x"), (c * 61 % 197 * 3).cast("double").alias("y"))
    nodes = table(spark, sf_dir, "supplier").select(s.alias("rid"), F.when(s % 13 != 0, s * 53 % 307).cast("double").alias("rx"), F.when(s % 17 == 0, -1000000).otherwise(s * 29 % 311).cast("double").alias("ry"))
    return nearest(points, nodes)


@query(f"""WITH {RINGS_SQL}, g AS (SELECT o_orderkey AS id, o_totalprice AS w, ((o_custkey * 37 % 211) * 3.0::DOUBLE + (o_custkey * 37 % 211) * 3.0::DOUBLE + 4) / 2 AS x, ((o_custkey * 61 % 197) * 3.0::DOUBLE + (o_custkey * 61 % 197) * 3.0::DOUBLE - 2) / 2 AS y FROM orders),
h AS (SELECT DISTINCT q.gid FROM (SELECT g.id AS gid, e.id AS rid FROM g JOIN e ON (ay > y) <> (by_ > y) AND x < ax + (bx - ax) * (y - ay) / (by_ - ay) GROUP BY ALL HAVING count(*) % 2 = 1) q)
SELECT count(*) AS edges, round(sum(w * x) / sum(w), 6) AS cx, round(sum(w * y) / sum(w), 6) AS cy FROM g WHERE id IN (SELECT gid FROM h)""")
def clipped_centre(spark, sf_dir):
    """Centre of the flows whose middle is in the areas that are looked at."""
    x, y = _xy("o_custkey")
    edges = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), F.col("o_totalprice").alias("w"), x, y).select("id", "w", F.col("x").alias("ax"), F.col("y").alias("ay"), (F.col("x") + 4).alias("bx"), (F.col("y") - 2).alias("by"))
    kept = areas.clipped(edges, _rings(spark, sf_dir).select("id", "ring"))
    mean = lambda a, b: F.round(F.try_divide(F.sum(F.col("w") * (F.col(a) + F.col(b)) / 2), F.sum("w")), 6)
    return kept.agg(F.count("*").alias("edges"), mean("ax", "bx").alias("cx"), mean("ay", "by").alias("cy"))


@query("SELECT o_orderpriority AS mode, count(DISTINCT o_orderstatus) AS n, array_to_string(list_sort(list(DISTINCT o_orderstatus)), ',') AS lines FROM orders GROUP BY 1")
def lines_by_mode(spark, sf_dir):
    """The set of lines of each mode, in order."""
    lines = F.sort_array(F.collect_set("o_orderstatus"))
    return table(spark, sf_dir, "orders").groupBy(F.col("o_orderpriority").alias("mode")).agg(F.size(lines).cast("long").alias("n"), F.array_join(lines, ",").alias("lines"))


TOTALS_SQL = "t AS (SELECT s_nationkey AS area, round(sum(s_acctbal), 2) AS total, max(s_acctbal) - min(s_acctbal) AS gap FROM supplier GROUP BY 1)"


def _totals(spark, sf_dir):
    return table(spark, sf_dir, "supplier").groupBy(F.col("s_nationkey").alias("area")).agg(F.round(F.sum("s_acctbal"), 2).alias("total"), (F.max("s_acctbal") - F.min("s_acctbal")).alias("gap"))


@query(f"WITH {TOTALS_SQL}, top AS (SELECT * FROM t ORDER BY total DESC, area LIMIT 12) SELECT area, total, row_number() OVER (ORDER BY total, area DESC) AS place FROM top")
def top_reversed(spark, sf_dir):
    """The twelve largest, smallest first, as a chart lists them."""
    top = _totals(spark, sf_dir).orderBy(F.desc("total"), "area").limit(12)
    return top.select("area", "total", F.row_number().over(Window.orderBy("total", F.desc("area"))).cast("long").alias("place"))


@query(f"WITH {TOTALS_SQL} SELECT area, total FROM t ORDER BY total DESC, area LIMIT 3")
def top_priorities(spark, sf_dir):
    """The three areas to begin with."""
    return _totals(spark, sf_dir).orderBy(F.desc("total"), "area").limit(3).select("area", "total")


@query(f"WITH {TOTALS_SQL} SELECT area, round(gap, 2) AS gap FROM t ORDER BY gap DESC, area LIMIT 1")
def largest_gap(spark, sf_dir):
    """Where two solutions differ most."""
    best = _totals(spark, sf_dir).agg(F.max(F.struct("gap", (-F.col("area")).alias("neg"))).alias("best"))
    return best.select((-F.col("best.neg")).alias("area"), F.round("best.gap", 2).alias("gap"))


DOORS_SQL = f"""{flows.EDGES_SQL}, o AS (SELECT n_nationkey AS id, n_nationkey * 3 % 20 + 1 AS node, (n_nationkey % 5 + 1) / 75.0::DOUBLE AS w FROM nation),
d AS (SELECT s_suppkey AS id, unnest([s_suppkey % 80 + 1, s_suppkey * 7 % 80 + 1, 5000 + s_suppkey]) AS node, (s_suppkey % 9 + 1)::DOUBLE AS w FROM supplier)"""


@query(f"""WITH RECURSIVE {DOORS_SQL}, r(root, node) AS (SELECT DISTINCT node, node FROM o WHERE node IN (SELECT u FROM both_) UNION SELECT r.root, e.v FROM r JOIN both_ e ON e.u = r.node),
t AS (SELECT r.root AS source, d.id, d.node, d.w / count(*) OVER (PARTITION BY r.root, d.id) AS w FROM r JOIN d ON d.node = r.node), f AS (SELECT node AS source, sum(w) AS w FROM o GROUP BY 1)
SELECT t.source, t.node, round(sum(t.w * f.w), 8) AS w FROM t JOIN f USING (source) GROUP BY ALL""")
def door_trips(spark, sf_dir):
    """Trips from stops to the doors of buildings that can be reached, a building's weight split over them."""
    k, s = F.col("n_nationkey"), F.col("s_suppkey")
    origins = table(spark, sf_dir, "nation").select(k.alias("id"), (k * 3 % 20 + 1).cast("long").alias("node"), ((k % 5 + 1) / 75.0).alias("w"))
    doors = table(spark, sf_dir, "supplier").select(s.alias("id"), F.explode(F.array(s % 80 + 1, s * 7 % 80 + 1, 5000 + s)).alias("node"), (s % 9 + 1).cast("double").alias("w"))
    edges = graph.undirected(flows._segments(spark, sf_dir)).checkpoint()
    known = edges.select(F.explode(F.array("a", "b")).alias("source")).distinct()
    paths = graph.shortest_paths(edges, origins.select(F.col("node").alias("source")).distinct().join(known, "source", "left_semi")).checkpoint()
    trips = graph.door_trips(paths, origins, doors)
    return trips.select("source", "node", F.round("w", 8).alias("w"))


@query()
def label_places(spark, sf_dir):
    """Stops to label on a map; tested against brute force."""
    c = table(spark, sf_dir, "customer").select(F.concat(F.lit("stop "), (F.col("c_custkey") % 90).cast("string")).alias("name"), *_xy("c_custkey"), (F.abs("c_acctbal") / 10000).alias("w"))
    return areas.thin_labels(c, 170.0, 0.03)
