"""Grids: sampling, stamping, painting, spreading, shadows and placement."""

from __future__ import annotations

import math

from pyspark.sql import functions as F

from sunlattice.operators import placement, raster
from sunlattice.plans.registry import query
from sunlattice.session import table

RES, NY, NX = 1.5, 60, 60
SUNS = [(0, 12.0, 95.0), (1, 35.0, 140.0), (2, 55.0, 180.0), (3, 20.0, 262.0)]

GRID_SQL = "grid AS (SELECT l_partkey % 60 AS i, l_orderkey % 60 AS j, max(l_quantity) AS v FROM lineitem GROUP BY ALL)"
HEIGHTS_SQL = """cells AS (SELECT i, j FROM generate_series(0, 59) a(i), generate_series(0, 59) b(j)),
heights AS (SELECT c.i, c.j, coalesce(o.h, 0) AS h FROM cells c LEFT JOIN (SELECT s_suppkey * 7 % 60 AS i, s_suppkey * 11 % 60 AS j, max(s_suppkey % 18 + 2)::DOUBLE AS h FROM supplier GROUP BY ALL) o ON o.i = c.i AND o.j = c.j)"""


def _grid(spark, sf_dir):
    line = table(spark, sf_dir, "lineitem")
    return line.groupBy((F.col("l_partkey") % 60).alias("i"), (F.col("l_orderkey") % 60).alias("j")).agg(F.max("l_quantity").alias("v"))


def _heights(spark, sf_dir):
    """i, j, h over the whole grid; 0 where nothing stands."""
    cells = spark.range(NY * NX).select(F.floor(F.col("id") / NX).alias("i"), (F.col("id") % NX).alias("j"))
    objects = table(spark, sf_dir, "supplier").groupBy((F.col("s_suppkey") * 7 % 60).alias("i"), (F.col("s_suppkey") * 11 % 60).alias("j")).agg(F.max(F.col("s_suppkey") % 18 + 2).cast("double").alias("h"))
    return cells.join(objects, ["i", "j"], "left").withColumn("h", F.coalesce("h", F.lit(0.0)))


@query(f"""WITH {GRID_SQL}, e AS (SELECT o_orderkey AS id, (o_custkey % 59 * 1.5)::DOUBLE AS ax, (o_orderkey % 59 * 1.5)::DOUBLE AS ay, (o_custkey * 7 % 59 * 1.5)::DOUBLE AS bx, (o_orderkey * 3 % 59 * 1.5)::DOUBLE AS by_ FROM orders),
n AS (SELECT *, sqrt((bx - ax) * (bx - ax) + (by_ - ay) * (by_ - ay)) AS len, greatest(2, trunc(sqrt((bx - ax) * (bx - ax) + (by_ - ay) * (by_ - ay)) / 2.0::DOUBLE)::INT + 1) AS n FROM e),
s AS (SELECT id, len, k, ax + k / (n - 1)::DOUBLE * (bx - ax) AS x, ay + k / (n - 1)::DOUBLE * (by_ - ay) AS y FROM (SELECT *, unnest(generate_series(0, n - 1)) AS k FROM n)),
c AS (SELECT id, len, k, trunc(round((90 - y) / 1.5, 9))::BIGINT AS i, trunc(round(x / 1.5, 9))::BIGINT AS j FROM s)
SELECT id, count(*) AS samples, count(v) AS hits, round(any_value(len), 6) AS length, round(avg(v), 6) AS mean FROM c LEFT JOIN grid USING (i, j) GROUP BY id""")
def segment_sampling(spark, sf_dir):
    """Mean value of the cells along street segments; null where no sample has one, the segment stays."""
    o = table(spark, sf_dir, "orders")
    c, k = F.col("o_custkey"), F.col("o_orderkey")
    seg = o.select(k.alias("id"), (c % 59 * 1.5).alias("ax"), (k % 59 * 1.5).alias("ay"), (c * 7 % 59 * 1.5).alias("bx"), (k * 3 % 59 * 1.5).alias("by"))
    s = raster.segment_samples(seg, 2.0)
    # Nine decimals settle samples on a cell's edge alike everywhere.
    s = s.withColumn("i", F.round((90 - F.col("y")) / RES, 9).cast("long")).withColumn("j", F.round(F.col("x") / RES, 9).cast("long"))
    return s.join(_grid(spark, sf_dir), ["i", "j"], "left").groupBy("id").agg(F.count("*").alias("samples"), F.count("v").alias("hits"), F.round(F.first("len"), 6).alias("length"), F.round(F.avg("v"), 6).alias("mean"))


@query("""WITH t AS (SELECT (s_suppkey * 13 % 97)::DOUBLE AS x, (s_suppkey * 29 % 89)::DOUBLE AS y, greatest(3, least(30, s_suppkey % 40))::DOUBLE AS h, greatest(1, least(8, (s_suppkey % 21) / 2.0))::DOUBLE AS r FROM supplier),
u AS (SELECT *, greatest(2, 0.35::DOUBLE * h) AS b FROM t), c AS (SELECT u.*, i, j, (((j + 0.5) * 1.5 - x) * ((j + 0.5) * 1.5 - x) + ((i + 0.5) * 1.5 - y) * ((i + 0.5) * 1.5 - y)) / (r * r) AS rr
 FROM u, generate_series(-10, 75) a(i), generate_series(-10, 75) d(j))
SELECT i, j, round(max(b + (h - b) / 2 + (h - b) / 2 * sqrt(1 - rr)), 6) AS top, round(min(b + (h - b) / 2 - (h - b) / 2 * sqrt(1 - rr)), 6) AS bottom FROM c WHERE rr <= 1 GROUP BY ALL""")
def crown_stamp(spark, sf_dir):
    """Tree crowns as ellipsoids on cells."""
    k = F.col("s_suppkey")
    plants = table(spark, sf_dir, "supplier").select((k * 13 % 97).cast("double").alias("x"), (k * 29 % 89).cast("double").alias("y"), (k % 40).cast("double").alias("h"), (k % 21).cast("double").alias("crown"))
    return raster.stamp_crowns(plants, RES).select("i", "j", F.round("top", 6).alias("top"), F.round("bottom", 6).alias("bottom"))


@query("""WITH l AS (SELECT p_partkey AS k, CASE p_partkey % 5 WHEN 0 THEN 4 WHEN 1 THEN 1 WHEN 2 THEN 5 WHEN 3 THEN 3 END AS area, CASE WHEN p_partkey % 7 = 0 THEN 1 WHEN p_partkey % 7 = 1 THEN 2 END AS road,
 p_partkey % 3 = 0 AS sp, p_partkey % 11 = 0 AS sa, p_partkey % 13 = 0 AS ss, p_partkey % 17 = 0 AS sw, p_partkey % 19 = 0 AS sg, p_size > 45 AS b FROM part),
g AS (SELECT *, coalesce(road, area, 0) AS c0 FROM l), h AS (SELECT *, CASE WHEN c0 IN (0, 1, 2) THEN CASE WHEN sa THEN 1 WHEN sp THEN 2 ELSE c0 END ELSE c0 END AS c1 FROM g)
SELECT CAST(CASE WHEN b THEN 9 WHEN sg THEN 3 WHEN sw THEN 4 WHEN ss THEN 5 ELSE c1 END AS INT) AS cover, count(*) AS n, sum(k) AS keys FROM h GROUP BY 1""")
def cover_paint(spark, sf_dir):
    """Ground class of cells under areas, roads, survey layers and buildings."""
    k = F.col("p_partkey")
    area = F.when(k % 5 == 0, raster.WATER).when(k % 5 == 1, raster.ASPHALT).when(k % 5 == 2, raster.SPORT).when(k % 5 == 3, raster.GRASS)
    road = F.when(k % 7 == 0, raster.ASPHALT).when(k % 7 == 1, raster.FOOTPATH)
    cover = raster.paint_cover(area, road, k % 3 == 0, k % 11 == 0, k % 13 == 0, k % 17 == 0, k % 19 == 0, F.col("p_size") > 45)
    return table(spark, sf_dir, "part").groupBy(cover.alias("cover")).agg(F.count("*").alias("n"), F.sum("p_partkey").alias("keys"))


@query("""SELECT DISTINCT i + di AS i, j + dj AS j FROM (SELECT s_suppkey * 17 % 300 AS i, s_suppkey * 23 % 310 AS j FROM supplier), generate_series(-4, 4) a(di), generate_series(-4, 4) b(dj) WHERE di * di + dj * dj <= 16""")
def disc_dilate(spark, sf_dir):
    """Cells within four cells of any marked one."""
    k = F.col("s_suppkey")
    return raster.dilate(table(spark, sf_dir, "supplier").select((k * 17 % 300).alias("i"), (k * 23 % 310).alias("j")), 4.0)


@query(f"""WITH {GRID_SQL}, w AS (SELECT a.i, a.j, b.v, exp(-((a.i - b.i) * (a.i - b.i) + (a.j - b.j) * (a.j - b.j)) / 8.0::DOUBLE) AS w FROM grid a JOIN grid b ON abs(a.i - b.i) <= 5 AND abs(a.j - b.j) <= 5)
SELECT i, j, round(sum(w * v) / sum(w), 6) AS v FROM w GROUP BY ALL""")
def gaussian_mix(spark, sf_dir):
    """Normalised Gaussian mixing over the ground cells."""
    return raster.gaussian_mix(_grid(spark, sf_dir), 2.0, 5).select("i", "j", F.round("v", 6).alias("v"))


RAYS_SQL = """suns AS (SELECT * FROM (VALUES (0, 12.0::DOUBLE, 95.0::DOUBLE), (1, 35.0::DOUBLE, 140.0::DOUBLE), (2, 55.0::DOUBLE, 180.0::DOUBLE), (3, 20.0::DOUBLE, 262.0::DOUBLE)) t(sun, el, az)),
rays AS (SELECT DISTINCT sun, el, round_even(-k * cos(radians(az)), 0)::BIGINT AS di, round_even(k * sin(radians(az)), 0)::BIGINT AS dj FROM suns, generate_series(1, 220) g(k) WHERE k * 1.5 * tan(radians(el)) <= (SELECT max(h) FROM heights)),
hit AS (SELECT DISTINCT r.sun, h.i, h.j FROM heights h JOIN rays r ON true JOIN heights o ON o.i = h.i + r.di AND o.j = h.j + r.dj WHERE o.h > sqrt(r.di * r.di + r.dj * r.dj) * 1.5 * tan(radians(r.el)) + 0.01)"""
LIT_SQL = f"""WITH {HEIGHTS_SQL}, {RAYS_SQL}, n AS (SELECT i, j, count(*) AS dark FROM hit GROUP BY ALL)
SELECT h.i, h.j, 4 - coalesce(n.dark, 0) AS lit FROM heights h LEFT JOIN n ON n.i = h.i AND n.j = h.j WHERE h.h = 0"""


@query(LIT_SQL)
def shadow_rays(spark, sf_dir):
    """Number of suns that reach each ground cell: every object casts its shadow along the rays."""
    h = _heights(spark, sf_dir)
    dark = raster.shaded(h, SUNS, RES).groupBy("i", "j").agg(F.count("*").alias("dark"))
    return h.filter("h = 0").join(dark, ["i", "j"], "left").select("i", "j", (len(SUNS) - F.coalesce("dark", F.lit(0))).alias("lit"))


@query(LIT_SQL)
def shadow_march(spark, sf_dir):
    """The same by bands of rows, the form for large grids."""
    return raster.march(_heights(spark, sf_dir), SUNS, RES, NY, NX, band=16)


@query("""WITH suns AS (SELECT s_suppkey AS k, (12 + s_suppkey % 50)::DOUBLE AS el, (s_suppkey * 37 % 360)::DOUBLE AS az, (100 + s_suppkey % 700)::DOUBLE AS w FROM supplier),
d AS (SELECT *, 8.0::DOUBLE / tan(radians(el)) AS reach FROM suns),
f AS (SELECT DISTINCT k, w, round_even((c * cos(radians(az)) * 1.5 + oi * 1.5) / 1.5, 0)::BIGINT AS di, round_even((-c * sin(radians(az)) * 1.5 + oj * 1.5) / 1.5, 0)::BIGINT AS dj
 FROM d, generate_series(0, 24) g(c), generate_series(-2, 2) a(oi), generate_series(-2, 2) b(oj) WHERE oi * oi + oj * oj <= 4 AND c * 1.5 <= least(reach, 36))
SELECT di, dj, round(0.85 * sum(w) / (SELECT sum(w) FROM suns), 8) AS share FROM f GROUP BY ALL""")
def shadow_kernel(spark, sf_dir):
    """Share of the irradiance that an object of 8 m takes from each cell around it, weighed over sun positions."""
    k = F.col("s_suppkey")
    suns = table(spark, sf_dir, "supplier").select(k.alias("k"), (12 + k % 50).cast("double").alias("el"), (k * 37 % 360).cast("double").alias("az"), (100 + k % 700).cast("double").alias("w"))
    reach = F.least(8.0 / F.tan(F.radians("el")), F.lit(36.0))
    c = F.explode(F.sequence(F.lit(0), (reach / RES).cast("int")))
    foot = raster.disc(2.0)
    rows = suns.withColumn("c", c).withColumn("o", F.explode(F.array(*[F.struct(F.lit(a).alias("i"), F.lit(b).alias("j")) for a, b in foot])))
    di = F.bround((F.col("c") * F.cos(F.radians("az")) * RES + F.col("o.i") * RES) / RES).cast("long")
    dj = F.bround((-F.col("c") * F.sin(F.radians("az")) * RES + F.col("o.j") * RES) / RES).cast("long")
    cells = rows.select("k", "w", di.alias("di"), dj.alias("dj")).distinct()
    total = suns.agg(F.sum("w").alias("total")).withColumn("one", F.lit(1))
    return cells.groupBy("di", "dj").agg(F.sum("w").alias("w")).withColumn("one", F.lit(1)).join(F.broadcast(total), "one").select("di", "dj", F.round(0.85 * F.col("w") / F.col("total"), 8).alias("share"))


@query()
def greedy_place(spark, sf_dir):
    """Shading objects placed greedily for two kinds at once; tested against brute force."""
    cells = _grid(spark, sf_dir).select("i", "j", F.col("v").alias("sun"), ((F.col("i") * 7 + F.col("j") * 3) % 11 / 10.0).alias("weight"))
    both = cells.withColumn("kind", F.explode(F.array(F.lit("tree"), F.lit("sail"))))
    kernel = [(a, b, math.exp(-(a * a + b * b) / 4.0) * 0.85) for a, b in raster.disc(3.0)]
    return placement.greedy(both, kernel, 3.0, 20)
