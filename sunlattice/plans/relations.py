"""Cleaning, classing, ranking and spatial joins over the driver's tables."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from sunlattice.functions import attributes, geometry
from sunlattice.operators import spatial
from sunlattice.plans.registry import query
from sunlattice.session import table


def _xy(key: str):
    """Places derived from a key: the driver's tables hold no geometry."""
    return (F.pmod(F.col(key) * 37, F.lit(211)) * 3.0).alias("x"), (F.pmod(F.col(key) * 61, F.lit(197)) * 3.0).alias("y")


POINTS_SQL = """c AS (SELECT c_custkey AS id, (c_custkey * 37 % 211) * 3.0::DOUBLE AS x, (c_custkey * 61 % 197) * 3.0::DOUBLE AS y FROM customer),
s AS (SELECT s_suppkey AS rid, (s_suppkey * 37 % 211) * 3.0::DOUBLE AS rx, (s_suppkey * 61 % 197) * 3.0::DOUBLE AS ry, s_acctbal AS z FROM supplier)"""


def _points(spark, sf_dir):
    c = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id"), *_xy("c_custkey"))
    s = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("rid"), *_xy("s_suppkey"), F.col("s_acctbal").alias("z")).withColumnsRenamed({"x": "rx", "y": "ry"})
    return c, s


@query("""SELECT c_nationkey, count(*) AS n FROM customer
WHERE 9 + (c_custkey % 100) / 100.0 BETWEEN 9.2 AND 9.6 AND 45 + (c_custkey % 89) / 89.0 BETWEEN 45.25 AND 45.75 GROUP BY 1""")
def bbox_filter(spark, sf_dir):
    """Points in a box of longitudes and latitudes, edges included, by nation."""
    c = table(spark, sf_dir, "customer")
    lon, lat = 9 + (F.col("c_custkey") % 100) / 100.0, 45 + (F.col("c_custkey") % 89) / 89.0
    return c.filter(geometry.in_box(lon, lat, 9.2, 9.6, 45.25, 45.75)).groupBy("c_nationkey").agg(F.count("*").alias("n"))


@query("""SELECT CASE WHEN o_orderpriority LIKE '1%' THEN 'water' WHEN o_orderstatus = 'F' THEN 'sport' WHEN o_totalprice > 100000 THEN 'grass'
  WHEN o_orderpriority LIKE '5%' THEN 'asphalt' ELSE 'none' END AS kind, count(*) AS n, round(sum(o_totalprice), 2) AS total FROM orders GROUP BY 1""")
def classify_when(spark, sf_dir):
    """The first rule that holds names the class."""
    o = table(spark, sf_dir, "orders")
    p = F.col("o_orderpriority")
    kind = attributes.first_match([(p.startswith("1"), "water"), (F.col("o_orderstatus") == "F", "sport"), (F.col("o_totalprice") > 100000, "grass"), (p.startswith("5"), "asphalt")], "none")
    return o.groupBy(kind.alias("kind")).agg(F.count("*").alias("n"), F.round(F.sum("o_totalprice"), 2).alias("total"))


@query("""WITH t AS (SELECT l_returnflag, CASE WHEN l_linenumber = 3 THEN 'tall' WHEN l_linenumber = 4 THEN '' ELSE replace(CAST(l_quantity AS VARCHAR), '.', ',') || ' m' END AS h FROM lineitem),
p AS (SELECT l_returnflag, TRY_CAST(trim(replace(replace(h, 'm', ''), ',', '.')) AS DOUBLE) AS v FROM t)
SELECT l_returnflag, count(*) AS n, count(v) AS parsed, round(sum(v), 4) AS total FROM p GROUP BY 1""")
def parse_heights(spark, sf_dir):
    """Heights in text with comma decimals and units, as numbers; what is none is null."""
    line = table(spark, sf_dir, "lineitem")
    text = F.when(F.col("l_linenumber") == 3, "tall").when(F.col("l_linenumber") == 4, "").otherwise(F.concat(F.replace(F.col("l_quantity").cast("string"), F.lit("."), F.lit(",")), F.lit(" m")))
    return line.groupBy("l_returnflag").agg(F.count("*").alias("n"), F.count(attributes.parse_number(text)).alias("parsed"), F.round(F.sum(attributes.parse_number(text)), 4).alias("total"))


@query("""WITH b AS (SELECT p_partkey, CASE WHEN p_size % 7 = 0 THEN 0 ELSE p_size END::DOUBLE AS h, (p_partkey % 6)::DOUBLE AS lv, split_part(p_type, ' ', 1) AS kind FROM part)
SELECT kind, count(*) AS n, round(sum(CASE WHEN h > 2 THEN h WHEN lv > 0 THEN lv * 3.2::DOUBLE + 1 WHEN kind = 'STANDARD' THEN 12 WHEN kind = 'SMALL' THEN 4.5::DOUBLE ELSE 10 END), 4) AS height,
 sum(CASE WHEN lv <> 0 THEN lv ELSE greatest(1, round_even(h / 4, 0)) END) AS floors FROM b GROUP BY 1""")
def fallback_heights(spark, sf_dir):
    """Heights of buildings from their own height, storeys, type or the default; floors likewise."""
    p = table(spark, sf_dir, "part").select(F.when(F.col("p_size") % 7 == 0, 0).otherwise(F.col("p_size")).cast("double").alias("h"), (F.col("p_partkey") % 6).cast("double").alias("lv"), F.split_part("p_type", F.lit(" "), F.lit(1)).alias("kind"))
    height = attributes.fallback_height(F.col("h"), F.col("lv"), F.col("kind"), {"STANDARD": 12.0, "SMALL": 4.5})
    return p.groupBy("kind").agg(F.count("*").alias("n"), F.round(F.sum(height), 4).alias("height"), F.sum(attributes.floors(F.col("lv"), F.col("h"))).alias("floors"))


@query("""SELECT genus, n, rank FROM (SELECT coalesce(CASE WHEN p_partkey % 11 <> 0 THEN p_brand END, 'unknown') AS genus, count(*) AS n, min(p_partkey) AS f,
 row_number() OVER (ORDER BY count(*) DESC, min(p_partkey)) AS rank FROM part GROUP BY 1) WHERE rank <= 8""")
def genus_top8(spark, sf_dir):
    """The most common kinds, missing ones under a name of their own; ties in order of first appearance."""
    p = table(spark, sf_dir, "part").select("p_partkey", F.coalesce(F.when(F.col("p_partkey") % 11 != 0, F.col("p_brand")), F.lit("unknown")).alias("genus"))
    n = p.groupBy("genus").agg(F.count("*").alias("n"), F.min("p_partkey").alias("first"))
    return spatial.ranked(n, "n", "first", 8).select("genus", "n", F.col("rank").cast("long").alias("rank"))


@query("""SELECT p_brand AS corridor, round(sum(l_quantity * l_extendedprice), 2) AS exposure, round(sum(l_quantity), 2) AS length,
 round(sum(l_quantity * l_discount) / sum(l_quantity), 6) AS mean_sun, round(avg(l_discount), 6) AS plain_sun
FROM lineitem JOIN part ON l_partkey = p_partkey WHERE l_discount IS NOT NULL AND l_discount <> 0 GROUP BY 1 ORDER BY sum(l_quantity * l_extendedprice) DESC, 1 LIMIT 15""")
def corridor_rank(spark, sf_dir):
    """Streets by summed exposure, with length-weighted and plain mean sun; segments without sun are left out."""
    line = table(spark, sf_dir, "lineitem").filter("l_discount is not null and l_discount <> 0").select("l_partkey", "l_quantity", "l_extendedprice", "l_discount")
    # Sums a part first: far fewer rows meet the names.
    per = line.groupBy("l_partkey").agg(F.sum(F.col("l_quantity") * F.col("l_extendedprice")).alias("e"), F.sum("l_quantity").alias("len"), F.sum(F.col("l_quantity") * F.col("l_discount")).alias("ws"), F.sum("l_discount").alias("s"), F.count("*").alias("n"))
    named = per.join(table(spark, sf_dir, "part").select("p_partkey", F.col("p_brand").alias("corridor")), F.col("l_partkey") == F.col("p_partkey"))
    rows = named.groupBy("corridor").agg(F.sum("e").alias("raw"), F.round(F.sum("e"), 2).alias("exposure"), F.round(F.sum("len"), 2).alias("length"), F.round(F.sum("ws") / F.sum("len"), 6).alias("mean_sun"), F.round(F.sum("s") / F.sum("n"), 6).alias("plain_sun"))
    return rows.orderBy(F.desc("raw"), "corridor").limit(15).drop("raw")


@query("""SELECT s_suppkey, round(abs(s_acctbal) / sum(abs(s_acctbal)) OVER (PARTITION BY s_nationkey), 8) AS share FROM supplier""")
def share_of_total(spark, sf_dir):
    """Weights as shares of their group's total."""
    s = table(spark, sf_dir, "supplier")
    w = F.abs("s_acctbal")
    return s.select("s_suppkey", F.round(F.try_divide(w, F.sum(w).over(Window.partitionBy("s_nationkey"))), 8).alias("share"))


@query("""SELECT l_suppkey, round(quantile_cont(l_extendedprice, 0.75), 4) AS p75, round(median(l_extendedprice), 4) AS mid,
 round(list_sort(list(l_extendedprice))[len(list(l_extendedprice)) // 2 + 1], 4) AS upper FROM lineitem GROUP BY 1""")
def percentile75(spark, sf_dir):
    """Third quartile (interpolated), median and upper median of a group."""
    g = table(spark, sf_dir, "lineitem").groupBy("l_suppkey")
    # The upper median, at rank n / 2 + 1, is the discrete half of the falling order; it merges counts of values, no group is gathered.
    p = F.col("l_extendedprice")
    upper = F.expr("percentile_disc(0.5) WITHIN GROUP (ORDER BY l_extendedprice DESC)")
    return g.agg(F.round(F.percentile(p, F.lit(0.75)), 4).alias("p75"), F.round(F.median(p), 4).alias("mid"), F.round(upper, 4).alias("upper"))


@query(f"""WITH {POINTS_SQL}, n AS (SELECT id, median(z) AS m, count(*) AS n FROM c JOIN s ON (x - rx) * (x - rx) + (y - ry) * (y - ry) <= 1600 GROUP BY 1)
SELECT c.id, coalesce(n, 0) AS n, round(CASE WHEN n >= 3 THEN m ELSE (SELECT median(z) FROM s) END, 4) AS z FROM c LEFT JOIN n USING (id)""")
def median_local(spark, sf_dir):
    """Median level of the samples within 40 m; of all where fewer than three are near."""
    c, s = _points(spark, sf_dir)
    return spatial.local_median(c, s, 40.0).select("id", "n", F.round("z", 4).alias("z"))


@query(f"""WITH {POINTS_SQL}, p AS (SELECT id, rid, (x - rx) * (x - rx) + (y - ry) * (y - ry) AS d2, row_number() OVER (PARTITION BY id ORDER BY (x - rx) * (x - rx) + (y - ry) * (y - ry), rid) AS k
 FROM c JOIN s ON (x - rx) * (x - rx) + (y - ry) * (y - ry) <= 900) SELECT id, rid, d2 FROM p WHERE k = 1""")
def nearest_within(spark, sf_dir):
    """The nearest sample within 30 m of each point; the lower id on a tie."""
    c, s = _points(spark, sf_dir)
    return spatial.nearest_within(c, s, 30.0)


@query(f"""WITH {POINTS_SQL} SELECT s.rid FROM s WHERE NOT EXISTS (SELECT 1 FROM c WHERE (x - rx) * (x - rx) + (y - ry) * (y - ry) <= 36)""")
def anti_matched(spark, sf_dir):
    """Samples that no point has within 6 m."""
    c, s = _points(spark, sf_dir)
    near = spatial.near_join(c, s, 6.0).select("rid").distinct()
    return s.join(near, "rid", "left_anti").select("rid")


@query(f"""WITH {POINTS_SQL} SELECT s.rid FROM s WHERE NOT EXISTS (SELECT 1 FROM c WHERE (x - rx) * (x - rx) + (y - ry) * (y - ry) <= 1)""")
def anti_matched_close(spark, sf_dir):
    """Samples that no point has within a metre."""
    c, s = _points(spark, sf_dir)
    near = spatial.near_join(c, s, 1.0).select("rid").distinct()
    return s.join(near, "rid", "left_anti").select("rid")


@query("""SELECT a.n_nationkey AS a, b.n_nationkey AS b, round(a.w * b.w, 6) AS w FROM
 (SELECT n_nationkey, (n_nationkey % 5 + 1) / 10.0::DOUBLE AS w FROM nation) a JOIN (SELECT n_nationkey, (n_nationkey % 5 + 1) / 10.0::DOUBLE AS w FROM nation) b ON a.n_nationkey < b.n_nationkey""")
def upper_triangle_pairs(spark, sf_dir):
    """Each pair of buildings once, with the product of their weights."""
    n = table(spark, sf_dir, "nation").select("n_nationkey", ((F.col("n_nationkey") % 5 + 1) / 10.0).alias("w"))
    a, b = n.withColumnsRenamed({"n_nationkey": "a", "w": "wa"}), n.withColumnsRenamed({"n_nationkey": "b", "w": "wb"})
    return a.join(F.broadcast(b), F.col("a") < F.col("b")).select("a", "b", F.round(F.col("wa") * F.col("wb"), 6).alias("w"))


@query(f"""WITH {POINTS_SQL} SELECT id, count(*) AS near, round(min(d), 6) AS closest FROM (SELECT id, sqrt((x - rx) * (x - rx) + (y - ry) * (y - ry)) AS d FROM c, s) WHERE d < 24 GROUP BY 1""")
def range_join_cells(spark, sf_dir):
    """Samples nearer than 24 m to each point, by buckets of cells."""
    c, s = _points(spark, sf_dir)
    return spatial.near_join(c, s, 24.0, inclusive=False).groupBy("id").agg(F.count("*").alias("near"), F.round(F.sqrt(F.min("d2")), 6).alias("closest"))


@query("""WITH RECURSIVE p AS (SELECT s_suppkey AS id, (s_suppkey * 37 % 211) * 3 AS x, (s_suppkey * 61 % 197) * 3 AS y, row_number() OVER (ORDER BY s_suppkey) AS k FROM supplier),
r AS (SELECT 0::BIGINT AS k, []::STRUCT(id BIGINT, x BIGINT, y BIGINT)[] AS kept UNION ALL
 SELECT p.k, CASE WHEN len(list_filter(r.kept, lambda q: (q.x - p.x) * (q.x - p.x) + (q.y - p.y) * (q.y - p.y) < 3600)) > 0 THEN r.kept
   ELSE list_append(r.kept, {'id': p.id, 'x': p.x::BIGINT, 'y': p.y::BIGINT}) END FROM r JOIN p ON p.k = r.k + 1)
SELECT unnest(kept).id AS id FROM (SELECT kept FROM r ORDER BY k DESC LIMIT 1)""")
def greedy_dedup(spark, sf_dir):
    """Points kept by a scan in order that drops what is within 60 m of a kept one."""
    s = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("id"), *_xy("s_suppkey"))
    return spatial.first_wins(s, 60.0).select("id")


def _rings(spark, sf_dir):
    k = F.col("n_nationkey")
    point = lambda x, y: F.struct(x.cast("double").alias("x"), y.cast("double").alias("y"))
    ring = F.array(point(k * 20, k * 7), point(k * 20 + 10 + k % 3, k * 7 + 1), point(k * 20 + 9, k * 7 + 8 + k % 4), point(k * 20 + 4, k * 7 + 5), point(k * 20 + 1, k * 7 + 11))
    return table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("id"), ring.alias("ring"))


RINGS_SQL = """r AS (SELECT n_nationkey AS id, unnest([{'k': 0, 'x': k * 20, 'y': k * 7}, {'k': 1, 'x': k * 20 + 10 + k % 3, 'y': k * 7 + 1}, {'k': 2, 'x': k * 20 + 9, 'y': k * 7 + 8 + k % 4},
  {'k': 3, 'x': k * 20 + 4, 'y': k * 7 + 5}, {'k': 4, 'x': k * 20 + 1, 'y': k * 7 + 11}]) AS p FROM (SELECT n_nationkey, n_nationkey AS k FROM nation)),
e AS (SELECT a.id, a.p.x::DOUBLE AS ax, a.p.y::DOUBLE AS ay, b.p.x::DOUBLE AS bx, b.p.y::DOUBLE AS by_ FROM r a JOIN r b ON a.id = b.id AND b.p.k = (a.p.k + 1) % 5)"""


@query(f"""WITH {RINGS_SQL}, s AS (SELECT id, sum(ax * by_ - bx * ay) / 2 AS area, sum((ax + bx) * (ax * by_ - bx * ay)) AS sx, sum((ay + by_) * (ax * by_ - bx * ay)) AS sy FROM e GROUP BY 1)
SELECT id, round(area, 6) AS area, round(sx / (6 * area), 6) AS cx, round(sy / (6 * area), 6) AS cy FROM s""")
def polygon_area(spark, sf_dir):
    """Shoelace area and centroid of rings."""
    r = _rings(spark, sf_dir)
    cx, cy = geometry.centroid(F.col("ring"))
    return r.select("id", F.round(geometry.signed_area(F.col("ring")), 6).alias("area"), F.round(cx, 6).alias("cx"), F.round(cy, 6).alias("cy"))


@query(f"""WITH {RINGS_SQL}, g AS (SELECT i, j, (j + 0.5) * 1.5::DOUBLE AS x, (i + 0.5) * 1.5::DOUBLE AS y, ((i * 31 + j * 17) % 97)::DOUBLE AS v FROM generate_series(0, 130) a(i), generate_series(0, 340) b(j)),
h AS (SELECT id, i, j, count(*) AS c FROM g JOIN e ON (ay > y) <> (by_ > y) AND x < ax + (bx - ax) * (y - ay) / (by_ - ay) GROUP BY ALL HAVING count(*) % 2 = 1)
SELECT id, count(*) AS cells, round(avg(v), 6) AS mean, round(100 * avg(CASE WHEN v < 40 THEN 1.0 ELSE 0 END), 6) AS shade FROM h JOIN g USING (i, j) GROUP BY 1""")
def zonal_mean(spark, sf_dir):
    """Cells whose centre is in a polygon: count, mean and share in shade. Cells come from each ring's box."""
    res = 1.5
    r = _rings(spark, sf_dir)
    x, y = (F.transform("ring", lambda p: p[c]) for c in ("x", "y"))
    span = lambda a, most: F.sequence(F.greatest(F.lit(0), F.floor(F.array_min(a) / res - 0.5).cast("int")), F.least(F.lit(most), F.ceil(F.array_max(a) / res).cast("int")))
    cells = r.withColumn("i", F.explode(span(y, 130))).withColumn("j", F.explode(span(x, 340)))
    inside = cells.filter(geometry.contains(F.col("ring"), (F.col("j") + 0.5) * res, (F.col("i") + 0.5) * res))
    v = ((F.col("i") * 31 + F.col("j") * 17) % 97).cast("double")
    return inside.withColumn("v", v).groupBy("id").agg(F.count("*").alias("cells"), F.round(F.avg("v"), 6).alias("mean"), F.round(100 * F.avg((F.col("v") < 40).cast("double")), 6).alias("shade"))


@query("""WITH m AS (SELECT s_nationkey AS id, avg(s_acctbal) AS sun, sum(abs(s_acctbal)) AS area, count(*)::DOUBLE AS dist FROM supplier GROUP BY 1),
p AS (SELECT id, 0.5 * sun / nullif(max(sun) OVER (), 0) + 0.3 * area / nullif(max(area) OVER (), 0) + 0.2 * (1 - dist / nullif(max(dist) OVER (), 0)) AS priority FROM m)
SELECT id, round(priority, 6) AS priority, row_number() OVER (ORDER BY priority DESC, id) AS rank FROM p""")
def rank_areas(spark, sf_dir):
    """Areas by a weighed sum of measures, each against its maximum; the order of the list breaks ties."""
    m = table(spark, sf_dir, "supplier").groupBy(F.col("s_nationkey").alias("id")).agg(F.avg("s_acctbal").alias("sun"), F.sum(F.abs("s_acctbal")).alias("area"), F.count("*").cast("double").alias("dist"))
    # One row of maxima.
    top = m.agg(*[F.max(c).alias(f"top_{c}") for c in ("sun", "area", "dist")]).withColumn("one", F.lit(1))
    of = lambda c: F.try_divide(F.col(c), F.col(f"top_{c}"))
    p = m.withColumn("one", F.lit(1)).join(F.broadcast(top), "one").withColumn("priority", 0.5 * of("sun") + 0.3 * of("area") + 0.2 * (1 - of("dist")))
    return p.select("id", F.round("priority", 6).alias("priority"), F.row_number().over(Window.orderBy(F.desc("priority"), "id")).cast("long").alias("rank"))


@query("""SELECT round(sum(w * x) / sum(w), 6) AS cx, round(sum(w * y) / sum(w), 6) AS cy, round(100 * sum(w * (CASE WHEN z < 4 THEN 1 ELSE 0 END)) / sum(w), 6) AS shade
FROM (SELECT o_totalprice AS w, (o_custkey * 37 % 211) * 3.0::DOUBLE AS x, (o_custkey * 61 % 197) * 3.0::DOUBLE AS y, o_orderkey % 9 AS z FROM orders)""")
def weighted_centroid(spark, sf_dir):
    """Centre of flows and the weighed share of them in shade."""
    o = table(spark, sf_dir, "orders").select(F.col("o_totalprice").alias("w"), *_xy("o_custkey"), (F.col("o_orderkey") % 9).alias("z"))
    mean = lambda v: F.try_divide(F.sum(F.col("w") * v), F.sum("w"))
    return o.agg(F.round(mean(F.col("x")), 6).alias("cx"), F.round(mean(F.col("y")), 6).alias("cy"), F.round(100 * mean((F.col("z") < 4).cast("int")), 6).alias("shade"))


@query("""WITH s AS (SELECT s_nationkey AS point, s_suppkey % 2 AS solution, s_suppkey % 3 AS level, avg(s_acctbal) / 1000 AS hours, sum(s_suppkey % 40) AS qty FROM supplier GROUP BY ALL),
b AS (SELECT s_nationkey AS point, max(s_acctbal) / 1000 AS base FROM supplier GROUP BY 1),
c AS (SELECT s.*, base - hours AS dsun, CASE WHEN solution = 0 THEN qty * 500 ELSE qty * 2.25 * 150 END AS cost, CASE WHEN solution = 0 THEN qty * 100 ELSE qty * 2.25 * 12 END AS yearly FROM s JOIN b USING (point))
SELECT point, solution, level, round(dsun, 6) AS dsun, round(cost, 2) AS cost, round(yearly, 2) AS yearly, CASE WHEN dsun > 0.05 THEN round(cost / dsun, 4) END AS eff FROM c""")
def cost_benefit(spark, sf_dir):
    """Sun removed against the base, costs, and cost per hour removed where there is one."""
    s = table(spark, sf_dir, "supplier")
    base = s.groupBy(F.col("s_nationkey").alias("point")).agg((F.max("s_acctbal") / 1000).alias("base"))
    rows = s.groupBy(F.col("s_nationkey").alias("point"), (F.col("s_suppkey") % 2).alias("solution"), (F.col("s_suppkey") % 3).alias("level")).agg((F.avg("s_acctbal") / 1000).alias("hours"), F.sum(F.col("s_suppkey") % 40).alias("qty"))
    planted = F.col("solution") == 0
    rows = rows.join(base, "point").withColumn("dsun", F.col("base") - F.col("hours"))
    rows = rows.withColumn("cost", F.when(planted, F.col("qty") * 500.0).otherwise(F.col("qty") * 2.25 * 150)).withColumn("yearly", F.when(planted, F.col("qty") * 100.0).otherwise(F.col("qty") * 2.25 * 12))
    return rows.select("point", "solution", "level", F.round("dsun", 6).alias("dsun"), F.round("cost", 2).alias("cost"), F.round("yearly", 2).alias("yearly"), F.when(F.col("dsun") > 0.05, F.round(F.col("cost") / F.col("dsun"), 4)).alias("eff"))
