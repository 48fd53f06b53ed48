"""Drawing objects, tree rows, flow grids, entrances and stops."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from sunlattice.operators import raster, sequences, spatial
from sunlattice.plans.registry import query
from sunlattice.plans.relations import POINTS_SQL, _points
from sunlattice.session import table

SEGMENTS_SQL = """e AS (SELECT o_orderkey AS id, o_totalprice / 1000 AS flow, (o_custkey % 59 * 1.5)::DOUBLE AS ax, (o_orderkey % 59 * 1.5)::DOUBLE AS ay,
 (o_custkey * 7 % 59 * 1.5)::DOUBLE AS bx, (o_orderkey * 3 % 59 * 1.5)::DOUBLE AS by_ FROM orders),
n AS (SELECT *, sqrt((bx - ax) * (bx - ax) + (by_ - ay) * (by_ - ay)) AS len FROM e)"""


def _segments(spark, sf_dir):
    c, k = F.col("o_custkey"), F.col("o_orderkey")
    ends = (c % 59 * 1.5).alias("ax"), (k % 59 * 1.5).alias("ay"), (c * 7 % 59 * 1.5).alias("bx"), (k * 3 % 59 * 1.5).alias("by")
    return table(spark, sf_dir, "orders").select(k.alias("id"), (F.col("o_totalprice") / 1000).alias("flow"), *ends)


@query(f"""WITH {SEGMENTS_SQL}, s AS (SELECT *, unnest(generate_series(0, ceil(len / 4.0::DOUBLE)::BIGINT - 1)) AS k FROM n WHERE len > 0)
SELECT id, k, round(ax + k * 4 / len * (bx - ax), 6) AS x, round(ay + k * 4 / len * (by_ - ay), 6) AS y FROM s""")
def tree_row_stems(spark, sf_dir):
    """Stems every 4 m along rows of plants."""
    return sequences.stems(_segments(spark, sf_dir), 4.0).select("id", "k", F.round("x", 6).alias("x"), F.round("y", 6).alias("y"))


@query(f"""WITH {SEGMENTS_SQL}, m AS (SELECT *, greatest(2, trunc(len / 1.2::DOUBLE)::BIGINT + 1) AS n FROM n),
s AS (SELECT *, unnest(generate_series(0, n - 1)) AS k FROM m),
c AS (SELECT DISTINCT id, flow, trunc(round((90 - (ay + k / (n - 1)::DOUBLE * (by_ - ay))) / 1.5::DOUBLE, 9))::BIGINT AS i, trunc(round((ax + k / (n - 1)::DOUBLE * (bx - ax)) / 1.5::DOUBLE, 9))::BIGINT AS j FROM s),
d AS (SELECT DISTINCT id, flow, i + di AS i, j + dj AS j FROM c, generate_series(-1, 1) a(di), generate_series(-1, 1) b(dj))
SELECT i, j, round(sum(flow), 4) AS flow FROM d GROUP BY ALL""")
def flow_raster(spark, sf_dir):
    """Flows of street segments on the cells along them and next to those; a segment counts once a cell."""
    return raster.flow_cells(_segments(spark, sf_dir), 1.2, 90.0, 1.5).select("i", "j", F.round("flow", 4).alias("flow"))


@query("""WITH g AS (SELECT s_suppkey * 17 % 90 AS i, s_suppkey * 23 % 70 AS j FROM supplier), c AS (SELECT j, min(i) AS first, max(i) AS last, row_number() OVER (ORDER BY j) AS k FROM g GROUP BY j)
SELECT j, first, last FROM c WHERE (k - 1) % 3 = 0""")
def edge_rows(spark, sf_dir):
    """First and last cell of every third column that has cells: the two edge rows of a footprint."""
    k = F.col("s_suppkey")
    cells = table(spark, sf_dir, "supplier").select((k * 17 % 90).alias("i"), (k * 23 % 70).alias("j"))
    # A row a column of the grid.
    columns = cells.groupBy("j").agg(F.min("i").alias("first"), F.max("i").alias("last")).withColumn("k", F.row_number().over(Window.orderBy("j")))
    return columns.filter((F.col("k") - 1) % 3 == 0).select("j", "first", "last")


@query(f"""WITH {POINTS_SQL}, p AS (SELECT s.rid AS station, c.id FROM s LEFT JOIN c ON (x - rx) * (x - rx) + (y - ry) * (y - ry) < 144)
SELECT station, coalesce(id, -1) AS entrance, round(1.0::DOUBLE / count(*) OVER (PARTITION BY station), 8) AS w FROM p""")
def station_entrances(spark, sf_dir):
    """Entrances nearer than 12 m to each station with equal shares of its weight; the station itself (-1) where there is none."""
    c, s = _points(spark, sf_dir)
    near = spatial.near_join(c, s, 12.0, inclusive=False).select(F.col("rid").alias("station"), F.col("id").alias("entrance"))
    share = near.groupBy("station").agg(F.count("*").alias("n"))
    stations = s.select(F.col("rid").alias("station")).join(share, "station", "left").join(near, "station", "left")
    return stations.select("station", F.coalesce("entrance", F.lit(-1).cast("long")).alias("entrance"), F.round(1.0 / F.coalesce("n", F.lit(1)), 8).alias("w"))


@query("""WITH o AS (SELECT user_id AS tile, event_id AS pos, value AS x, CASE WHEN event_id % 7 = 0 THEN 'head' WHEN event_id % 11 = 0 THEN 'end' ELSE 'vertex' END AS kind FROM events),
m AS (SELECT *, sum(CASE WHEN kind = 'head' THEN 1 ELSE 0 END) OVER w AS ring, last_value(CASE WHEN kind <> 'vertex' THEN kind END IGNORE NULLS) OVER w AS state FROM o
 WINDOW w AS (PARTITION BY tile ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW))
SELECT tile, ring::BIGINT AS ring, count(*) AS n, min(pos) AS first, round(sum(x), 4) AS total FROM m WHERE kind = 'vertex' AND state = 'head' GROUP BY ALL HAVING count(*) >= 3""")
def drawing_rings(spark, sf_dir):
    """Rings that the ordered objects of drawing tiles describe."""
    pos = F.col("event_id")
    kind = F.when(pos % 7 == 0, "head").when(pos % 11 == 0, "end").otherwise("vertex")
    objects = table(spark, sf_dir, "events").select(F.col("user_id").alias("tile"), pos.alias("pos"), kind.alias("kind"), F.col("value").alias("x"), (pos % 50).cast("double").alias("y"))
    p = F.col("points")
    total = F.aggregate(p, F.lit(0.0), lambda a, q: a + F.coalesce(q.x, F.lit(0.0)))
    return sequences.polylines(objects).select("tile", "ring", F.size(p).cast("long").alias("n"), p[0].pos.alias("first"), F.round(total, 4).alias("total"))


@query()
def cluster_stops(spark, sf_dir):
    """Stops of one name merged around running centres; tested against brute force."""
    k = F.col("c_custkey")
    stops = table(spark, sf_dir, "customer").select(k.alias("id"), F.concat(F.lit("stop "), (k % 40).cast("string")).alias("name"), (k * 37 % 211 * 3.0).alias("x"), (k * 61 % 197 * 3.0).alias("y"))
    return sequences.cluster_named(stops, 60.0)
