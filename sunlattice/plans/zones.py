"""The zone around chosen buildings, and its plants by scenario."""

from __future__ import annotations

from pyspark.sql import functions as F

from sunlattice.operators import layers, zones
from sunlattice.plans.layers import BUILT_SQL, RES, _built, _side
from sunlattice.plans.registry import query
from sunlattice.session import table

METRES = 15.0
EXCLUDED = [(60.0, 70.0, 40.0), (150.0, 20.0, 25.0)]

ZONE_SQL = f"""{BUILT_SQL}, chosen AS (SELECT id // 4 AS ordinal FROM ring, (SELECT 1) WHERE id >= 0 AND id % 4 = 0 AND id // 4 % 20 IN (0, 1, 2)
  AND {" AND ".join(f"(x0 + 0.5 * w - {x}) * (x0 + 0.5 * w - {x}) + (y0 + 0.45 * h - {y}) * (y0 + 0.45 * h - {y}) >= {r * r}" for x, y, r in EXCLUDED)}),
over_ AS (SELECT s.i, s.j, arg_max(r.kind, r.id) AS kind FROM inside s JOIN ring r USING (id) JOIN chosen c ON r.id >= 0 AND c.ordinal = r.id // 4 GROUP BY ALL),
mask AS (SELECT o.i, o.j FROM over_ o JOIN roofs USING (i, j) WHERE kind <> 'inner'),
near_ AS (SELECT DISTINCT i + di AS i, j + dj AS j FROM mask, generate_series(-10, 10) a(di), generate_series(-10, 10) b(dj) WHERE di * di + dj * dj <= 100),
zone AS (SELECT n.i, n.j FROM near_ n ANTI JOIN roofs USING (i, j), g WHERE n.i BETWEEN 0 AND side * 2 // 3 - 1 AND n.j BETWEEN 0 AND side * 2 // 3 - 1)"""


def _zone(spark, sf_dir):
    side = _side(spark, sf_dir)
    buildings, volumes, plants = _built(spark, sf_dir, side)
    grid = (0.0, float(side), RES, side * 2 // 3, side * 2 // 3)
    roofs = layers.heights(buildings, volumes, plants.limit(0), *grid).filter("roof > 0").select("i", "j").checkpoint()
    named = (F.col("ordinal") % 20).isin(0, 1, 2)
    chosen = buildings.filter(zones.kept_building(named, F.col("rings")[0]["ring"], EXCLUDED))
    return zones.zone(chosen, roofs, *grid, METRES), plants, grid


@query(f"WITH {ZONE_SQL} SELECT i, j FROM zone")
def campus_zone(spark, sf_dir):
    """Ground near the chosen buildings, courtyards being none of them, without those in excluded discs."""
    return _zone(spark, sf_dir)[0].select("i", "j")


@query(f"""WITH {ZONE_SQL}, had AS (SELECT count(*) AS n FROM supplier, g, zone z WHERE z.i = floor((s_suppkey * 29 % side) * -1 / 1.5 + side / 1.5)::BIGINT AND z.j = floor((s_suppkey * 13 % side) / 1.5)::BIGINT),
more AS (SELECT count(*) FILTER (c_custkey % 9 = 0) AS p, count(*) FILTER (c_custkey % 50 = 0) AS s FROM customer)
SELECT 'baseline' AS scenario, n AS plants, 0::DOUBLE AS canopy_m2 FROM had UNION ALL SELECT 'trees', n + p, round(p * pi() * 6.25, 4) FROM had, more UNION ALL SELECT 'sails', n, round(s * 36 * 0.8::DOUBLE, 4) FROM had, more""")
def zone_plants(spark, sf_dir):
    """Plants of the zone and canopy added, as things are, with new plants and with sheets."""
    zone, plants, grid = _zone(spark, sf_dir)
    new, k = table(spark, sf_dir, "customer"), F.col("c_custkey")
    found = zones.green_totals(zones.plants_inside(plants, zone, *grid[:3]), new.filter(k % 9 == 0), new.filter(k % 50 == 0), 5.0, 6.0, 0.8)
    return found.withColumn("canopy_m2", F.round("canopy_m2", 4))
