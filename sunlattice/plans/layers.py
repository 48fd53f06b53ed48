"""Layers of a grid that grows with the parts: heights of buildings, volumes and crowns, and classes of the ground."""

from __future__ import annotations

from pyspark.sql import functions as F

from sunlattice.operators import layers
from sunlattice.plans.registry import query
from sunlattice.session import table

RES = 1.5
#: Corners of a ring as shares of its width and height.
SHAPE = ((0.0, 0.0), (1.0, 0.0), (1.0, 1.0), (0.5, 0.25), (0.0, 1.0))
CORNERS = ", ".join(f"({k}, {x}::DOUBLE, {y}::DOUBLE)" for k, (x, y) in enumerate(SHAPE))

#: `ring` (id, x0, y0, w, h and what it carries) to `inside` (id, i, j) by testing every edge for every cell of the box.
INSIDE_SQL = f"""corner(k, fx, fy) AS (VALUES {CORNERS}),
edge AS (SELECT r.id, r.x0 + a.fx * w AS ax, r.y0 + a.fy * h AS ay, r.x0 + b.fx * w AS bx, r.y0 + b.fy * h AS by_ FROM ring r, corner a JOIN corner b ON b.k = (a.k + 1) % 5),
row_ AS (SELECT id, x0, w, unnest(generate_series(greatest(0, floor((side - y0 - h) / 1.5)::BIGINT - 1), least(side * 2 // 3 - 1, floor((side - y0) / 1.5)::BIGINT + 1))) AS i FROM ring, g),
box AS (SELECT id, i, unnest(generate_series(greatest(0, floor(x0 / 1.5)::BIGINT - 1), least(side * 2 // 3 - 1, floor((x0 + w) / 1.5)::BIGINT + 1))) AS j FROM row_, g),
spot AS (SELECT id, i, j, (j + 0.5) * 1.5::DOUBLE AS x, side - (i + 0.5) * 1.5::DOUBLE AS y FROM box, g),
inside AS (SELECT s.id, s.i, s.j FROM spot s JOIN edge e ON e.id = s.id AND (ay > y) <> (by_ > y) AND x < ax + (bx - ax) * (y - ay) / (by_ - ay) GROUP BY ALL HAVING count(*) % 2 = 1)"""
SIDE_SQL = "g AS (SELECT (9 * ceil(sqrt(count(*))))::BIGINT // 3 * 3 AS side FROM part)"
PLACE_SQL = "p_partkey * 37 % side + 0.37::DOUBLE AS x0, p_partkey * 61 % side + 0.21::DOUBLE AS y0, 6.0::DOUBLE + p_size % 20 AS w, 5.0::DOUBLE + p_partkey % 17 AS h"


def _side(spark, sf_dir) -> int:
    return 9 * int(-(-(table(spark, sf_dir, "part").count() ** 0.5) // 1)) // 3 * 3


def _ring(x0, y0, w, h):
    return F.array(*[F.struct((x0 + fx * w).alias("x"), (y0 + fy * h).alias("y")) for fx, fy in SHAPE])


def _placed(spark, sf_dir, side):
    k = F.col("p_partkey")
    return table(spark, sf_dir, "part").select("p_partkey", "p_size", (k * 37 % side + 0.37).alias("x0"), (k * 61 % side + 0.21).alias("y0"), (F.lit(6.0) + F.col("p_size") % 20).alias("w"), (F.lit(5.0) + k % 17).alias("h"))


BUILT_SQL = f"""{SIDE_SQL}, p AS (SELECT p_partkey, p_size, {PLACE_SQL} FROM part, g),
ring AS (SELECT p_partkey * 4 AS id, CASE p_partkey % 4 WHEN 0 THEN 'outer' WHEN 1 THEN 'inner' ELSE 'simple' END AS kind, 3 + p_size / 2.0::DOUBLE AS height, x0, y0, w, h FROM p
  UNION ALL SELECT p_partkey * 4 + 1, 'inner', 0, x0 + w / 4, y0 + h / 4, w / 2, h / 2 FROM p WHERE p_partkey % 4 = 0
  UNION ALL SELECT -1 - s_suppkey, 'simple', s_suppkey % 18 + 2, s_suppkey * 43 % side + 0.11::DOUBLE, s_suppkey * 71 % side + 0.13::DOUBLE, 9, 7 FROM supplier, g),
{INSIDE_SQL}, painted AS (SELECT i, j, r.id, kind, height, max(r.id) FILTER (kind = 'inner') OVER (PARTITION BY i, j) AS emptied FROM inside JOIN ring r USING (id)),
roofs AS (SELECT i, j, max(height) FILTER (kind = 'simple' OR kind = 'outer' AND (emptied IS NULL OR id > emptied)) AS roof FROM painted GROUP BY ALL HAVING roof > 0)"""


@query(f"""WITH {BUILT_SQL}, plant AS (SELECT s_suppkey % 3 = 0 AS evergreen, (s_suppkey * 13 % side)::DOUBLE AS x, side - (s_suppkey * 29 % side)::DOUBLE AS y, greatest(3, least(30, s_suppkey % 40))::DOUBLE AS h, greatest(1, least(8, (s_suppkey % 21) / 2.0))::DOUBLE AS r FROM supplier, g),
near AS (SELECT *, greatest(2, 0.35::DOUBLE * h) AS b, floor(y / 1.5)::BIGINT + di AS i, floor(x / 1.5)::BIGINT + dj AS j FROM plant, generate_series(-7, 7) a(di), generate_series(-7, 7) c(dj)),
shell AS (SELECT *, (((j + 0.5) * 1.5 - x) * ((j + 0.5) * 1.5 - x) + ((i + 0.5) * 1.5 - y) * ((i + 0.5) * 1.5 - y)) / (r * r) AS rr FROM near, g WHERE i BETWEEN 0 AND side * 2 // 3 - 1 AND j BETWEEN 0 AND side * 2 // 3 - 1),
crown AS (SELECT i, j, evergreen, max(b + (h - b) / 2 + (h - b) / 2 * sqrt(1 - rr)) AS top, min(b + (h - b) / 2 - (h - b) / 2 * sqrt(1 - rr)) AS bottom FROM shell WHERE rr <= 1 GROUP BY ALL)
SELECT i, j, max(roof) AS roof, round(max(gt), 6) AS green_top, round(max(gb), 6) AS green_bottom, round(max(lt), 6) AS leaf_top, round(max(lb), 6) AS leaf_bottom FROM (
 SELECT i, j, roof, NULL AS gt, NULL AS gb, NULL AS lt, NULL AS lb FROM roofs UNION ALL SELECT i, j, NULL, top, bottom, NULL, NULL FROM crown WHERE evergreen UNION ALL SELECT i, j, NULL, NULL, NULL, top, bottom FROM crown WHERE NOT evergreen) GROUP BY i, j""")
def height_layers(spark, sf_dir):
    """Roofs, evergreen and leafy crowns by cell, from buildings with inner rings, surveyed volumes and plants."""
    side = _side(spark, sf_dir)
    buildings, volumes, plants = _built(spark, sf_dir, side)
    found = layers.heights(buildings, volumes, plants, 0.0, float(side), RES, side * 2 // 3, side * 2 // 3)
    return found.select("i", "j", "roof", *[F.round(c, 6).alias(c) for c in ("green_top", "green_bottom", "leaf_top", "leaf_bottom")])


def _built(spark, sf_dir, side):
    p, k = _placed(spark, sf_dir, side), F.col("p_partkey")
    x0, y0, w, h = (F.col(c) for c in ("x0", "y0", "w", "h"))
    role = lambda r, *box: F.struct(F.lit(r).alias("role"), _ring(*box).alias("ring"))
    outer, hole, inner = role("outer", x0, y0, w, h), role("inner", x0 + w / 4, y0 + h / 4, w / 2, h / 2), role("inner", x0, y0, w, h)
    buildings = p.select(k.alias("ordinal"), (3 + F.col("p_size") / 2.0).alias("height"), F.when(k % 4 == 0, F.array(outer, hole)).when(k % 4 == 1, F.array(inner)).otherwise(F.array(outer)).alias("rings"))
    s, q = table(spark, sf_dir, "supplier"), F.col("s_suppkey")
    volumes = s.select(q.alias("id"), (q % 18 + 2).alias("height"), _ring(q * 43 % side + 0.11, q * 71 % side + 0.13, 9.0, 7.0).alias("ring"))
    plants = s.select((q * 13 % side).cast("double").alias("x"), (q * 29 % side).cast("double").alias("y"), (q % 40).cast("double").alias("h"), (q % 21).cast("double").alias("crown"), (q % 3 == 0).alias("evergreen"))
    return buildings, volumes, plants


TAGS = ({"landuse": "meadow"}, {"leisure": "pitch"}, {"amenity": "parking"}, {"natural": "water"}, {"building": "yes"})
KINDS = ("primary", "residential", "footway", "steps", "cycleway", "proposed")


@query(f"""WITH {SIDE_SQL}, p AS (SELECT p_partkey, p_size, {PLACE_SQL} FROM part, g),
ring AS (SELECT p_partkey AS id, x0, y0, w, h FROM p), {INSIDE_SQL},
land AS (SELECT i, j, max(id % 5) FILTER (id % 3 = 0 AND id % 5 < 4) AS area, bool_or(id % 3 = 1 AND id % 7 = 0) AS path, bool_or(id % 3 = 1 AND id % 7 = 1) AS hard, bool_or(id % 3 = 1 AND id % 7 = 2) AS sport, bool_or(id % 3 = 1 AND id % 7 = 3) AS water, bool_or(id % 3 = 1 AND id % 7 = 4) AS grass, bool_or(id % 12 = 2) AS roof FROM inside GROUP BY ALL),
wide(kind, half) AS (VALUES (0, 6.0::DOUBLE), (1, 3.0::DOUBLE), (2, 1.25::DOUBLE), (3, 1.0::DOUBLE), (4, 1.25::DOUBLE)),
seg AS (SELECT c_custkey AS ordinal, c_custkey % 6 AS kind, (c_custkey * 13 % side)::DOUBLE AS ax, (c_custkey * 29 % side)::DOUBLE AS ay, (c_custkey * 13 % side + c_custkey % 17)::DOUBLE AS bx, (c_custkey * 29 % side + c_custkey % 11)::DOUBLE AS by_ FROM customer, g),
long_ AS (SELECT ordinal, kind, half, ax, ay, bx, by_, sqrt((bx - ax) * (bx - ax) + (by_ - ay) * (by_ - ay)) AS len FROM seg JOIN wide USING (kind)),
step AS (SELECT *, unnest(generate_series(0, greatest(0, ceil((len + 0.75) / 1.5)::BIGINT - 1))) AS k FROM long_),
spot_ AS (SELECT ordinal, kind, half, ax + CASE WHEN len > 0 THEN least(k * 1.5 / len, 1) ELSE 0 END * (bx - ax) AS x, ay + CASE WHEN len > 0 THEN least(k * 1.5 / len, 1) ELSE 0 END * (by_ - ay) AS y FROM step),
disc AS (SELECT ordinal, kind, half, x, y, floor((side - y) / 1.5)::BIGINT + di AS i, floor(x / 1.5)::BIGINT + dj AS j FROM spot_, g, generate_series(-5, 5) a(di), generate_series(-5, 5) b(dj)),
road AS (SELECT i, j, arg_max(CASE WHEN kind IN (2, 3) THEN 2 ELSE 1 END, ordinal) AS class FROM disc, g WHERE ((j + 0.5) * 1.5 - x) * ((j + 0.5) * 1.5 - x) + (side - (i + 0.5) * 1.5 - y) * (side - (i + 0.5) * 1.5 - y) <= half * half AND i BETWEEN 0 AND side * 2 // 3 - 1 AND j BETWEEN 0 AND side * 2 // 3 - 1 GROUP BY ALL),
both_ AS (SELECT i, j, coalesce(class, CASE area WHEN 0 THEN 3 WHEN 1 THEN 5 WHEN 2 THEN 1 WHEN 3 THEN 4 END, 0) AS c, l.* EXCLUDE (i, j) FROM road FULL JOIN land l USING (i, j)
  WHERE class IS NOT NULL OR area IS NOT NULL OR path OR hard OR sport OR water OR grass OR roof)
SELECT i, j, CAST(CASE WHEN roof THEN 9 WHEN grass THEN 3 WHEN water THEN 4 WHEN sport THEN 5 WHEN c IN (0, 1, 2) AND hard THEN 1 WHEN c IN (0, 1, 2) AND path THEN 2 ELSE c END AS INT) AS cover FROM both_""")
def cover_layer(spark, sf_dir):
    """Class of the ground from tagged areas, roads in their order, surveyed surfaces and roofs."""
    side = _side(spark, sf_dir)
    p, k = _placed(spark, sf_dir, side), F.col("p_partkey")
    rings = p.select("p_partkey", k.alias("id"), _ring(F.col("x0"), F.col("y0"), F.col("w"), F.col("h")).alias("ring"))
    tags = F.element_at(F.array(*[F.create_map(*[F.lit(x) for kv in t.items() for x in kv]) for t in TAGS]), (k % 5 + 1).cast("int"))
    mapped = rings.filter(k % 3 == 0).select("id", tags.alias("tags"), "ring")
    names = F.try_element_at(F.array(*[F.lit(c) for c in layers.SURVEYED], F.lit("other")), (k % 7 + 1).cast("int"))
    survey = rings.filter(k % 3 == 1).select("id", names.alias("class"), "ring")
    q = F.col("c_custkey")
    kind = F.element_at(F.array(*[F.lit(c) for c in KINDS]), (q % 6 + 1).cast("int"))
    a, b = q * 13 % side, q * 29 % side
    roads = table(spark, sf_dir, "customer").select(q.alias("ordinal"), kind.alias("kind"), *[x.cast("double").alias(n) for n, x in (("ax", a), ("ay", b), ("bx", a + q % 17), ("by", b + q % 11))])
    grid = (0.0, float(side), RES, side * 2 // 3, side * 2 // 3)
    roofs = layers.ring_cells(rings.filter(k % 12 == 2).select("id", "ring"), *grid)
    return layers.covers(mapped, roads, survey, roofs, *grid)
