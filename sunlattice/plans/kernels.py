"""Densities, summer kernels and rows of plants over grids that grow with the tables."""

from __future__ import annotations

import numpy as np
from pyspark.sql import functions as F

from sunlattice.operators import kernels, layers
from sunlattice.plans.layers import INSIDE_SQL, PLACE_SQL, RES, SIDE_SQL, _placed, _ring, _side
from sunlattice.plans.registry import query
from sunlattice.plans.sun import STEPS_SQL, month_steps, sun_sql
from sunlattice.session import table

#: A kernel that is no product of two lines: it leans to one side.
WIDE, HIGH = 9, 6
LEANING = np.array([[(1 + 0.1 * b) / (1 + a * a + a * b + b * b) for b in range(WIDE)] for a in range(HIGH)])


@query(f"""WITH g AS (SELECT (2 * ceil(sqrt(count(*))))::BIGINT AS n FROM orders), c AS (SELECT o_orderkey * 7 % n AS i, o_custkey * 11 % n AS j, sum(o_totalprice::DOUBLE / 100000) AS v FROM orders, g GROUP BY ALL),
k AS (SELECT a, b, (1 + 0.1::DOUBLE * b) / (1 + a * a + a * b + b * b) AS w FROM generate_series(0, {HIGH - 1}) x(a), generate_series(0, {WIDE - 1}) y(b))
SELECT i + a - {HIGH // 2} AS i, j + b - {WIDE // 2} AS j, round(sum(v * w), 6) AS v FROM c, k, g WHERE i + a - {HIGH // 2} BETWEEN 0 AND n - 1 AND j + b - {WIDE // 2} BETWEEN 0 AND n - 1 GROUP BY ALL""")
def corridor_density(spark, sf_dir):
    """Trade around each cell of a square that grows with the orders, by a kernel that leans."""
    o = table(spark, sf_dir, "orders")
    n = 2 * int(-(-(o.count() ** 0.5) // 1))
    cells = o.select((F.col("o_orderkey") * 7 % n).alias("i"), (F.col("o_custkey") * 11 % n).alias("j"), (F.col("o_totalprice").cast("double") / 100000).alias("v"))
    return kernels.convolve_same(cells, LEANING, n, n).select("i", "j", F.round("v", 6).alias("v"))


@query(f"""WITH {STEPS_SQL}, {sun_sql("e")}, jja AS (SELECT elev, radians(az) AS az, w FROM sun WHERE elev > 3 AND month IN (6, 7, 8)),
o AS (SELECT s_suppkey AS id, 3.0::DOUBLE + s_suppkey % 9 AS height, 1.5::DOUBLE + s_suppkey % 4 AS radius, CASE WHEN s_suppkey % 2 = 0 THEN 0.85::DOUBLE ELSE 0.9 END AS opacity, s_suppkey % 2 = 1 AS square FROM supplier),
m AS (SELECT o.*, greatest(1, round_even(radius / 1.5, 0)::BIGINT) AS n, w, round_even(height / tan(radians(elev)) / 1.5 * cos(az), 0)::BIGINT AS ci, round_even(-(height / tan(radians(elev)) / 1.5) * sin(az), 0)::BIGINT AS cj FROM o, jja WHERE elev >= 12)
SELECT id, ci + a AS di, cj + b AS dj, round(sum(w * opacity) / (SELECT sum(w) FROM jja), 9) AS share FROM m, generate_series(-4, 4) x(a), generate_series(-4, 4) y(b)
WHERE abs(a) <= n AND abs(b) <= n AND (square OR a * a + b * b <= n * n) AND abs(ci + a) <= 24 AND abs(cj + b) <= 24 GROUP BY ALL""")
def summer_kernels(spark, sf_dir):
    """What plants and sails of different heights take from the cells around them from June to August."""
    k = F.col("s_suppkey")
    objects = table(spark, sf_dir, "supplier").select(k.alias("id"), (3.0 + k % 9).alias("height"), (1.5 + k % 4).alias("radius"), F.when(k % 2 == 0, 0.85).otherwise(0.9).alias("opacity"), (k % 2 == 1).alias("square"))
    suns = month_steps(spark).filter((F.col("elev") > 3) & F.col("month").isin(6, 7, 8)).select("elev", "az", "w")
    return kernels.sun_kernels(objects, suns, RES).select("id", "di", "dj", F.round("share", 9).alias("share"))


@query(f"""WITH RECURSIVE {SIDE_SQL}, p AS (SELECT p_partkey, p_size, {PLACE_SQL} FROM part, g), ring AS (SELECT p_partkey AS id, x0, y0, w * 2 AS w, h * 2 AS h FROM p), {INSIDE_SQL},
marked AS (SELECT id, i, j, (i * 7 + j * 3) % 5 <> 0 AS ok, id % 2 = 0 AS along FROM inside), line AS (SELECT id, along, CASE WHEN along THEN j ELSE i END AS line, min(CASE WHEN along THEN i ELSE j END) AS low, max(CASE WHEN along THEN i ELSE j END) AS high FROM marked GROUP BY ALL),
every_ AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY line) AS place FROM line), ends AS (SELECT id, along, line, 0 AS half, low AS pos FROM every_ WHERE (place - 1) % 3 = 0 UNION ALL SELECT id, along, line, 1, high FROM every_ WHERE (place - 1) % 3 = 0),
spots AS (SELECT id, CASE WHEN along THEN pos ELSE line END AS i, CASE WHEN along THEN line ELSE pos END AS j, row_number() OVER (PARTITION BY id ORDER BY line, half) AS n FROM ends),
turn AS (SELECT *, (i * 7 + j * 3) % 5 <> 0 AS ok, (j + 0.5) * 1.5::DOUBLE AS x, side - (i + 0.5) * 1.5::DOUBLE AS y FROM spots, g),
r(id, n, kept) AS (SELECT DISTINCT id, 0::BIGINT, []::STRUCT(i BIGINT, j BIGINT, x DOUBLE, y DOUBLE)[] FROM turn
 UNION ALL SELECT t.id, t.n, CASE WHEN t.ok AND len(list_filter(kept, lambda q: (q.x - t.x) * (q.x - t.x) + (q.y - t.y) * (q.y - t.y) < 16)) = 0 THEN list_append(kept, {{'i': t.i, 'j': t.j, 'x': t.x, 'y': t.y}}) ELSE kept END FROM r JOIN turn t ON t.id = r.id AND t.n = r.n + 1),
last AS (SELECT id, arg_max(kept, n) AS kept FROM r GROUP BY id), flat AS (SELECT id, unnest(kept) AS q, generate_subscripts(kept, 1) AS ordinal FROM last) SELECT id, ordinal::BIGINT AS ordinal, q.i AS i, q.j AS j FROM flat""")
def edge_plants(spark, sf_dir):
    """Plants in two rows along the edges of footprints, where they may stand and are far enough apart."""
    side, k = _side(spark, sf_dir), F.col("id")
    rings = _placed(spark, sf_dir, side).select(F.col("p_partkey").alias("id"), _ring(F.col("x0"), F.col("y0"), F.col("w") * 2, F.col("h") * 2).alias("ring"))
    cells = layers.ring_cells(rings, 0.0, float(side), RES, side * 2 // 3, side * 2 // 3)
    cells = cells.select("id", "i", "j", ((F.col("i") * 7 + F.col("j") * 3) % 5 != 0).alias("plantable"), F.when(k % 2 == 0, "x").otherwise("y").alias("axis"))
    return kernels.edge_rows(cells, 0.0, float(side), RES)
