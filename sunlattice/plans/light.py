"""Direct light over a year through roofs, crowns and sheets: cubes, heat and what a scenario changes."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sunlattice.functions import solar
from sunlattice.operators import light, raster
from sunlattice.plans.registry import query
from sunlattice.plans.sun import STEPS_SQL, month_steps, sun_sql
from sunlattice.session import table, with_checkpoints

RES = 1.5
BY = ("scenario",)

#: A square grid that grows with the suppliers; roofs, crowns of both kinds and sheets on it, with and without more crowns.
CELLS_SQL = f"""{STEPS_SQL}, {sun_sql("e")},
suns AS (SELECT month, minute, elev, radians(az) AS az, w, mins / 60 + CASE WHEN month BETWEEN 4 AND 10 THEN 2 ELSE 1 END >= 12 AND mins / 60 + CASE WHEN month BETWEEN 4 AND 10 THEN 2 ELSE 1 END < 14 AS lunch, tan(radians(elev)) AS t FROM sun WHERE elev > 3),
g AS (SELECT (6 * ceil(sqrt(count(*))))::BIGINT AS n FROM supplier), line AS (SELECT unnest(generate_series(0, n - 1)) AS i FROM g), square AS (SELECT a.i, b.i AS j FROM line a, line b),
o AS (SELECT s_suppkey * 7 % n AS i, s_suppkey * 11 % n AS j, max(CASE WHEN s_suppkey % 3 = 0 THEN s_suppkey % 18 + 2 END)::DOUBLE AS roof,
  max(CASE WHEN s_suppkey % 3 = 1 THEN s_suppkey % 9 + 4 END)::DOUBLE AS gt, min(CASE WHEN s_suppkey % 3 = 1 THEN 2 + s_suppkey % 2 END)::DOUBLE AS gb,
  max(CASE WHEN s_suppkey % 3 = 2 THEN s_suppkey % 7 + 5 END)::DOUBLE AS lt, min(CASE WHEN s_suppkey % 3 = 2 THEN 1.5 END)::DOUBLE AS lb FROM supplier, g GROUP BY ALL),
sheet AS (SELECT DISTINCT (n_nationkey * 5 + di) % n AS i, (n_nationkey * 3 + dj) % n AS j, 6.0::DOUBLE AS sheet FROM nation, g, generate_series(0, 2) a(di), generate_series(0, 2) b(dj)),
base AS (SELECT q.i, q.j, roof, gt, gb, lt, lb, sheet, CASE WHEN roof > 0 THEN 9 ELSE (q.i * 3 + q.j * 5) % 6 END AS cover FROM square q LEFT JOIN o ON o.i = q.i AND o.j = q.j LEFT JOIN sheet s ON s.i = q.i AND s.j = q.j)"""

ONE_SQL = "cells AS (SELECT 'baseline' AS scenario, * FROM base)"
BOTH_SQL = """cells AS (SELECT 'baseline' AS scenario, * FROM base UNION ALL SELECT 'planted', i, j, roof, gt, gb, CASE WHEN (i * 5 + j) % 37 = 0 AND roof IS NULL THEN greatest(coalesce(lt, 0), 8) ELSE lt END,
  CASE WHEN (i * 5 + j) % 37 = 0 AND roof IS NULL THEN least(coalesce(lb, 9), 2.8::DOUBLE) ELSE lb END, sheet, cover FROM base)"""

CUBE_SQL = """ray AS (SELECT *, sqrt(di * di + dj * dj) * 1.5 * t AS z FROM (SELECT month, minute, t, min(k * 1.5 * t) AS step, round_even(-k * cos(az), 0)::BIGINT AS di, round_even(k * sin(az), 0)::BIGINT AS dj FROM suns, generate_series(1, 220) x(k) GROUP BY month, minute, t, di, dj)),
thing AS (SELECT *, greatest(coalesce(roof, 0), coalesce(gt, 0), coalesce(lt, 0)) AS top, max(greatest(coalesce(roof, 0), coalesce(gt, 0), coalesce(lt, 0))) OVER (PARTITION BY scenario) AS highest FROM cells WHERE roof > 0 OR gt > 0 OR lt > 0),
hit AS (SELECT scenario, i - di AS i, j - dj AS j, month, minute, coalesce(roof > z + 0.01, false) AS b, coalesce(gt > z + 0.01 AND gb < z, false) AS e, coalesce(lt > z + 0.01 AND lb < z, false) AS d, NULL AS s FROM thing JOIN ray ON top > z + 0.01 AND step <= highest
  UNION ALL SELECT scenario, i - round_even(-6 / (1.5 * t) * cos(az), 0)::BIGINT, j - round_even(6 / (1.5 * t) * sin(az), 0)::BIGINT, month, minute, false, false, false, 0.28::DOUBLE FROM cells, suns WHERE sheet > 0),
f AS (SELECT scenario, i, j, month, minute, CASE WHEN bool_or(b) THEN 0 ELSE CASE WHEN bool_or(e) THEN 0.15::DOUBLE ELSE 1 END * CASE WHEN bool_or(d) THEN CASE WHEN month IN (11, 12, 1, 2, 3) THEN 0.55::DOUBLE ELSE 0.15 END ELSE 1 END * coalesce(max(s), 1) END AS f FROM hit GROUP BY scenario, i, j, month, minute),
lost AS (SELECT scenario, i, j, month, count(*) FILTER (f < 0.5) * 0.25 AS dark, sum((1 - f) * w) * 0.25 / 1000 AS lost, count(*) FILTER (f < 0.5 AND lunch) * 15 AS gone FROM f JOIN suns USING (month, minute) GROUP BY ALL),
day AS (SELECT month, count(*) * 0.25 AS h, sum(w) * 0.25 / 1000 AS e, count(*) FILTER (lunch) * 15 AS m FROM suns GROUP BY 1),
cube AS (SELECT c.scenario, c.i, c.j, c.cover, day.month, h - coalesce(dark, 0) AS hours, e - coalesce(lost, 0) AS insol, (m - coalesce(gone, 0))::DOUBLE AS midday FROM cells c CROSS JOIN day LEFT JOIN lost l ON l.scenario = c.scenario AND l.i = c.i AND l.j = c.j AND l.month = day.month WHERE coalesce(roof, 0) <= 0)"""

SUMMER_SQL = """jja AS (SELECT scenario, i, j, any_value(cover) AS cover, avg(hours) AS hours, avg(insol) AS insol, avg(midday) AS lunch FROM cube WHERE month IN (6, 7, 8) GROUP BY ALL),
k AS (SELECT *, insol * CASE cover WHEN 0 THEN 0.75::DOUBLE WHEN 1 THEN 0.92 WHEN 2 THEN 0.7 WHEN 3 THEN 0.35 WHEN 4 THEN 0.2 WHEN 5 THEN 0.8 ELSE 0 END AS v FROM jja),
rows_ AS (SELECT a.scenario, a.i, a.j + d AS j, sum(v * exp(-(d * 1.5) * (d * 1.5) / 200.0::DOUBLE)) AS v, sum(exp(-(d * 1.5) * (d * 1.5) / 200.0::DOUBLE)) AS n FROM k a, generate_series(-20, 20) x(d) GROUP BY ALL),
mixed AS (SELECT scenario, i + d AS i, j, sum(v * exp(-(d * 1.5) * (d * 1.5) / 200.0::DOUBLE)) AS v, sum(n * exp(-(d * 1.5) * (d * 1.5) / 200.0::DOUBLE)) AS n FROM rows_, generate_series(-20, 20) x(d) GROUP BY ALL),
heat AS (SELECT j.*, m.v / greatest(m.n, 1e-9) AS absorbed FROM jja j JOIN mixed m USING (scenario, i, j))"""

ZONES_SQL = """zone AS (SELECT n_nationkey::BIGINT AS zone, n_nationkey * 5 % n + di AS i, n_nationkey * 3 % n + dj AS j FROM nation, g, generate_series(-5, 5) a(di), generate_series(-5, 5) b(dj) WHERE di * di + dj * dj <= 25),
stat AS (SELECT scenario, zone, count(*) AS n, avg(hours) AS hours, avg(lunch) AS lunch, 26 + 4.3 * avg(absorbed) AS temperature, 100 * avg((hours < 4)::INT) AS shade FROM heat JOIN zone USING (i, j) GROUP BY ALL)"""


def _side(spark, sf_dir) -> int:
    return 6 * int(-(-(table(spark, sf_dir, "supplier").count() ** 0.5) // 1))


def _cells(spark, sf_dir, both: bool = False) -> DataFrame:
    n, k = _side(spark, sf_dir), F.col("s_suppkey")
    square = spark.range(n * n).select(F.floor(F.col("id") / n).alias("i"), (F.col("id") % n).alias("j"))
    pick = lambda how, rest, x: how(F.when(k % 3 == rest, x)).cast("double")
    things = table(spark, sf_dir, "supplier").groupBy((k * 7 % n).alias("i"), (k * 11 % n).alias("j")).agg(
        pick(F.max, 0, k % 18 + 2).alias("roof"), pick(F.max, 1, k % 9 + 4).alias("green_top"), pick(F.min, 1, 2 + k % 2).alias("green_bottom"), pick(F.max, 2, k % 7 + 5).alias("leaf_top"), pick(F.min, 2, F.lit(1.5)).alias("leaf_bottom")
    )
    o = [F.explode(F.sequence(F.lit(0), F.lit(2))).alias(c) for c in ("di", "dj")]
    sheets = table(spark, sf_dir, "nation").select("n_nationkey", o[0]).select("*", o[1])
    sheets = sheets.select(((F.col("n_nationkey") * 5 + F.col("di")) % n).cast("long").alias("i"), ((F.col("n_nationkey") * 3 + F.col("dj")) % n).cast("long").alias("j"), F.lit(6.0).alias("sheet"), F.lit(0.28).alias("light")).distinct()
    cover = F.when(F.col("roof") > 0, raster.BUILDING).otherwise((F.col("i") * 3 + F.col("j") * 5) % 6).cast("int")
    base = square.join(things, ["i", "j"], "left").join(sheets, ["i", "j"], "left").withColumn("cover", cover).withColumn("scenario", F.lit("baseline"))
    if not both:
        return base
    more = ((F.col("i") * 5 + F.col("j")) % 37 == 0) & F.col("roof").isNull()
    planted = base.withColumns({"scenario": F.lit("planted"), "leaf_top": F.when(more, F.greatest(F.coalesce("leaf_top", F.lit(0.0)), F.lit(8.0))).otherwise(F.col("leaf_top")), "leaf_bottom": F.when(more, F.least(F.coalesce("leaf_bottom", F.lit(9.0)), F.lit(2.8))).otherwise(F.col("leaf_bottom"))})
    return base.unionByName(planted)


def year_suns(spark) -> DataFrame:
    """month, minute, elev, az, w, lunch of a year's steps with the sun up."""
    up = month_steps(with_checkpoints(spark)).filter(F.col("elev") > solar.MIN_ELEVATION)
    # A few hundred rows: worked out once, not in each of the joins.
    return up.withColumn("lunch", solar.is_lunch(F.col("minute").cast("double"), F.col("month"))).checkpoint()


def _heat(spark, sf_dir, both: bool = False) -> DataFrame:
    """scenario, i, j, cover, hours_jja, insol_jja, midday_jja, absorbed on the ground."""
    cells = _cells(spark, sf_dir, both)
    cube = light.month_cube(cells, year_suns(spark), RES, BY)
    summer = light.seasons(cube.filter(F.col("month").isin(*light.SEASONS["jja"])), BY).join(cells.select(*BY, "i", "j", "cover"), [*BY, "i", "j"]).checkpoint()
    return summer.join(light.heat(summer, RES, by=BY), [*BY, "i", "j"])


@query(f"WITH {CELLS_SQL}, {ONE_SQL}, {CUBE_SQL} SELECT month::INT AS month, i, j, round(hours, 6) AS hours, round(insol, 6) AS insol, midday FROM cube")
def light_cube(spark, sf_dir):
    """Sun, energy and lunch minutes of each ground cell in each month, through roofs, crowns and sheets."""
    cube = light.month_cube(_cells(spark, sf_dir), year_suns(spark), RES, BY)
    return cube.select("month", "i", "j", F.round("hours", 6).alias("hours"), F.round("insol", 6).alias("insol"), "midday")


@query(f"WITH {CELLS_SQL}, {ONE_SQL}, {CUBE_SQL} SELECT month::INT AS month, i, j, round(hours, 6) AS hours, round(insol, 6) AS insol, midday FROM cube")
def light_tiles(spark, sf_dir):
    """The same by small tiles, which gives the same rows."""
    cube = light.month_cube(_cells(spark, sf_dir), year_suns(spark), RES, BY, tile=32)
    return cube.select("month", "i", "j", F.round("hours", 6).alias("hours"), F.round("insol", 6).alias("insol"), "midday")


@query(f"WITH {CELLS_SQL}, {ONE_SQL}, {CUBE_SQL} SELECT i, j, round(avg(hours), 6) AS hours, round(avg(insol), 6) AS insol FROM cube WHERE i BETWEEN 20 AND 33 AND j BETWEEN 11 AND 40 GROUP BY ALL")
def light_window(spark, sf_dir):
    """The year's means of the cells around a place, shaded by all that stands outside too."""
    cube = light.month_cube(_cells(spark, sf_dir), year_suns(spark), RES, BY, window=(20, 33, 11, 40))
    return light.seasons(cube).select("i", "j", F.round("hours_annual", 6).alias("hours"), F.round("insol_annual", 6).alias("insol"))


@query(f"""WITH {CELLS_SQL}, {ONE_SQL}, {CUBE_SQL} SELECT i, j, round(avg(hours), 6) AS hours_annual, round(avg(midday), 6) AS midday_annual, round(avg(hours) FILTER (month IN (12, 1, 2)), 6) AS hours_djf,
 round(avg(hours) FILTER (month IN (3, 4, 5)), 6) AS hours_mam, round(avg(hours) FILTER (month IN (6, 7, 8)), 6) AS hours_jja, round(avg(hours) FILTER (month IN (9, 10, 11)), 6) AS hours_son FROM cube GROUP BY ALL""")
def season_rasters(spark, sf_dir):
    """Sun of the year and of each season, and lunch minutes, by cell."""
    cube = light.month_cube(_cells(spark, sf_dir), year_suns(spark), RES, BY)
    kept = ["hours_annual", "midday_annual", "hours_djf", "hours_mam", "hours_jja", "hours_son"]
    return light.seasons(cube).select("i", "j", *[F.round(c, 6).alias(c) for c in kept])


@query(f"WITH {CELLS_SQL}, {ONE_SQL}, {CUBE_SQL}, {SUMMER_SQL} SELECT i, j, round(absorbed, 6) AS absorbed, round(26 + 4.3 * absorbed, 6) AS temperature FROM heat")
def heat_field(spark, sf_dir):
    """Energy that the ground takes up in summer, mixed over 10 m, and the temperature that goes with it."""
    absorbed = F.col("absorbed")
    return _heat(spark, sf_dir).select("i", "j", F.round(absorbed, 6).alias("absorbed"), F.round(light.surface_temperature(absorbed), 6).alias("temperature"))


@query(f"""WITH {CELLS_SQL}, {BOTH_SQL}, {CUBE_SQL}, {SUMMER_SQL}, {ZONES_SQL} SELECT b.zone, b.n, round(b.hours, 6) AS hours, round(b.shade, 6) AS shade, round(b.hours - p.hours, 6) AS less_sun, round(b.temperature - p.temperature, 6) AS cooler,
 round(p.lunch, 6) AS lunch, round(CASE WHEN b.hours - p.hours > 0.05 THEN 1000 / (b.hours - p.hours) END, 4) AS cost FROM stat b JOIN stat p USING (zone) WHERE b.scenario = 'baseline' AND p.scenario = 'planted'""")
def footprint_gains(spark, sf_dir):
    """Sun, shade and temperature of footprints, what a scenario takes from them, and its cost for an hour less."""
    n, k = _side(spark, sf_dir), F.col("n_nationkey")
    around = F.explode(F.array(*[F.struct(F.lit(a).alias("i"), F.lit(b).alias("j")) for a, b in raster.disc(5.0)]))
    zone = table(spark, sf_dir, "nation").withColumn("o", around).select(k.cast("long").alias("zone"), (k * 5 % n + F.col("o.i")).cast("long").alias("i"), (k * 3 % n + F.col("o.j")).cast("long").alias("j"))
    stats = light.zone_stats(_heat(spark, sf_dir, both=True), zone, BY).checkpoint()
    b, p = (stats.filter(F.col("scenario") == s).alias(s) for s in ("baseline", "planted"))
    less = F.col("baseline.hours") - F.col("planted.hours")
    return b.join(p, F.col("baseline.zone") == F.col("planted.zone")).select(
        "baseline.zone", "baseline.n", *[F.round(f"baseline.{c}", 6).alias(c) for c in ("hours", "shade")], F.round(less, 6).alias("less_sun"),
        F.round(F.col("baseline.temperature") - F.col("planted.temperature"), 6).alias("cooler"), F.round("planted.lunch", 6).alias("lunch"), F.round(F.when(less > 0.05, 1000 / less), 4).alias("cost"),
    )


@query(f"""WITH {CELLS_SQL}, {BOTH_SQL}, {CUBE_SQL}, {SUMMER_SQL}, {ZONES_SQL}, whole AS (SELECT DISTINCT i, j FROM zone)
SELECT scenario, count(*) AS cells, round(avg(hours), 6) AS hours, round(26 + 4.3 * avg(absorbed), 6) AS temperature, round(100 * avg((hours < 4)::INT), 6) AS shade, round(count(*) FILTER (cover = 3) * 2.25, 4) AS green_m2 FROM heat JOIN whole USING (i, j) GROUP BY scenario""")
def site_context(spark, sf_dir):
    """The same over the union of all footprints, with their green, by scenario."""
    n, k = _side(spark, sf_dir), F.col("n_nationkey")
    marked = table(spark, sf_dir, "nation").select((k * 5 % n).cast("long").alias("i"), (k * 3 % n).cast("long").alias("j"))
    zone = raster.dilate(marked, 5.0)
    found = _heat(spark, sf_dir, both=True).join(zone, ["i", "j"])
    return found.groupBy("scenario").agg(
        F.count("*").alias("cells"), F.round(F.avg("hours_jja"), 6).alias("hours"), F.round(light.surface_temperature(F.avg("absorbed")), 6).alias("temperature"),
        F.round(100 * F.avg((F.col("hours_jja") < light.SHADED_UNDER).cast("int")), 6).alias("shade"), F.round(F.count(F.when(F.col("cover") == raster.GRASS, 1)) * 2.25, 4).alias("green_m2"),
    )
