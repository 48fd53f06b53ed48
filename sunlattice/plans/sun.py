"""Sun position and exposure over the events and over the months of a year."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sunlattice.functions import solar
from sunlattice.plans.registry import query
from sunlattice.session import table

LAT, LON = 45.48, 9.23


def sun_sql(rows: str) -> str:
    """CTEs that give `sun` (columns of rows, elev, az, w) from a relation with jd, mins."""
    lat, lon = f"{LAT}::DOUBLE", f"{LON}::DOUBLE"
    return f"""
    s0 AS (SELECT *, (jd - 2451545.0::DOUBLE) / 36525.0::DOUBLE AS t FROM {rows}),
    s1 AS (SELECT *,
      (((280.46646::DOUBLE + t * (36000.76983::DOUBLE + t * 0.0003032::DOUBLE)) % 360) + 360) % 360 AS l0,
      357.52911::DOUBLE + t * (35999.05029::DOUBLE - 0.0001537::DOUBLE * t) AS m,
      0.016708634::DOUBLE - t * (0.000042037::DOUBLE + 0.0000001267::DOUBLE * t) AS e,
      radians(125.04::DOUBLE - 1934.136::DOUBLE * t) AS om FROM s0),
    s2 AS (SELECT *,
      l0 + sin(radians(m)) * (1.914602::DOUBLE - t * (0.004817::DOUBLE + 0.000014::DOUBLE * t))
        + sin(radians(2 * m)) * (0.019993::DOUBLE - 0.000101::DOUBLE * t) + sin(radians(3 * m)) * 0.000289::DOUBLE
        - 0.00569::DOUBLE - 0.00478::DOUBLE * sin(om) AS lam,
      radians(23 + (26 + (21.448::DOUBLE - t * (46.815::DOUBLE + t * (0.00059::DOUBLE - t * 0.001813::DOUBLE))) / 60) / 60
        + 0.00256::DOUBLE * cos(om)) AS eps FROM s1),
    s3 AS (SELECT *, asin(sin(eps) * sin(radians(lam))) AS decl, tan(eps / 2) * tan(eps / 2) AS y FROM s2),
    s4 AS (SELECT *, ((((mins + 4 * degrees(y * sin(radians(2 * l0)) - 2 * e * sin(radians(m))
        + 4 * e * y * sin(radians(m)) * cos(radians(2 * l0)) - 0.5::DOUBLE * y * y * sin(radians(4 * l0))
        - 1.25::DOUBLE * e * e * sin(radians(2 * m))) + 4 * {lon}) % 1440) + 1440) % 1440) / 4 - 180 AS ha FROM s3),
    s5 AS (SELECT *, greatest(-1, least(1, sin(radians({lat})) * sin(decl) + cos(radians({lat})) * cos(decl) * cos(radians(ha)))) AS cz FROM s4),
    s6 AS (SELECT *, 90 - degrees(acos(cz)) AS elev,
      degrees(acos(greatest(-1, least(1, (sin(radians({lat})) * cz - sin(decl)) / (cos(radians({lat})) * sin(acos(cz))))))) AS fs FROM s5),
    sun AS (SELECT *, CASE WHEN ha > 0 THEN (fs + 180) % 360 ELSE (540 - fs) % 360 END AS az,
      CASE WHEN elev > 0 THEN 1361 * power(0.7::DOUBLE, power(1 / (sin(radians(greatest(elev, 0.01::DOUBLE)))
        + 0.50572::DOUBLE * power(greatest(elev, 0.01::DOUBLE) + 6.07995::DOUBLE, -1.6364::DOUBLE)), 0.678::DOUBLE))
        * sin(radians(greatest(elev, 0.01::DOUBLE))) ELSE 0 END AS w FROM s6)"""


EVENTS_SQL = """e AS (SELECT *, date_diff('day', DATE '1970-01-01', CAST(ts AS DATE)) + 2440587.5::DOUBLE
      + (hour(ts) * 60 + minute(ts)) / 1440.0::DOUBLE AS jd, (hour(ts) * 60 + minute(ts))::DOUBLE AS mins FROM events)"""

STEPS_SQL = """e AS (SELECT m AS month, q AS minute, q::DOUBLE AS mins,
      date_diff('day', DATE '1970-01-01', make_date(2025, m::INT, 15)) + 2440587.5::DOUBLE + q / 1440.0::DOUBLE AS jd
      FROM generate_series(1, 12) a(m), generate_series(180, 1185, 15) b(q))"""


def _event_suns(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events").select("ts", "value", "user_id")
    minutes = (F.hour("ts") * 60 + F.minute("ts")).cast("double")
    elev, az = solar.position(solar.julian_date(F.to_date("ts"), minutes), minutes, LAT, LON)
    return e.withColumns({"minutes": minutes, "elev": elev, "az": az})


def month_steps(spark: SparkSession) -> DataFrame:
    """month, minute, elev, az, w for the middle of each month of 2025."""
    steps = spark.range(1, 13).select(F.col("id").cast("int").alias("month"), F.explode(F.sequence(F.lit(solar.FIRST_MINUTE), F.lit(solar.LAST_MINUTE), F.lit(solar.STEP))).alias("minute"))
    minutes = F.col("minute").cast("double")
    elev, az = solar.position(solar.julian_date(F.make_date(F.lit(2025), "month", F.lit(15)), minutes), minutes, LAT, LON)
    steps = steps.withColumns({"elev": elev, "az": az})
    return steps.withColumn("w", solar.direct_horizontal(F.col("elev")))


@query(f"""WITH {EVENTS_SQL}, {sun_sql("e")}
SELECT hour(ts) AS hour, count(*) AS n, round(avg(elev), 6) AS mean_elevation, round(sum(w), 4) AS total_w
FROM sun WHERE elev > 3 GROUP BY 1""")
def solar_by_hour(spark, sf_dir):
    """Elevation and irradiance at the times of events with the sun up, by UTC hour."""
    e = _event_suns(spark, sf_dir).filter(F.col("elev") > solar.MIN_ELEVATION)
    return e.groupBy(F.hour("ts").cast("long").alias("hour")).agg(F.count("*").alias("n"), F.round(F.avg("elev"), 6).alias("mean_elevation"), F.round(F.sum(solar.direct_horizontal(F.col("elev"))), 4).alias("total_w"))


@query(f"""WITH {STEPS_SQL}, {sun_sql("e")}
SELECT month, count(*) * 15 / 60.0::DOUBLE AS daylight, round(sum(w) * 0.25 / 1000, 6) AS kwh, round(max(elev), 6) AS highest,
  round(avg(az), 5) AS mean_azimuth FROM sun WHERE elev > 3 GROUP BY month""")
def solar_by_month(spark, sf_dir):
    """Hours with the sun up, clear-sky energy and highest sun of the middle day of each month."""
    up = month_steps(spark).filter(F.col("elev") > solar.MIN_ELEVATION)
    return up.groupBy(F.col("month").cast("long").alias("month")).agg((F.count("*") * 15 / 60.0).alias("daylight"), F.round(F.sum("w") * 0.25 / 1000, 6).alias("kwh"), F.round(F.max("elev"), 6).alias("highest"), F.round(F.avg("az"), 5).alias("mean_azimuth"))


@query(f"""WITH {EVENTS_SQL}, {sun_sql("e")}, l AS (SELECT *, mins / 60 + CASE WHEN month(ts) BETWEEN 4 AND 10 THEN 2 ELSE 1 END AS loc FROM sun)
SELECT CAST(CAST(ts AS DATE) AS VARCHAR) AS day, count(*) AS n, round(sum(w), 4) AS total_w, round(sum(value), 4) AS total_value
FROM l WHERE loc >= 12 AND loc < 14 AND elev > 3 GROUP BY 1""")
def lunch_window(spark, sf_dir):
    """Irradiance of events in the local lunch hours, by day."""
    e = _event_suns(spark, sf_dir).filter(F.col("elev") > solar.MIN_ELEVATION).filter(solar.is_lunch(F.col("minutes"), F.month("ts")))
    return e.groupBy(F.to_date("ts").cast("string").alias("day")).agg(F.count("*").alias("n"), F.round(F.sum(solar.direct_horizontal(F.col("elev"))), 4).alias("total_w"), F.round(F.sum("value"), 4).alias("total_value"))


@query(f"""WITH {STEPS_SQL}, {sun_sql("e")}, c AS (SELECT * FROM (SELECT *, degrees(atan2(h, d)) AS hidden
  FROM sun, (SELECT s_suppkey, (s_suppkey % 17 + 2)::DOUBLE AS h, (s_suppkey % 29 + 5)::DOUBLE AS d FROM supplier)) WHERE elev > 3 AND elev > hidden),
m AS (SELECT s_suppkey, month, count(*) * 0.25::DOUBLE AS hours FROM c GROUP BY ALL),
g AS (SELECT s.s_suppkey, x.month, coalesce(m.hours, 0) AS hours FROM supplier s CROSS JOIN generate_series(1, 12) x(month) LEFT JOIN m ON m.s_suppkey = s.s_suppkey AND m.month = x.month)
SELECT s_suppkey, round(avg(hours), 6) AS annual, round(avg(hours) FILTER (month IN (12, 1, 2)), 6) AS djf, round(avg(hours) FILTER (month IN (3, 4, 5)), 6) AS mam,
 round(avg(hours) FILTER (month IN (6, 7, 8)), 6) AS jja, round(avg(hours) FILTER (month IN (9, 10, 11)), 6) AS son FROM g GROUP BY 1""")
def season_means(spark, sf_dir):
    """Sun hours of points behind a wall of a height and distance: mean of months by season and over the year."""
    suns = month_steps(spark).filter(F.col("elev") > solar.MIN_ELEVATION).select("month", "elev")
    points = table(spark, sf_dir, "supplier").select("s_suppkey", (F.col("s_suppkey") % 17 + 2).cast("double").alias("h"), (F.col("s_suppkey") % 29 + 5).cast("double").alias("d"))
    lit = points.join(F.broadcast(suns), F.col("elev") > F.degrees(F.atan2("h", "d")))
    hours = lit.groupBy("s_suppkey", "month").agg((F.count("*") * 0.25).alias("hours"))
    every = points.select("s_suppkey", F.explode(F.sequence(F.lit(1), F.lit(12))).alias("month")).join(hours, ["s_suppkey", "month"], "left").withColumn("hours", F.coalesce("hours", F.lit(0.0)))
    seasons = {"djf": (12, 1, 2), "mam": (3, 4, 5), "jja": (6, 7, 8), "son": (9, 10, 11)}
    return every.groupBy("s_suppkey").agg(F.round(F.avg("hours"), 6).alias("annual"), *[F.round(F.avg(F.when(F.col("month").isin(*m), F.col("hours"))), 6).alias(k) for k, m in seasons.items()])
