"""Sun position and clear-sky irradiance as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Solar constant (W/m2), least elevation of usable sun (degrees), sampling of a day (UTC minutes).
SOLAR_CONSTANT = 1361.0
MIN_ELEVATION = 3.0
FIRST_MINUTE, LAST_MINUTE, STEP = 180, 1185, 15


def julian_date(day: Column, minutes: Column) -> Column:
    """Julian date of a calendar day and minutes of UTC."""
    return F.datediff(day, F.lit("1970-01-01").cast("date")) + F.lit(2440587.5) + minutes / F.lit(1440.0)


def _sin(x):
    return F.sin(F.radians(x))


def _cos(x):
    return F.cos(F.radians(x))


def position(jd: Column, minutes: Column, lat: float, lon: float) -> tuple[Column, Column]:
    """Elevation and azimuth in degrees (NOAA's algorithm)."""
    t = (jd - 2451545.0) / 36525.0
    mean_lon = F.pmod(280.46646 + t * (36000.76983 + t * 0.0003032), F.lit(360.0))
    anomaly = 357.52911 + t * (35999.05029 - 0.0001537 * t)
    ecc = 0.016708634 - t * (0.000042037 + 0.0000001267 * t)
    centre = _sin(anomaly) * (1.914602 - t * (0.004817 + 0.000014 * t)) + _sin(2 * anomaly) * (0.019993 - 0.000101 * t) + _sin(3 * anomaly) * 0.000289
    node = 125.04 - 1934.136 * t
    apparent = mean_lon + centre - 0.00569 - 0.00478 * _sin(node)
    tilt = 23.0 + (26.0 + (21.448 - t * (46.815 + t * (0.00059 - t * 0.001813))) / 60.0) / 60.0 + 0.00256 * _cos(node)
    decl = F.asin(_sin(tilt) * _sin(apparent))
    y = F.pow(F.tan(F.radians(tilt / 2)), 2)
    equation = 4 * F.degrees(y * _sin(2 * mean_lon) - 2 * ecc * _sin(anomaly) + 4 * ecc * y * _sin(anomaly) * _cos(2 * mean_lon) - 0.5 * y * y * _sin(4 * mean_lon) - 1.25 * ecc * ecc * _sin(2 * anomaly))
    hour = F.pmod(minutes + equation + 4 * lon, F.lit(1440.0)) / 4 - 180
    here = F.radians(F.lit(lat))
    cos_zenith = F.greatest(F.lit(-1.0), F.least(F.lit(1.0), F.sin(here) * F.sin(decl) + F.cos(here) * F.cos(decl) * _cos(hour)))
    zenith = F.acos(cos_zenith)
    ratio = F.greatest(F.lit(-1.0), F.least(F.lit(1.0), (F.sin(here) * cos_zenith - F.sin(decl)) / (F.cos(here) * F.sin(zenith))))
    from_south = F.degrees(F.acos(ratio))
    azimuth = F.when(hour > 0, F.pmod(from_south + 180, F.lit(360.0))).otherwise(F.pmod(540 - from_south, F.lit(360.0)))
    return 90 - F.degrees(zenith), azimuth


def direct_horizontal(elevation: Column) -> Column:
    """Clear-sky direct irradiance on the ground, W/m2; 0 with the sun down."""
    up = F.greatest(elevation, F.lit(0.01))
    mass = 1 / (_sin(up) + 0.50572 * F.pow(up + 6.07995, F.lit(-1.6364)))
    return F.when(elevation > 0, SOLAR_CONSTANT * F.pow(F.lit(0.7), F.pow(mass, F.lit(0.678))) * _sin(up)).otherwise(F.lit(0.0))


def utc_offset(month: Column) -> Column:
    """Hours ahead of UTC: summer time from April to October."""
    return F.when(month.between(4, 10), 2).otherwise(1)


def is_lunch(minutes: Column, month: Column) -> Column:
    """Local time from 12:00, before 14:00."""
    local = minutes / 60 + utc_offset(month)
    return (local >= 12) & (local < 14)
