"""Plane geometry on columns: points, rings (arrays of structs x, y), grid cells."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F

#: Metres of a degree of longitude at the equator and of latitude.
METRES_LON, METRES_LAT = 111320.0, 111132.0


def to_local(lat: Column, lon: Column, lat0: Column, lon0: Column) -> tuple[Column, Column]:
    """Local metres east and north of an origin."""
    return (lon - lon0) * METRES_LON * F.cos(F.radians(lat0)), (lat - lat0) * METRES_LAT


def distance(ax: Column, ay: Column, bx: Column, by: Column) -> Column:
    return F.hypot(ax - bx, ay - by)


def rectangle_distance(x: Column, y: Column, xmin: float, xmax: float, ymin: float, ymax: float) -> Column:
    """Distance to a rectangle, 0 inside."""
    return F.hypot(F.greatest(xmin - x, F.lit(0.0), x - xmax), F.greatest(ymin - y, F.lit(0.0), y - ymax))


def in_box(x: Column, y: Column, xmin: float, xmax: float, ymin: float, ymax: float) -> Column:
    """Inside or on the edge; null coordinates are out."""
    return F.coalesce(x.between(xmin, xmax) & y.between(ymin, ymax), F.lit(False))


def _edges(ring: Column) -> Column:
    n = F.size(ring)
    return F.transform(F.sequence(F.lit(0), n - 1), lambda k: F.struct(ring[k].alias("a"), ring[(k + 1) % n].alias("b")))


def signed_area(ring: Column) -> Column:
    """Shoelace sum, positive when counter-clockwise; the ring closes itself."""
    return F.aggregate(_edges(ring), F.lit(0.0), lambda s, e: s + e.a.x * e.b.y - e.b.x * e.a.y) / 2


def centroid(ring: Column) -> tuple[Column, Column]:
    """Centre of the area; the mean of the corners where the area is next to nothing."""
    area, n = signed_area(ring), F.size(ring)

    def one(c: str) -> Column:
        weighed = F.aggregate(_edges(ring), F.lit(0.0), lambda s, e: s + (e.a[c] + e.b[c]) * (e.a.x * e.b.y - e.b.x * e.a.y))
        mean = F.aggregate(ring, F.lit(0.0), lambda s, p: s + p[c]) / n
        return F.when(F.abs(area) < 1e-9, mean).otherwise(weighed / (6 * area))

    return one("x"), one("y")


def contains(ring: Column, x: Column, y: Column) -> Column:
    """Whether a point is in a ring, by the number of edges to its right."""
    crossed = F.filter(_edges(ring), lambda e: ((e.a.y > y) != (e.b.y > y)) & (x < e.a.x + (e.b.x - e.a.x) * F.try_divide(y - e.a.y, e.b.y - e.a.y)))
    return F.size(crossed) % 2 == 1


def cell_of(x: Column, y: Column, xmin: float, ymax: float, res: float) -> tuple[Column, Column]:
    """Row and column of a point; truncated towards zero, so up to a cell beyond the north and west edges falls in the first."""
    return ((ymax - y) / res).cast("int"), ((x - xmin) / res).cast("int")


def cell_centre(i: Column, j: Column, xmin: float, ymax: float, res: float) -> tuple[Column, Column]:
    return xmin + (j + 0.5) * res, ymax - (i + 0.5) * res


def _span(ring: Column, c: str) -> tuple[Column, Column]:
    values = F.transform(ring, lambda p: p[c])
    return F.array_min(values), F.array_max(values)


def corner_mean(ring: Column) -> tuple[Column, Column]:
    """Mean of the corners, as they are listed; null for a ring without any."""
    x, y = (F.try_divide(F.aggregate(ring, F.lit(0.0), lambda s, p: s + p[c]), F.size(ring)) for c in ("x", "y"))
    return x, y


def long_axis(ring: Column) -> Column:
    """'x' or 'y', the direction in which a ring is longer; 'y' if both are alike."""
    (x0, x1), (y0, y1) = _span(ring, "x"), _span(ring, "y")
    return F.when(y1 - y0 >= x1 - x0, "y").otherwise("x")


def in_central_part(ring: Column, level: float, x: Column, y: Column) -> Column:
    """Whether a point is within the central share `level` of a ring's length, ends included."""
    (x0, x1), (y0, y1) = _span(ring, "x"), _span(ring, "y")
    near = lambda v, lo, hi: F.abs(v - (lo + hi) / 2) <= (hi - lo) / 2 * level
    return F.when(long_axis(ring) == "y", near(y, y0, y1)).otherwise(near(x, x0, x1))


def window_box(ring: Column, lat0: float, lon0: float, margin: float = 45.0) -> Column:
    """Latitude and longitude of a ring's corner mean, and half its box with a margin on each side."""
    (x0, x1), (y0, y1), (cx, cy) = _span(ring, "x"), _span(ring, "y"), corner_mean(ring)
    lat, lon = lat0 + cy / METRES_LAT, lon0 + cx / (METRES_LON * F.cos(F.radians(F.lit(lat0))))
    return F.array(F.bround(lat, 6), F.bround(lon, 6), F.bround((x1 - x0) / 2 + margin, 1), F.bround((y1 - y0) / 2 + margin, 1))


#: Half axis (metres) and flattening of the ellipsoid, scale on the meridian and false easting of the grid.
HALF_AXIS, FLATTENING, GRID_SCALE, FALSE_EASTING = 6378137.0, 1 / 298.257223563, 0.9996, 500000.0


def grid_place(lat, lon, meridian: float, lib=F):
    """Easting and northing (northern half) of a transverse Mercator grid; columns, or arrays where lib is numpy."""
    e2 = FLATTENING * (2 - FLATTENING)
    ep2 = e2 / (1 - e2)
    phi = lib.radians(lat)
    sin, cos, tan = lib.sin(phi), lib.cos(phi), lib.tan(phi)
    nu, t, c = HALF_AXIS / lib.sqrt(1 - e2 * sin * sin), tan * tan, ep2 * cos * cos
    a = lib.radians(lon - meridian) * cos
    arc = HALF_AXIS * (
        (1 - e2 / 4 - 3 * e2**2 / 64 - 5 * e2**3 / 256) * phi
        - (3 * e2 / 8 + 3 * e2**2 / 32 + 45 * e2**3 / 1024) * lib.sin(2 * phi)
        + (15 * e2**2 / 256 + 45 * e2**3 / 1024) * lib.sin(4 * phi)
        - (35 * e2**3 / 3072) * lib.sin(6 * phi)
    )
    a2 = a * a
    east = nu * a * (1 + a2 * ((1 - t + c) / 6 + a2 * (5 - 18 * t + t * t + 72 * c - 58 * ep2) / 120))
    north = arc + nu * tan * a2 * (0.5 + a2 * ((5 - t + 9 * c + 4 * c * c) / 24 + a2 * (61 - 58 * t + t * t + 600 * c - 330 * ep2) / 720))
    return FALSE_EASTING + GRID_SCALE * east, GRID_SCALE * north


def from_grid(lat0: float, lon0: float, meridian: float, reach: float = 0.005) -> Callable[[Column, Column], tuple[Column, Column]]:
    """A map of eastings and northings to local metres: the affine fit over a lattice of places around the origin.

    The lattice has 81 places whatever the data, so the fit is made once, on the driver.
    """
    lat, lon = (v.ravel() for v in np.meshgrid(lat0 + np.linspace(-reach, reach, 9), lon0 + np.linspace(-reach, reach, 9)))
    east, north = grid_place(lat, lon, meridian, np)
    e0, n0 = float(east.mean()), float(north.mean())
    local = np.column_stack([(lon - lon0) * METRES_LON * np.cos(np.radians(lat0)), (lat - lat0) * METRES_LAT])
    fit = np.linalg.lstsq(np.column_stack([east - e0, north - n0, np.ones(len(east))]), local, rcond=None)[0].tolist()

    def place(e: Column, n: Column) -> tuple[Column, Column]:
        x, y = (fit[0][k] * (e - e0) + fit[1][k] * (n - n0) + fit[2][k] for k in (0, 1))
        return x, y

    return place
