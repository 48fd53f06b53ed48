"""Grid operators: rows are cells (i, j)."""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


#: Fixed value: least height over a ray that shades (metres).
MARGIN = 0.01


def disc(radius: float) -> list[tuple[int, int]]:
    """Offsets of the cells whose centre is within a radius (in cells)."""
    r = int(radius)
    return [(a, b) for a in range(-r, r + 1) for b in range(-r, r + 1) if a * a + b * b <= radius * radius]


def _offsets(offsets: list[tuple]) -> Column:
    return F.explode(F.array(*[F.struct(*[F.lit(v).alias(n) for v, n in zip(o, ("di", "dj", "k"))]) for o in offsets]))


def dilate(cells: DataFrame, radius: float) -> DataFrame:
    """Distinct cells within a radius of any cell."""
    return cells.withColumn("o", _offsets(disc(radius))).select((F.col("i") + F.col("o.di")).alias("i"), (F.col("j") + F.col("o.dj")).alias("j")).distinct()


def gaussian_mix(cells: DataFrame, sigma: float, reach: int) -> DataFrame:
    """Mean of v weighed by a Gaussian over the cells that are there (i, j, v): two passes along the axes."""
    w = [float(np.exp(-k * k / (2 * sigma * sigma))) for k in range(-reach, reach + 1)]

    def blur(df: DataFrame, axis: str) -> DataFrame:
        other = "j" if axis == "i" else "i"
        o = F.explode(F.array(*[F.struct(F.lit(k - reach).alias("d"), F.lit(x).alias("w")) for k, x in enumerate(w)]))
        spread = df.withColumn("o", o).withColumn(axis, F.col(axis) + F.col("o.d"))
        return spread.groupBy(axis, other).agg(F.sum(F.col("v") * F.col("o.w")).alias("v"), F.sum(F.col("n") * F.col("o.w")).alias("n"))

    mixed = blur(blur(cells.select("i", "j", "v", F.lit(1.0).alias("n")), "i"), "j")
    return cells.select("i", "j").join(mixed, ["i", "j"]).select("i", "j", (F.col("v") / F.col("n")).alias("v"))


def segment_samples(segments: DataFrame, step: float) -> DataFrame:
    """Points along segments (id, ax, ay, bx, by), ends included: int(length / step) + 1 of them, two at least."""
    length = F.hypot(F.col("bx") - F.col("ax"), F.col("by") - F.col("ay"))
    n = F.greatest(F.lit(2), (length / step).cast("int") + 1)
    t = F.col("k") / (F.col("n") - 1)
    rows = segments.withColumn("len", length).withColumn("n", n).withColumn("k", F.explode(F.sequence(F.lit(0), F.col("n") - 1)))
    return rows.select("id", "k", "len", (F.col("ax") + t * (F.col("bx") - F.col("ax"))).alias("x"), (F.col("ay") + t * (F.col("by") - F.col("ay"))).alias("y"))


def flow_cells(segments: DataFrame, step: float, top: float, res: float) -> DataFrame:
    """i, j, flow: flows of segments (id, flow, ax, ay, bx, by), a row each, summed over the cells at their samples and the eight around each.

    A segment counts once a cell. Samples are those of `segment_samples`, cells are
    (top - y) / res and x / res, at nine decimals, cut to whole numbers. Cells along
    a straight line only move on in each axis, so a sample's new cells are those
    that the sample before does not reach, and no row of a segment leaves its task.
    """
    ends = ["ax", "ay", "bx", "by"]
    whole = F.lit(True)
    for c in ends:
        whole = whole & F.col(c).isNotNull()

    def cell(v: np.ndarray) -> np.ndarray:
        return np.trunc(np.copysign(np.floor(np.abs(v * 1e9) + 0.5), v) / 1e9).astype(np.int64)

    def sums(i: np.ndarray, j: np.ndarray, w: np.ndarray, known: np.ndarray) -> pa.RecordBatch:
        i0, j0 = i.min(), j.min()
        high, wide = int(i.max() - i0) + 1, int(j.max() - j0) + 1
        if high * wide <= 1 << 22:
            at, n = (i - i0) * wide + (j - j0), high * wide
            ci, cj = np.arange(n) // wide + i0, np.arange(n) % wide + j0
        else:
            (ci, cj), at = np.unique(np.stack([i, j]), axis=1, return_inverse=True)
            at, n = at.reshape(-1), len(ci)
        flow, seen, valued = np.bincount(at, w, n), np.zeros(n, bool), np.zeros(n, bool)
        seen[at], valued[at[known]] = True, True
        return pa.RecordBatch.from_arrays([pa.array(ci[seen]), pa.array(cj[seen]), pa.array(flow[seen], mask=~valued[seen])], ["i", "j", "flow"])

    def run(batches, most: int = 1 << 19):
        for batch in batches:
            if not batch.num_rows:
                continue
            known = batch.column(0).is_valid().to_numpy(zero_copy_only=False)
            flow = np.where(known, batch.column(0).to_numpy(zero_copy_only=False), 0.0)
            ax, ay, dx, dy = (batch.column(k).to_numpy() for k in range(1, 5))
            dx, dy = dx - ax, dy - ay
            length = np.sqrt(dx * dx + dy * dy)
            if not np.isfinite(length).all():
                raise ValueError("segments must have finite ends")
            n = np.maximum(2, np.trunc(length / step).astype(np.int64) + 1)
            end = np.cumsum(n)
            for lo in range(0, int(end[-1]), most):
                # One sample more in front, for the cells that it has already.
                flat = np.arange(max(lo - 1, 0), min(lo + most, int(end[-1])))
                row = np.searchsorted(end, flat, side="right")
                k = flat - (end - n)[row]
                t = k / (n[row] - 1)
                i, j = cell((top - (ay[row] + t * dy[row])) / res), cell((ax[row] + t * dx[row]) / res)
                di, dj = np.diff(i, prepend=i[0]), np.diff(j, prepend=j[0])
                fresh = k == 0
                moves = (fresh | (di != 0) | (dj != 0)) & (flat >= lo)
                i, j, di, dj, fresh, row = i[moves], j[moves], di[moves], dj[moves], fresh[moves], row[moves]
                found = []
                for a in (-1, 0, 1):
                    for b in (-1, 0, 1):
                        new = np.flatnonzero(fresh | (np.abs(di + a) > 1) | (np.abs(dj + b) > 1))
                        found.append((i[new] + a, j[new] + b, row[new]))
                i, j, row = (np.concatenate(c) for c in zip(*found))
                if len(i):
                    yield sums(i, j, flow[row], known[row])

    parts = segments.filter(whole).select(*[F.col(c).cast("double") for c in ("flow", *ends)]).mapInArrow(run, "i long, j long, flow double")
    # Rows that lack a place, by the cells that they have.
    lacking = segments.filter(~whole)
    at = segment_samples(lacking, step).select("id", F.round((top - F.col("y")) / res, 9).cast("long").alias("i"), F.round(F.col("x") / res, 9).cast("long").alias("j"))
    around = F.explode(F.array(*[F.struct(F.lit(a).alias("i"), F.lit(b).alias("j")) for a in (-1, 0, 1) for b in (-1, 0, 1)]))
    wide = at.withColumn("o", around).select("id", (F.col("i") + F.col("o.i")).alias("i"), (F.col("j") + F.col("o.j")).alias("j")).distinct()
    return parts.union(wide.join(lacking.select("id", "flow"), "id").select("i", "j", F.col("flow").cast("double"))).groupBy("i", "j").agg(F.sum("flow").alias("flow"))


def stamp_crowns(plants: DataFrame, res: float) -> DataFrame:
    """i, j, top, bottom of crowns (x, y, h, crown): ellipsoids on cells, highest top and lowest bottom.

    Heights are held to 3-30 m, radii to 1-8 m, the crown begins at 2 m or 35 % of the height.
    """
    h = F.greatest(F.lit(3.0), F.least(F.lit(30.0), F.col("h")))
    r = F.greatest(F.lit(1.0), F.least(F.lit(8.0), F.col("crown") / 2))
    t = plants.withColumn("h", h).withColumn("r", r).withColumn("base", F.greatest(F.lit(2.0), 0.35 * F.col("h")))
    reach = (F.col("r") / res).cast("int") + 1
    t = t.withColumn("ci", F.floor(F.col("y") / res)).withColumn("cj", F.floor(F.col("x") / res)).withColumn("di", F.explode(F.sequence(-reach, reach))).withColumn("dj", F.explode(F.sequence(-reach, reach)))
    t = t.withColumn("i", F.col("ci") + F.col("di")).withColumn("j", F.col("cj") + F.col("dj"))
    rr = (((F.col("j") + 0.5) * res - F.col("x")) ** 2 + ((F.col("i") + 0.5) * res - F.col("y")) ** 2) / F.col("r") ** 2
    half = (F.col("h") - F.col("base")) / 2
    rise = half * F.sqrt(1 - F.col("rr"))
    return t.withColumn("rr", rr).filter("rr <= 1").groupBy("i", "j").agg(F.max(F.col("base") + half + rise).alias("top"), F.min(F.col("base") + half - rise).alias("bottom"))


#: Ground classes.
PAVED, ASPHALT, FOOTPATH, GRASS, WATER, SPORT, BUILDING = 0, 1, 2, 3, 4, 5, 9


def paint_cover(area: Column, last_road: Column, survey_path: Column, survey_asphalt: Column, survey_sport: Column, survey_water: Column, survey_grass: Column, building: Column) -> Column:
    """Class of a cell from all layers over it, in closed form of painting them one over the other."""
    ground = F.coalesce(last_road, area, F.lit(PAVED))
    hard = F.when(ground.isin(PAVED, ASPHALT, FOOTPATH), F.coalesce(F.when(survey_asphalt, ASPHALT), F.when(survey_path, FOOTPATH), ground)).otherwise(ground)
    soft = F.coalesce(F.when(survey_grass, GRASS), F.when(survey_water, WATER), F.when(survey_sport, SPORT), hard)
    return F.when(building, BUILDING).otherwise(soft)


def disc_means(cells: DataFrame, points: DataFrame, radius: float, xmin: float, ymax: float, res: float, values: list[str]) -> DataFrame:
    """name, month and the means of the values over the cells (month, i, j, ground, values) on the ground whose centre is within the radius of each point (name, x, y), the edge included."""
    span = lambda a: F.sequence(F.floor((a - radius) / res).cast("long"), F.floor((a + radius) / res).cast("long"))
    near = points.withColumn("i", F.explode(span(F.lit(ymax) - F.col("y")))).withColumn("j", F.explode(span(F.col("x") - xmin)))
    dx, dy = xmin + (F.col("j") + 0.5) * res - F.col("x"), ymax - (F.col("i") + 0.5) * res - F.col("y")
    near = near.filter(dx * dx + dy * dy <= radius * radius).select("name", "i", "j")
    return cells.filter("ground").join(near, ["i", "j"]).groupBy("name", "month").agg(*[F.avg(v).alias(v) for v in values])


def paint_rings(cells: DataFrame) -> DataFrame:
    """i, j, h of cells (i, j, ordinal, kind, h) under building rings, as if painted in order of ordinal.

    Rings of buildings with holes come first: an 'outer' one raises the cell to
    its height, an 'inner' one empties it, whatever stood there. 'simple' ones
    raise it afterwards. So what counts is the last inner ring, and the highest
    of the outer ones after it and of the simple ones. Null heights raise
    nothing; 0 is the ground.
    """
    emptied = F.max(F.when(F.col("kind") == "inner", F.col("ordinal"))).over(Window.partitionBy("i", "j"))
    stands = (F.col("kind") == "simple") | ((F.col("kind") == "outer") & (F.col("emptied").isNull() | (F.col("ordinal") > F.col("emptied"))))
    return cells.withColumn("emptied", emptied).groupBy("i", "j").agg(F.greatest(F.lit(0.0), F.coalesce(F.max(F.when(stands, F.col("h"))), F.lit(0.0))).alias("h"))


def ray_offsets(elevation: float, azimuth: float, res: float, highest: float, most: int = 220) -> list[tuple[int, int, float]]:
    """Cells that a ray towards the sun passes, with its height there; ends above the highest obstacle.

    Offsets are rounded half to even and each counts once; the height is that at the rounded offset.
    """
    tan, seen, out = np.tan(np.radians(elevation)), set(), []
    for k in range(1, most + 1):
        if k * res * tan > highest:
            break
        o = (round(-k * np.cos(np.radians(azimuth))), round(k * np.sin(np.radians(azimuth))))
        if o != (0, 0) and o not in seen:
            seen.add(o)
            out.append((*o, float(np.hypot(*o) * res * tan)))
    return out


def _highest(heights: DataFrame) -> float:
    return heights.agg(F.max("h")).first()[0] or 0.0


def shaded(heights: DataFrame, suns: list[tuple[int, float, float]], res: float) -> DataFrame:
    """i, j, sun: cells of (i, j, h) in the shadow of a higher cell, by sun (number, elevation, azimuth).

    Each cell casts its shadow along the ray, as far as its own height reaches;
    cells and rays meet by metre of height. Null heights cast nothing.
    """
    highest = _highest(heights)
    rays = [(s, a, b, z, int(z)) for s, elevation, azimuth in suns for a, b, z in ray_offsets(elevation, azimuth, res, highest)]
    # At most 220 rows a sun.
    ray = F.broadcast(heights.sparkSession.createDataFrame(rays, "sun long, di long, dj long, z double, metre long"))
    cast = heights.filter(F.col("h") > MARGIN).withColumn("metre", F.explode(F.sequence(F.lit(0).cast("long"), F.floor("h")))).join(ray, "metre").filter(F.col("h") > F.col("z") + MARGIN)
    return cast.select((F.col("i") - F.col("di")).alias("i"), (F.col("j") - F.col("dj")).alias("j"), "sun").distinct()


def march(heights: DataFrame, suns: list[tuple[int, float, float]], res: float, ny: int, nx: int, band: int = 64) -> DataFrame:
    """i, j, lit: number of suns that reach each ground cell, by bands of rows with numpy.

    A band gets its own rows and those that its rays can pass: rows are sent to
    as many bands as their height reaches, and each band is one small dense grid.
    """
    highest = _highest(heights)
    rays = {s: ray_offsets(e, a, res, highest) for s, e, a in suns}
    halo = max((abs(o[0]) for r in rays.values() for o in r), default=0)
    wide = max((abs(o[1]) for r in rays.values() for o in r), default=0)
    low = F.floor((F.col("i") - halo) / band).cast("int")
    high = F.floor((F.col("i") + halo) / band).cast("int")
    dealt = heights.withColumn("band", F.explode(F.sequence(F.greatest(low, F.lit(0)), F.least(high, F.lit((ny - 1) // band)))))

    def one(pdf: pd.DataFrame) -> pd.DataFrame:
        first = int(pdf["band"].iloc[0]) * band
        grid = np.zeros((band + 2 * halo, nx + 2 * wide))
        grid[pdf["i"].to_numpy() - first + halo, pdf["j"].to_numpy() + wide] = pdf["h"].to_numpy()
        own = grid[halo : halo + band, wide : wide + nx]
        lit = np.zeros(own.shape, int)
        for ray in rays.values():
            dark = np.zeros(own.shape, bool)
            for di, dj, z in ray:
                dark |= grid[halo + di : halo + di + band, wide + dj : wide + dj + nx] > z + MARGIN
            lit += ~dark
        i, j = np.nonzero(own == 0)
        keep = i + first < ny
        return pd.DataFrame({"i": i[keep] + first, "j": j[keep], "lit": lit[i[keep], j[keep]]})

    return dealt.groupBy("band").applyInPandas(one, "i long, j long, lit long")
