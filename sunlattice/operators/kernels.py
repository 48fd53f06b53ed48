"""Kernels over grids: convolution by tiles, what an object shades in summer, and rows of plants along footprints."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Suns lower than this cast too far to count, and shadows beyond this many metres are left out.
LOWEST, FARTHEST = 12.0, 36.0
#: Fixed value: share of the spacing that plants keep between them.
APART = 0.8


def convolve_same(cells: DataFrame, kernel: np.ndarray, ny: int, nx: int, by: tuple[str, ...] = (), tile: int = 128) -> DataFrame:
    """by, i, j, v of the grid's cells within the kernel's reach of any of cells (by, i, j, v): a true convolution of equal size.

    Beyond the grid there are zeros; the kernel's middle is at half its size,
    rounded down. Tiles go through Fourier transforms and their results are added
    where they overlap, so a tile needs no cells of others and rows moved follow the
    cells, however large the kernel. Values of one cell are added up; cells without
    a place or value, or beyond the grid, count for nothing. Empty grids give no rows.
    """
    kh, kw = kernel.shape
    shape = (tile + kh - 1, tile + kw - 1)
    spectrum, reach = np.fft.rfft2(kernel, shape), np.fft.rfft2((kernel != 0).astype(float), shape)
    names = [*by, "i", "j", "v"]
    kinds = {f.name: f.dataType.simpleString() for f in cells.schema.fields}
    known = cells.filter("i is not null and j is not null and v is not null").filter(F.col("i").between(0, ny - 1) & F.col("j").between(0, nx - 1))
    known = known.select(*by, F.col("i").cast("long").alias("i"), F.col("j").cast("long").alias("j"), F.col("v").cast("double").alias("v"))

    def one(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        i0, j0 = int(key[-2]) * tile, int(key[-1]) * tile
        values, there = np.zeros((tile, tile)), np.zeros((tile, tile))
        at = (pdf["i"].to_numpy() - i0, pdf["j"].to_numpy() - j0)
        np.add.at(values, at, pdf["v"].to_numpy())
        there[at] = 1.0
        out = np.fft.irfft2(np.fft.rfft2(values, shape) * spectrum, shape)
        i, j = np.nonzero(np.fft.irfft2(np.fft.rfft2(there, shape) * reach, shape) > 0.5)
        place = (i + i0 - kh // 2, j + j0 - kw // 2)
        keep = (place[0] >= 0) & (place[0] < ny) & (place[1] >= 0) & (place[1] < nx)
        same = {c: pd.Series([None if pd.isna(k) else k] * int(keep.sum()), dtype=object) for c, k in zip(by, key)}
        return pd.DataFrame({**same, "i": place[0][keep], "j": place[1][keep], "v": out[i[keep], j[keep]]})[names]

    schema = ", ".join([*(f"`{c}` {kinds[c]}" for c in by), "i long, j long, v double"])
    own = lambda c: F.floor(F.col(c) / tile)
    patches = known.groupBy(*by, own("i").alias("ti"), own("j").alias("tj")).applyInPandas(one, schema)
    return patches.groupBy(*by, "i", "j").agg(F.sum("v").alias("v"))


def sun_kernels(objects: DataFrame, suns: DataFrame, res: float) -> DataFrame:
    """id, di, dj, share: what part of the irradiance of suns an object takes from the cell at an offset.

    objects: id, height (of the middle of what shades), radius, opacity, square (its
    footprint is a square, else a disc). suns: elev, az, w, a few hundred rows of a
    season. The share is weighed by w over all suns that are up; those lower
    than `LOWEST` count in the whole only, and offsets beyond `FARTHEST` are left
    out. Objects with a null in any column have no kernel.
    """
    far = math.ceil(FARTHEST / res)
    # One row: a season's suns.
    listed = suns.agg(F.sum("w").alias("whole"), F.collect_list(F.when(F.col("elev") >= LOWEST, F.struct("elev", "az", "w"))).alias("suns")).withColumn("one", F.lit(1))
    known = objects.na.drop().withColumn("one", F.lit(1)).join(F.broadcast(listed), "one")
    n = F.greatest(F.lit(1), F.bround(F.col("radius") / res).cast("int"))
    away = F.col("height") / F.tan(F.radians("s.elev")) / res
    cast = known.select("id", "opacity", "square", "whole", "height", n.alias("n"), F.explode("suns").alias("s"))
    middle = cast.select("id", "opacity", "square", "whole", "n", "s.w", F.bround(away * F.cos(F.radians("s.az"))).cast("long").alias("ci"), F.bround(-away * F.sin(F.radians("s.az"))).cast("long").alias("cj"))
    # Suns that meet at an offset are added up before the footprint is laid around it.
    summed = middle.groupBy("id", "opacity", "square", "whole", "n", "ci", "cj").agg(F.sum("w").alias("w"))
    spread = summed.withColumn("a", F.explode(F.sequence(-F.col("n"), F.col("n")))).withColumn("b", F.explode(F.sequence(-F.col("n"), F.col("n"))))
    spread = spread.filter(F.col("square") | (F.col("a") * F.col("a") + F.col("b") * F.col("b") <= F.col("n") * F.col("n")))
    di, dj = F.col("ci") + F.col("a"), F.col("cj") + F.col("b")
    cells = spread.select("id", "opacity", "whole", "w", di.alias("di"), dj.alias("dj")).filter(F.col("di").between(-far, far) & F.col("dj").between(-far, far))
    return cells.groupBy("id", "di", "dj").agg(F.try_divide(F.sum(F.col("w") * F.col("opacity")), F.max("whole")).alias("share"))


def edge_rows(cells: DataFrame, xmin: float, ymax: float, res: float, spacing: float = 5.0) -> DataFrame:
    """id, ordinal, i, j of plants in two rows along the long edges of footprints; the middle stays free.

    cells: id, i, j, plantable, axis ('x' if the footprint is longer along its
    columns, else 'y'). Of every so many occupied lines across the long axis the
    first and last cell are taken in order; one that isn't plantable, or nearer than
    `APART` of the spacing to one kept before, is left out. What is scanned in one
    task are these ends of one footprint, two a line. Null axes are 'y', null
    plantable is false; cells without a place or id count for nothing.
    """
    step = max(1, round(spacing / res))
    along = F.col("axis") == "x"
    known = cells.filter("i is not null and j is not null").withColumn("along", F.coalesce(along, F.lit(False)))
    line, across = F.when(F.col("along"), F.col("j")).otherwise(F.col("i")), F.when(F.col("along"), F.col("i")).otherwise(F.col("j"))
    ends = known.groupBy("id", "along", line.alias("line")).agg(*[f(F.struct(across.alias("at"), F.coalesce("plantable", F.lit(False)).alias("ok"))).alias(c) for f, c in ((F.min, "low"), (F.max, "high"))])
    place = F.row_number().over(Window.partitionBy("id", "along").orderBy("line"))
    ends = ends.withColumn("place", place).filter((F.col("place") - 1) % step == 0)
    both = ends.select("id", "along", "line", F.posexplode(F.array("low", "high")).alias("side", "end"))
    rows = both.select("id", (F.col("line") * 2 + F.col("side")).alias("turn"), F.col("end.ok").alias("ok"), *[F.when(F.col("along"), a).otherwise(b).cast("long").alias(c) for c, a, b in (("i", F.col("end.at"), F.col("line")), ("j", F.col("line"), F.col("end.at")))])
    least = (APART * spacing) ** 2

    def scan(batches):
        # Kept places of the footprint at hand by bucket, so each place looks at its neighbours only.
        size, footprint, held, ordinal = APART * spacing, None, {}, 0
        for pdf in batches:
            kept = []
            for row, (name, i, j) in enumerate(zip(pdf["id"], pdf["i"], pdf["j"])):
                if name != footprint:
                    footprint, held, ordinal = name, {}, 0
                x, y = xmin + (j + 0.5) * res, ymax - (i + 0.5) * res
                a, b = int(x // size), int(y // size)
                near = (p for da in (-1, 0, 1) for db in (-1, 0, 1) for p in held.get((a + da, b + db), ()))
                if all((x - px) ** 2 + (y - py) ** 2 >= least for px, py in near):
                    held.setdefault((a, b), []).append((x, y))
                    ordinal += 1
                    kept.append((row, ordinal))
            out = pdf.iloc[[row for row, _ in kept]][["id", "i", "j"]]
            yield out.assign(ordinal=np.array([n for _, n in kept], np.int64))[["id", "ordinal", "i", "j"]]

    # One ordered pass over many footprints, however short each is.
    dealt = rows.filter("ok and id is not null").repartition("id").sortWithinPartitions("id", "turn")
    return dealt.mapInPandas(scan, f"id {dict(cells.dtypes)['id']}, ordinal long, i long, j long")
