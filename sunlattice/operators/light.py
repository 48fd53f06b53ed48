"""Direct light on a grid through roofs, crowns and sheets, over the sun positions of a year.

Cells that stand in the way cast their shadow within tiles of the grid. Grids
carry their own keys (a scenario, say) along.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Share of light through a leafed and a bare crown; months without leaves; least height over a ray that counts.
LEAFED, BARE = 0.15, 0.55
BARE_MONTHS = (11, 12, 1, 2, 3)
MARGIN = 0.01

#: Share of the sun's energy that a ground class takes up; others take none.
ABSORBED = {0: 0.75, 1: 0.92, 2: 0.70, 3: 0.35, 4: 0.20, 5: 0.80}
#: Air and its warming by what the ground takes up (kWh a day), hours of sun under which a place is shaded.
AIR, WARMING, SHADED_UNDER = 26.0, 4.3, 4.0

SEASONS = {"djf": (12, 1, 2), "mam": (3, 4, 5), "jja": (6, 7, 8), "son": (9, 10, 11)}


LAYERS = ("roof", "green_top", "green_bottom", "leaf_top", "leaf_bottom", "sheet", "light")
#: Fixed value: steps of a ray at most.
MOST = 220


class Sun:
    """A sun position with the offsets of its ray, by rising height."""

    def __init__(self, month: int, elev: float, az: float, w: float, lunch: bool, res: float):
        self.month, self.w, self.lunch = month, w, lunch
        self.tan, self.cos, self.sin, self.res = np.tan(np.radians(elev)), np.cos(np.radians(az)), np.sin(np.radians(az)), res
        k = np.arange(1, MOST + 1)
        # Offsets are rounded half to even; each counts once, with the height at the rounded offset and the step that meets it first.
        both = np.stack([np.rint(-k * self.cos), np.rint(k * self.sin)], axis=1).astype(np.int64)
        _, first = np.unique(both, axis=0, return_index=True)
        z = np.hypot(*both[first].T) * res * self.tan
        order = np.argsort(z, kind="stable")
        self.di, self.dj, self.z, self.step = *both[first][order].T, z[order], (k[first] * res * self.tan)[order]

    def crossing(self, height):
        """The offset at which a sheet of a height is met."""
        steps = height / (self.res * self.tan)
        return np.rint(-steps * self.cos).astype(np.int64), np.rint(steps * self.sin).astype(np.int64)


def _reach(suns: list[Sun], metres: int = 512) -> list[tuple[int, ...]]:
    """For things up to a height, by whole metres: least and largest row and column offsets of what shades from there. The last holds for all above."""
    m = np.arange(metres + 1)
    low, high = np.zeros((2, metres + 1), np.int64), np.zeros((2, metres + 1), np.int64)
    for s in suns:
        n = np.where(m == metres, len(s.z), np.searchsorted(s.z, m + 1.0))
        for axis, (offsets, crossing) in enumerate(zip((s.di, s.dj), s.crossing(m + 1.0))):
            for ends, f in ((low[axis], np.minimum), (high[axis], np.maximum)):
                so_far = np.concatenate([[0], f.accumulate(offsets)])
                ends[:] = f(f(ends, so_far[n]), crossing)
    return [tuple(r) for r in np.stack([m, low[0], high[0], low[1], high[1]], axis=1).tolist()]


def _cast(flags: np.ndarray, sun: Sun, highest: float, i: np.ndarray, j: np.ndarray, top: np.ndarray, bottom: np.ndarray | None) -> None:
    """Set flags (a tile) where things (i, j in the tile's cells, by falling top) stand between a cell and the sun."""
    passed = sun.step <= highest
    z = sun.z[passed]
    # As many things as are high enough, for each offset.
    some = np.searchsorted(-top, -(z + MARGIN))
    total = int(some.sum())
    if not total:
        return
    at = np.arange(total) - np.repeat(np.cumsum(some) - some, some)
    a, b = i[at] - np.repeat(sun.di[passed], some), j[at] - np.repeat(sun.dj[passed], some)
    keep = (a >= 0) & (a < flags.shape[0]) & (b >= 0) & (b < flags.shape[1])
    if bottom is not None:
        keep &= bottom[at] < np.repeat(z, some)
    flags[a[keep], b[keep]] = True


def month_cube(cells: DataFrame, suns: DataFrame, res: float, by: tuple[str, ...] = (), step: int = 15, window: tuple[int, int, int, int] | None = None, tile: int = 64) -> DataFrame:
    """by, month, i, j, hours, insol, midday of the cells (receptors) without a roof: sun a day, kWh a day, minutes of the lunch window.

    cells: by, i, j, roof (height), green_top, green_bottom, leaf_top, leaf_bottom,
    sheet (its height), light (its share through); null or 0 where there is none.
    suns: month, minute, elev, az, w (irradiance), lunch: a year's steps, as many
    rows as those. `window` (first and last row and column) holds the receptors to
    a part of the grid; what stands outside it still shades it. A cell counts as lit
    with half of the light. A sheet is thin: it shades the one cell that the ray
    through it meets, and of several the lightest counts.

    Square tiles of `tile` cells: each thing goes to the tiles that its own shadow
    can reach, by its height and the directions of the suns, so low things move
    to their own tile and few others. In a tile things cast their shadows along the
    rays; rays end where they are above the highest thing of all cells (by `by`).
    Offsets are rounded from each receptor, so rays are no lines that cells share,
    and crowns have undersides: there is no common horizon to sweep, and each sun
    is cast by itself.

    Rows without a place play no part. A place with several rows is shaded by all of
    its things and is a receptor as often as it has rows without a roof. No suns or no
    cells give no rows.
    """
    listed = [Sun(r.month, r.elev, r.az, r.w, bool(r.lunch), res) for r in suns.select("month", "elev", "az", "w", "lunch").orderBy("month", "minute").collect()]
    months = sorted({s.month for s in listed})
    spark = cells.sparkSession
    value = lambda c: F.coalesce(F.col(c).cast("double"), F.lit(0.0))
    grid = cells.filter("i is not null and j is not null").select(*by, F.col("i").cast("long").alias("i"), F.col("j").cast("long").alias("j"), *[value(c).alias(c) for c in LAYERS])
    grid = grid.withColumn("top", F.greatest("roof", "green_top", "leaf_top"))
    inside = F.lit(True) if window is None else F.col("i").between(*window[:2]) & F.col("j").between(*window[2:])
    own = lambda c: F.floor(F.col(c) / tile)
    ground = grid.filter(inside & (F.col("roof") <= 0)).withColumns({"ti": own("i"), "tj": own("j"), "mine": F.lit(True)})
    # A row a metre of height.
    table = _reach(listed)
    reach = spark.createDataFrame(table, "metre long, i0 long, i1 long, j0 long, j1 long")
    things = grid.filter((F.col("top") > MARGIN) | (F.col("sheet") > 0))
    highest = things.groupBy(*by).agg(F.max("top").alias("highest"))
    metre = F.least(F.floor(F.greatest("top", "sheet")), F.lit(len(table) - 1)).alias("metre")
    span = lambda c: F.sequence(F.floor((F.col(c) - F.col(f"{c}1")) / tile), F.floor((F.col(c) - F.col(f"{c}0")) / tile))
    far = things.withColumn("metre", metre).join(F.broadcast(reach), "metre")
    far = far.withColumn("ti", F.explode(span("i"))).withColumn("tj", F.explode(span("j"))).withColumn("mine", F.lit(False))
    if window is not None:
        far = far.filter(F.col("ti").between(*(x // tile for x in window[:2])) & F.col("tj").between(*(x // tile for x in window[2:])))
    columns = [*by, "ti", "tj", "mine", "i", "j", *LAYERS, "top"]
    both = ground.select(*columns).unionByName(far.select(*columns))
    # A row a scenario.
    highest = highest.select(*[F.col(c).alias(f"of_{c}") for c in by], "highest")
    same_key = F.lit(True)
    for c in by:
        same_key &= F.col(c).eqNullSafe(F.col(f"of_{c}"))
    both = both.join(F.broadcast(highest), same_key, "left").drop(*(f"of_{c}" for c in by))
    kinds = {f.name: f.dataType for f in cells.schema.fields}
    schema = ", ".join([*(f"`{c}` {kinds[c].simpleString()}" for c in by), "month int, i long, j long, hours double, insol double, midday double"])
    names = [*by, "month", "i", "j", "hours", "insol", "midday"]

    def one(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        mine = pdf[pdf["mine"]]
        if mine.empty or not months:
            return pd.DataFrame({c: pd.Series([], dtype=object if c in by else float) for c in names})
        i0, j0 = int(key[-2]) * tile, int(key[-1]) * tile
        rest, most = pdf[~pdf["mine"]], float(np.nan_to_num(pdf["highest"].iloc[0]))
        casts = []
        for top, bottom in (("roof", None), ("green_top", "green_bottom"), ("leaf_top", "leaf_bottom")):
            found = rest[rest[top] > MARGIN].sort_values(top, ascending=False)
            casts.append((found["i"].to_numpy() - i0, found["j"].to_numpy() - j0, found[top].to_numpy(), None if bottom is None else found[bottom].to_numpy()))
        sheets = rest[rest["sheet"] > 0]
        si, sj, sh, sl = sheets["i"].to_numpy() - i0, sheets["j"].to_numpy() - j0, sheets["sheet"].to_numpy(), sheets["light"].to_numpy()
        sums = {m: np.zeros((3, tile, tile)) for m in months}
        roof, green, leaf = (np.zeros((tile, tile), bool) for _ in range(3))
        for sun in listed:
            for flags, cast in zip((roof, green, leaf), casts):
                flags[:] = False
                if len(cast[0]):
                    _cast(flags, sun, most, *cast)
            left = np.where(green, LEAFED, 1.0) * np.where(leaf, BARE if sun.month in BARE_MONTHS else LEAFED, 1.0)
            if len(sh):
                di, dj = sun.crossing(sh)
                a, b = si - di, sj - dj
                keep = (a >= 0) & (a < tile) & (b >= 0) & (b < tile)
                through = np.full((tile, tile), -1.0)
                np.maximum.at(through, (a[keep], b[keep]), sl[keep])
                left *= np.where(through >= 0, through, 1.0)
            left[roof] = 0.0
            lit, total = left >= 0.5, sums[sun.month]
            total[0] += lit * (step / 60.0)
            total[1] += left * (sun.w * step / 60.0 / 1000)
            if sun.lunch:
                total[2] += lit * float(step)
        i, j = mine["i"].to_numpy(), mine["j"].to_numpy()
        same = {c: pd.Series([None if pd.isna(k) else k] * len(i), dtype=object) for c, k in zip(by, key)}
        parts = [pd.DataFrame({**same, "month": np.int32(m), "i": i, "j": j, **dict(zip(names[-3:], sums[m][:, i - i0, j - j0]))}) for m in months]
        return pd.concat(parts)[names]

    # Few bytes make much work here: by a number, as partitions are not joined by their size then.
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    return both.repartition(parts, *by, "ti", "tj").groupBy(*by, "ti", "tj").applyInPandas(one, schema)


def seasons(cube: DataFrame, by: tuple[str, ...] = (), values: tuple[str, ...] = ("hours", "insol", "midday")) -> DataFrame:
    """by, i, j and for each value its mean over the year and over each season: <value>_annual, <value>_djf and so on."""
    each = [F.avg(v).alias(f"{v}_annual") for v in values]
    each += [F.avg(F.when(F.col("month").isin(*m), F.col(v))).alias(f"{v}_{k}") for v in values for k, m in SEASONS.items()]
    return cube.groupBy(*by, "i", "j").agg(*each)


def absorption(cover: Column) -> Column:
    """Share of the energy that a ground class takes up."""
    return F.coalesce(F.try_element_at(F.create_map(*[F.lit(x) for kv in ABSORBED.items() for x in kv]), cover.cast("int")), F.lit(0.0))


def surface_temperature(absorbed: Column) -> Column:
    return AIR + WARMING * absorbed


def heat(summer: DataFrame, res: float, spread: float = 10.0, by: tuple[str, ...] = ()) -> DataFrame:
    """by, i, j, absorbed: energy taken up (insol_jja by the cell's cover), mixed over the ground around with a Gaussian of `spread` metres.

    Two passes along the axes; a cell without ground counts for nothing.
    """
    reach = max(1, int(3 * spread / res))
    w = [float(np.exp(-(k * res) ** 2 / (2 * spread * spread))) for k in range(-reach, reach + 1)]
    o = F.explode(F.array(*[F.struct(F.lit(k - reach).alias("d"), F.lit(x).alias("w")) for k, x in enumerate(w)]))
    mixed = summer.select(*by, "i", "j", (F.col("insol_jja") * absorption(F.col("cover"))).alias("v"), F.lit(1.0).alias("n"))
    for axis in "ij":
        moved = mixed.withColumn("o", o).withColumn(axis, F.col(axis) + F.col("o.d"))
        mixed = moved.groupBy(*by, "i", "j").agg(F.sum(F.col("v") * F.col("o.w")).alias("v"), F.sum(F.col("n") * F.col("o.w")).alias("n"))
    return summer.select(*by, "i", "j").join(mixed, [*by, "i", "j"]).select(*by, "i", "j", (F.col("v") / F.greatest("n", F.lit(1e-9))).alias("absorbed"))


def zone_stats(cells: DataFrame, zone: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """by and zone, with n cells, mean hours and lunch minutes of summer, temperature and share (percent) in shade.

    cells: by, i, j, hours_jja, midday_jja, absorbed on the ground; zone: zone, i, j
    (footprints or areas that may overlap). Cells of a zone off the ground are left out.
    """
    rows = cells.join(zone, ["i", "j"])
    return rows.groupBy(*by, "zone").agg(
        F.count("*").alias("n"),
        F.avg("hours_jja").alias("hours"),
        F.avg("midday_jja").alias("lunch"),
        surface_temperature(F.avg("absorbed")).alias("temperature"),
        (100 * F.avg((F.col("hours_jja") < SHADED_UNDER).cast("int"))).alias("shade"),
    )
