"""Greedy placement of shading objects: each step takes the cell with most benefit."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


class _Grid:
    """Cells (i, j, weight, sun) in row order; what is not there weighs nothing."""

    def __init__(self, cells: pd.DataFrame, kernel: list[tuple[int, int, float]]):
        self.di, self.dj, self.shade = (np.array(c) for c in zip(*kernel))
        self.reach = _reach(kernel)
        cells = cells.sort_values(["i", "j"])
        self.i, self.j = cells["i"].to_numpy(), cells["j"].to_numpy()
        self.left, self.width = self.j.min() - 2 * self.reach, np.ptp(self.j) + 4 * self.reach + 1
        self.code = self.i * self.width + self.j - self.left
        self.weight, self.sun = (np.append(cells[c].to_numpy(float), 0.0) for c in ("weight", "sun"))

    def near(self, at: np.ndarray) -> np.ndarray:
        """Positions of the cells under the kernel at cells, a row each; the last position where there is none."""
        code = (self.i[at, None] + self.di) * self.width + self.j[at, None] + self.dj - self.left
        found = np.minimum(np.searchsorted(self.code, code), len(self.code) - 1)
        return np.where(self.code[found] == code, found, len(self.code))

    def gains(self, at: np.ndarray) -> np.ndarray:
        """What an object takes on each of some cells."""
        step = max(1, (1 << 20) // len(self.shade))
        parts = [self.near(at[k : k + step]) for k in range(0, len(at), step)]
        return np.concatenate([(self.shade * self.weight[p] * self.sun[p]).sum(axis=1) for p in parts]) if parts else np.zeros(0)

    def shadow(self, at: int) -> None:
        """Takes the sun under an object on a cell."""
        under = self.near(np.array([at]))[0]
        self.sun[under] *= 1 - self.shade
        self.sun[-1] = 0.0


def _reach(kernel: list[tuple[int, int, float]]) -> int:
    return max(max(abs(a), abs(b)) for a, b, _ in kernel)


def greedy(cells: DataFrame, kernel: list[tuple[int, int, float]], spacing: float, most: int, stop_share: float = 0.05, seeds: tuple[tuple[float, float, float, int], ...] = (), tile: int = 64) -> DataFrame:
    """kind, step, i, j, gain: objects placed on the cells (kind, i, j, weight, sun) of each kind.

    A step takes the candidate whose kernel removes most weighed sun (the first
    in row order on a tie), removes it, and blocks what is nearer than the
    spacing; it ends when the gain falls under a share of the first. Kinds run
    in parallel, each a grid of its own; steps depend on each other. Each seed
    (i, j, radius in cells, number) is served first, with cells within its radius
    only and without that end; the rest of the budget then goes anywhere.

    Weights and suns are not negative, parts of the kernel between 0 and 1, and a
    kind has a cell once; a null weight or sun counts as 0. Gains then only
    fall, and an object changes those of nine tiles at most. So the `9 * most`
    tiles with the best cells hold every choice: while fewer objects stand, the
    best cell of one of them is untouched and no cell elsewhere is better. Tiles
    are scored in parallel; only these and those that seeds touch go to the task
    that takes the steps of a kind, however large the grid is.
    """
    reach = _reach(kernel)
    side = max(tile, 2 * reach, math.ceil(spacing))

    def tiles(axis: str) -> Column:
        return F.explode(F.sequence(F.floor((F.col(axis) - reach) / side), F.floor((F.col(axis) + reach) / side)))

    there = cells.select("kind", F.col("i").cast("long").alias("i"), F.col("j").cast("long").alias("j"), *[F.coalesce(F.col(c).cast("double"), F.lit(0.0)).alias(c) for c in ("weight", "sun")])
    dealt = there.withColumn("ti", tiles("i")).withColumn("tj", tiles("j"))

    def own(pdf: pd.DataFrame) -> np.ndarray:
        return ((pdf["i"] // side == pdf["ti"]) & (pdf["j"] // side == pdf["tj"])).to_numpy()

    def best(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["i", "j"])
        grid, at = _Grid(pdf, kernel), np.flatnonzero(own(pdf))
        first = pdf.iloc[at[:1]][["kind", "ti", "tj"]]
        if not len(at):
            return first.assign(best=0.0, i=0, j=0)
        gains = grid.gains(at)
        k = gains.argmax()
        return first.assign(best=gains[k], i=grid.i[at[k]], j=grid.j[at[k]])

    def place(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.assign(own=own(pdf)).sort_values(["i", "j", "own"]).drop_duplicates(["i", "j"], keep="last")
        grid, free = _Grid(pdf, kernel), pdf["own"].to_numpy()
        benefit = np.where(free, 0.0, -np.inf)
        benefit[free] = grid.gains(np.flatnonzero(free))
        out = []
        for ci, cj, radius, count in [*seeds, (0, 0, None, most)]:
            first, allowed = None, True if radius is None else (grid.i - ci) ** 2 + (grid.j - cj) ** 2 <= radius * radius
            until = most if radius is None else min(most, len(out) + count)
            while len(out) < until:
                fit = free & allowed
                at = int(np.where(fit, benefit, -np.inf).argmax())
                gain = float(benefit[at])
                if not fit[at] or gain <= 0 or radius is None and first is not None and gain < stop_share * first:
                    break
                first = gain if first is None else first
                out.append((len(out), grid.i[at], grid.j[at], gain))
                grid.shadow(at)
                di, dj = grid.i - grid.i[at], grid.j - grid.j[at]
                free = free & (di**2 + dj**2 >= spacing * spacing)
                seen = np.flatnonzero(free & (np.abs(di) <= 2 * reach) & (np.abs(dj) <= 2 * reach))
                benefit[seen] = grid.gains(seen)
        placed = pd.DataFrame(out, columns=["step", "i", "j", "gain"])
        placed.insert(0, "kind", [pdf["kind"].iloc[0]] * len(out))
        return placed

    spots = dealt.groupBy("kind", "ti", "tj").applyInPandas(best, "kind string, ti long, tj long, best double, i long, j long")
    seeded = F.lit(False)
    for ci, cj, radius, _ in seeds:
        seeded |= F.col("ti").between(math.floor((ci - radius) / side), math.floor((ci + radius) / side)) & F.col("tj").between(math.floor((cj - radius) / side), math.floor((cj + radius) / side))
    # First within parts of a kind, so that no task ranks all its tiles.
    for part in ([F.pmod(F.hash("ti", "tj"), F.lit(256))], []):
        rank = F.row_number().over(Window.partitionBy("kind", *part).orderBy(F.desc("best"), "i", "j"))
        spots = spots.withColumn("rank", rank).filter((F.col("rank") <= 9 * most) | seeded)
    chosen = spots.select(F.col("kind").alias("k"), F.col("ti").alias("a"), F.col("tj").alias("b"))
    kept = dealt.join(chosen, F.col("kind").eqNullSafe(F.col("k")) & (F.col("ti") == F.col("a")) & (F.col("tj") == F.col("b")), "left_semi")
    return kept.groupBy("kind").applyInPandas(place, "kind string, step long, i long, j long, gain double")


def sacrifice(seeded: DataFrame, free: DataFrame) -> DataFrame:
    """kind, placed, benefit, benefit_free, sacrifice (percent) of a placement with seeds against the one without."""
    a = seeded.groupBy("kind").agg(F.count("*").alias("placed"), F.sum("gain").alias("benefit"))
    b = free.groupBy("kind").agg(F.sum("gain").alias("benefit_free"))
    return a.join(b, "kind").withColumn("sacrifice", 100 * (1 - F.try_divide("benefit", "benefit_free")))
