"""Tiled convolution and rows of plants against plain loops."""

import random

import numpy as np
import pytest

from sunlattice.operators import kernels

GRID = "site string, i long, j long, v double"


@pytest.mark.parametrize(("shape", "tile"), [((5, 4), 8), ((1, 1), 4), ((9, 15), 6), ((2, 7), 64)])
def test_convolution_of_equal_size(spark, shape, tile):
    rng = np.random.default_rng(shape[0])
    ny, nx, kernel = 19, 23, rng.normal(size=shape)
    kernel[0, 0] = 0.0
    want, rows = {}, []
    for site in ("a", None):
        a = np.where(rng.random((ny, nx)) < 0.15, rng.normal(size=(ny, nx)), 0)
        rows += [(site, int(i), int(j), float(a[i, j])) for i, j in zip(*np.nonzero(a))]
        for i in range(ny):
            for j in range(nx):
                near = [(a[i - p + shape[0] // 2, j - q + shape[1] // 2], kernel[p, q]) for p in range(shape[0]) for q in range(shape[1]) if 0 <= i - p + shape[0] // 2 < ny and 0 <= j - q + shape[1] // 2 < nx]
                if any(x and k for x, k in near):
                    want[site, i, j] = pytest.approx(sum(x * k for x, k in near), abs=1e-9)
    rows += [("a", -1, 0, 9.0), ("a", 0, nx, 9.0), ("a", None, 1, 9.0), ("a", 1, 1, None)]
    df = spark.createDataFrame(rows, GRID)
    got = {(r.site, r.i, r.j): r.v for r in kernels.convolve_same(df, kernel, ny, nx, ("site",), tile).collect()}
    assert got == want
    assert kernels.convolve_same(df.limit(0), kernel, ny, nx, ("site",), tile).count() == 0


def test_rows_of_plants_keep_their_distance(spark):
    rng = random.Random(3)
    rows = []
    for f in range(12):
        for i in range(rng.randrange(1, 40)):
            rows += [(f, i, j, rng.choice([True, True, False, None]), rng.choice("x") if f % 2 else [None, "y"][f % 4 // 2]) for j in range(rng.randrange(1, 40)) if rng.random() < 0.8]
    want = []
    for f in range(12):
        own = {(i, j): bool(ok) for g, i, j, ok, _ in rows if g == f}
        along = f % 2 == 1
        lines = sorted({k[1] if along else k[0] for k in own})
        kept = []
        for line in lines[::3]:
            across = sorted(k[0] if along else k[1] for k in own if k[1 if along else 0] == line)
            for at in (across[0], across[-1]):
                i, j = (at, line) if along else (line, at)
                x, y = (j + 0.5) * 1.5, 90 - (i + 0.5) * 1.5
                if own[i, j] and all((x - a) ** 2 + (y - b) ** 2 >= 16 for a, b, *_ in kept):
                    kept.append((x, y, i, j))
        want += [(f, n, i, j) for n, (_, _, i, j) in enumerate(kept, 1)]
    df = spark.createDataFrame([*rows, (3, None, 1, True, "x")], "id long, i long, j long, plantable boolean, axis string")
    assert sorted(tuple(r) for r in kernels.edge_rows(df, 0.0, 90.0, 1.5).collect()) == want and len(want) > 60
    assert kernels.edge_rows(df.limit(0), 0.0, 90.0, 1.5).count() == 0


def test_objects_with_nulls_have_no_kernel(spark):
    objects = spark.createDataFrame([(1, 3.0, 1.5, 0.5, False), (2, None, 1.5, 0.5, True), (3, 3.0, 1.5, 0.5, True)], "id long, height double, radius double, opacity double, square boolean")
    suns = spark.createDataFrame([(45.0, 180.0, 30.0), (10.0, 100.0, 10.0)], "elev double, az double, w double")
    got = {}
    for r in kernels.sun_kernels(objects, suns, 1.5).collect():
        got.setdefault(r.id, {})[r.di, r.dj] = r.share
    # Two cells to the north; the low sun counts in the whole only.
    assert got == {1: {(-2 + a, b): pytest.approx(0.375) for a, b in ((0, 0), (1, 0), (-1, 0), (0, 1), (0, -1))}, 3: {(-2 + a, b): pytest.approx(0.375) for a in (-1, 0, 1) for b in (-1, 0, 1)}}
    assert kernels.sun_kernels(objects, suns.limit(0), 1.5).count() == 0
