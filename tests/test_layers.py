"""Spans of rings, heights and ground classes against plain painting."""

import random

import numpy as np
import pytest

from sunlattice.operators import layers

RES, NY, NX, XMIN, YMAX = 1.5, 30, 34, -3.0, 45.0
GRID = (XMIN, YMAX, RES, NY, NX)


def inside(ring):
    """Cells whose centre has an odd number of edges to its right."""
    out = np.zeros((NY, NX), bool)
    for i in range(NY):
        for j in range(NX):
            x, y = XMIN + (j + 0.5) * RES, YMAX - (i + 0.5) * RES
            odd = False
            for (ax, ay), (bx, by) in zip(ring, [*ring[1:], *ring[:1]]):
                odd ^= (ay > y) != (by > y) and x < ax + (bx - ax) * ((y - ay) / (by - ay))
            out[i, j] = odd
    return out


def some_ring(rng):
    """Any corners, crossing themselves, beyond the grid or on the centres of cells."""
    if rng.random() < 0.5:
        return [(XMIN + (rng.randrange(-3, NX + 3) + 0.5) * RES, YMAX - (rng.randrange(-3, NY + 3) + 0.5) * RES) for _ in range(rng.randrange(3, 8))]
    return [(rng.uniform(-12, 60), rng.uniform(-12, 60)) for _ in range(rng.randrange(3, 8))]


def points(ring):
    return [{"x": x, "y": y} for x, y in ring]


RING = "array<struct<x: double, y: double>>"


def test_spans_are_the_cells_inside(spark):
    rng = random.Random(1)
    rings = [some_ring(rng) for _ in range(60)]
    odd = [[], [(1.0, 2.0), (9.0, 9.0)], [(1.0, 1.0)] * 4, [(1.0, 1.0), (None, 3.0), (9.0, 1.0)]]
    rows = [(k, "a", points(r)) for k, r in enumerate([*rings, *odd])] + [(99, None, None), (100, "a", points(rings[0]))]
    df = spark.createDataFrame(rows, f"id long, tag string, ring {RING}")
    got = {}
    for r in layers.ring_spans(df, *GRID).collect():
        assert 0 <= r.first <= r.last < NX
        got.setdefault(r.id, set()).update((r.i, j) for j in range(r.first, r.last + 1))
    for k, ring in enumerate(rings):
        assert got.get(k, set()) == {(int(i), int(j)) for i, j in zip(*np.nonzero(inside(ring)))}, k
    assert not set(got) - set(range(60)) - {100} and got.get(100) == got.get(0)
    assert layers.ring_cells(df.limit(0), *GRID).count() == 0


@pytest.mark.parametrize("seed", range(3))
def test_buildings_are_painted_in_order(spark, seed):
    rng = random.Random(seed)
    roles = [["outer"], ["outer", "inner"], ["inner"], ["outer", "outer", "inner"], ["inner", "outer"]]
    buildings = [(k, rng.choice([None, float(rng.randrange(2, 30))]), [{"role": r, "ring": points(some_ring(rng))} for r in rng.choice(roles)]) for k in range(12)]
    volumes = [(k, float(rng.randrange(2, 30)), points(some_ring(rng))) for k in range(3)]
    grid = np.zeros((NY, NX))
    plain = lambda ps: inside([(p["x"], p["y"]) for p in ps])
    several = [b for b in buildings if len(b[2]) > 1 or b[2][0]["role"] == "inner"]
    for _, h, rings in several:
        for r in rings:
            m = plain(r["ring"])
            grid[m] = np.maximum(grid[m], h or 0) if r["role"] == "outer" else 0
    for h, ring in [(b[1], b[2][0]["ring"]) for b in buildings if b not in several] + [v[1:] for v in volumes]:
        m = plain(ring)
        grid[m] = np.maximum(grid[m], h or 0)
    b = spark.createDataFrame(buildings, f"ordinal long, height double, rings array<struct<role: string, ring: {RING}>>")
    v = spark.createDataFrame(volumes, f"id long, height double, ring {RING}")
    plants = spark.createDataFrame([(10.0, 20.0, 8.0, 6.0, None), (30.0, 30.0, 12.0, 4.0, True), (None, 1.0, 2.0, 3.0, True), (1.0, 1.0, None, 3.0, False), (900.0, 900.0, 9.0, 9.0, False)], "x double, y double, h double, crown double, evergreen boolean")
    found = layers.heights(b, v, plants, *GRID).collect()
    assert {(r.i, r.j): r.roof for r in found if r.roof} == {(int(i), int(j)): grid[i, j] for i, j in zip(*np.nonzero(grid))}
    for kind, (x, y, h, crown) in (("leaf", (10.0, 20.0, 8.0, 6.0)), ("green", (30.0, 30.0, 12.0, 4.0))):
        base = max(2.0, 0.35 * h)
        want = {}
        for i in range(NY):
            for j in range(NX):
                rr = ((XMIN + (j + 0.5) * RES - x) ** 2 + (YMAX - (i + 0.5) * RES - y) ** 2) / (crown / 2) ** 2
                if rr <= 1:
                    want[i, j] = (pytest.approx((base + h) / 2 + (h - base) / 2 * (1 - rr) ** 0.5), pytest.approx((base + h) / 2 - (h - base) / 2 * (1 - rr) ** 0.5))
        assert {(r.i, r.j): (r[f"{kind}_top"], r[f"{kind}_bottom"]) for r in found if r[f"{kind}_top"] is not None} == want and want


@pytest.mark.parametrize("seed", range(3))
def test_ground_is_painted_in_order(spark, seed):
    rng = random.Random(seed + 10)
    tags = [({"landuse": "meadow"}, "grass"), ({"leisure": "pitch"}, "sport"), ({"amenity": "parking"}, "asphalt"), ({"natural": "water"}, "water"), ({"shop": "yes"}, None)]
    mapped = [(k, *rng.choice(tags), some_ring(rng)) for k in range(6)]
    survey = [(k, rng.choice(["footpath", "asphalt", "sport", "water", "grass", "sand", None]), some_ring(rng)) for k in range(6)]
    kinds = [("primary", 12.0, 1), ("steps", 2.0, 2), ("footway", 2.5, 2), ("cycleway", 2.5, 1), ("proposed", None, None)]
    roads = []
    for k in rng.sample(range(100), 8):
        way = rng.choice(kinds)
        line = [(rng.uniform(-5, 50), rng.uniform(-2, 48)) for _ in range(3)]
        if rng.random() < 0.3:
            line = [line[0]] * 3
        roads += [(k, way, a, b) for a, b in zip(line, line[1:])]
    roof = inside(some_ring(rng))
    classes = {"footpath": 2, "asphalt": 1, "sport": 5, "water": 4, "grass": 3}
    grid = np.zeros((NY, NX), int)
    painted = roof.copy()
    for name in ("grass", "sport", "asphalt", "water"):
        for _, _, own, ring in mapped:
            if own == name:
                grid[inside(ring)] = classes[name]
                painted |= inside(ring)
    y, x = np.meshgrid(YMAX - (np.arange(NY) + 0.5) * RES, XMIN + (np.arange(NX) + 0.5) * RES, indexing="ij")
    for _, (_, width, own), (ax, ay), (bx, by) in sorted(roads, key=lambda r: r[0]):
        if width is None:
            continue
        length = float(np.hypot(bx - ax, by - ay))
        for s in np.arange(0, length + RES / 2, RES):
            f = min(s / length, 1.0) if length else 0
            disc = (x - ax - f * (bx - ax)) ** 2 + (y - ay - f * (by - ay)) ** 2 <= (width / 2) ** 2
            grid[disc] = own
            painted |= disc
    for name in ("footpath", "asphalt", "sport", "water", "grass"):
        for _, own, ring in survey:
            if own == name:
                m = inside(ring)
                painted |= m
                grid[m & np.isin(grid, [0, 1, 2]) if name in ("footpath", "asphalt") else m] = classes[name]
    grid[roof] = 9
    m = spark.createDataFrame([(k, t, points(r)) for k, t, _, r in mapped], f"id long, tags map<string, string>, ring {RING}")
    s = spark.createDataFrame([(k, c, points(r)) for k, c, r in survey], f"id long, class string, ring {RING}")
    w = spark.createDataFrame([(k, way[0], *a, *b) for k, way, a, b in roads], "ordinal long, kind string, ax double, ay double, bx double, by double")
    roofs = spark.createDataFrame([(int(i), int(j)) for i, j in zip(*np.nonzero(roof))], "i long, j long")
    got = {(r.i, r.j): r.cover for r in layers.covers(m, w, s, roofs, *GRID).collect()}
    assert got == {(int(i), int(j)): int(grid[i, j]) for i, j in zip(*np.nonzero(painted))}
