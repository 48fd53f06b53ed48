"""Labels, doors, empty demands, and tables written and read back."""

import json
import math
import statistics

import numpy as np
import pytest

from sunlattice.operators import areas, graph, light, spatial
from sunlattice.operators.nearest import nearest
from sunlattice.plans.registry import QUERIES
from sunlattice.session import with_checkpoints
from sunlattice.sources import studies

SF = "/root/testdata/sf0.01"


def test_labels_keep_their_distance(spark):
    c = spark.read.parquet(f"{SF}/customer.parquet").collect()
    rows = {}
    for r in c:
        x, y, w, name = r.c_custkey * 37 % 211 * 3.0, r.c_custkey * 61 % 197 * 3.0, abs(r.c_acctbal) / 10000, f"stop {r.c_custkey % 90}"
        if w >= 0.03:
            rows[name] = min(rows.get(name, (0, 0, 0)), (-w, x, y))
    kept = []
    for (w, x, y), name in sorted((v, k) for k, v in rows.items()):
        if all(math.hypot(x - a, y - b) >= 170 for _, a, b in kept):
            kept.append((name, x, y))
    assert sorted((r.name, r.x, r.y) for r in QUERIES["label_places"](spark, SF).collect()) == sorted(kept)


def test_flows_of_no_trips(spark):
    with_checkpoints(spark)
    paths = spark.createDataFrame([(1, 1, 0.0, None), (1, 2, 1.0, 1)], "source long, node long, dist double, prev long")
    none = spark.createDataFrame([], "source long, node long, w double")
    assert graph.edge_flows(paths, none).count() == 0
    assert graph.edge_flows(paths, spark.createDataFrame([(1, 1, 2.0)], "source long, node long, w double")).count() == 0
    # A door that no path reaches passes its share on; doors at one node count each.
    doors = spark.createDataFrame([(7, 2, 6.0), (7, 2, 6.0), (7, 9, 6.0), (8, 9, 1.0)], "id long, node long, w double")
    trips = graph.door_trips(paths, spark.createDataFrame([(5, 1, 0.5)], "id long, node long, w double"), doors).collect()
    assert [(r.source, r.node, r.w) for r in trips] == [(1, 2, 3.0)]


def test_nearest_of_far_places(spark):
    with_checkpoints(spark)
    points = spark.createDataFrame([(1, 0.0, 0.0), (2, 1000.0, 0.0), (3, 5.0, 5.0)], "id long, x double, y double")
    targets = spark.createDataFrame([(10, 3.0, 4.0), (11, -3.0, -4.0), (12, 400.0, 0.0)], "rid long, rx double, ry double")
    got = {r.id: (r.rid, r.d2) for r in nearest(points, targets).collect()}
    assert got == {1: (10, 25.0), 2: (12, 360000.0), 3: (10, 5.0)}
    assert nearest(points, targets.limit(0)).count() == 0 and nearest(points.limit(0), targets).count() == 0


@pytest.mark.parametrize("small", [{}, {"max_sample": 60, "cell_rows": 20, "chunk": 7}])
def test_nearest_against_all_pairs(spark, small):
    with_checkpoints(spark)
    rng = np.random.default_rng(8)
    places = lambda n: [(k, float(x), float(y)) for k, (x, y) in enumerate(rng.integers(0, 40, (n, 2)) * rng.choice([1, 1, 1, 5000], (n, 1)))]
    points, targets = places(700), places(500)
    points += [(0, 3.0, 3.0), (900, None, 1.0), (901, 1.0, float("nan")), (902, float("inf"), 1.0), (None, 1.0, 1.0), (903, -1e9, 1e9)] + [(k, 7.0, 7.0) for k in range(1000, 1100)]
    targets += [(900 + k, 7.0, 7.5) for k in range(200)] + [(-5, None, 1.0), (-6, float("nan"), 2.0), (None, 7.0, 7.0)]
    want = {}
    for i, x, y in points:
        if i is not None and x is not None and math.isfinite(x) and math.isfinite(y):
            own = min(((x - a) * (x - a) + (y - b) * (y - b), r) for r, a, b in targets if r is not None and a is not None and math.isfinite(a))
            want[i] = min(want.get(i, own), own)
    p = spark.createDataFrame(points, "id long, x double, y double").repartition(4)
    t = spark.createDataFrame(targets, "rid long, rx double, ry double").repartition(4)
    got = nearest(p, t, **small).collect()
    assert len(got) == len(want) and {r.id: (r.d2, r.rid) for r in got} == want


def test_road_widths(spark):
    kinds = spark.createDataFrame([("primary",), ("steps",), ("proposed",), (None,)], "kind string")
    assert [r[0] for r in kinds.select(areas.road_width(kinds.kind)).collect()] == [12.0, 2.0, None, None]


@pytest.mark.parametrize(("cell", "want"), [({}, (1.0, 1.0)), ({"roof": 9.0}, (0.0, 0.0)), ({"green_top": 9.0, "green_bottom": 1.0}, (0.15, 0.15)), ({"leaf_top": 9.0, "leaf_bottom": 1.0}, (0.15, 0.55)), ({"leaf_top": 9.0, "leaf_bottom": 8.0}, (1.0, 1.0)), ({"sheet": 3.0, "light": 0.28}, (0.28, 0.28)), ({"roof": 9.0, "sheet": 3.0, "light": 0.28}, (0.0, 0.0)), ({"roof": 1.5 * 2 * math.tan(math.radians(45)) + 0.005}, (1.0, 1.0))])
def test_what_a_ray_meets(spark, cell, want):
    """A sun in the south at 45 degrees, over one thing two cells south of the receptor."""
    names = ["roof", "green_top", "green_bottom", "leaf_top", "leaf_bottom", "sheet", "light"]
    cells = spark.createDataFrame([(0, 0, *[None] * 7), (2, 0, *[cell.get(n) for n in names])], "i long, j long, " + ", ".join(f"{n} double" for n in names))
    suns = spark.createDataFrame([(m, 720, 45.0, 180.0, 1000.0, True) for m in (1, 7)], "month int, minute int, elev double, az double, w double, lunch boolean")
    got = {(r.month, r.i): r for r in light.month_cube(cells, suns, 1.5).collect()}
    for month, f in zip((7, 1), want):
        r = got[month, 0]
        assert r.insol == pytest.approx(f * 0.25) and r.hours == (0.25 if f >= 0.5 else 0) and r.midday == (15 if f >= 0.5 else 0)
    tiles = {(r.month, r.i): r.insol for r in light.month_cube(cells, suns, 1.5, tile=2).collect()}
    assert all(tiles[k] == pytest.approx(r.insol) for k, r in got.items()) and len(tiles) == len(got)


def test_high_things_odd_places_and_no_suns(spark):
    names = ["roof", "green_top", "green_bottom", "leaf_top", "leaf_bottom", "sheet", "light"]
    schema = "site string, i long, j long, " + ", ".join(f"{n} double" for n in names)
    none = [None] * 7
    cells = spark.createDataFrame([("a", 0, 0, *none), ("a", 0, 0, *none), ("a", 40, 0, 90.0, *none[1:]), ("a", None, 3, *none), ("b", 0, 0, *none), ("b", 40, 0, 59.0, *none[1:]), (None, 0, 0, *none)], schema)
    suns = spark.createDataFrame([(3, 720, 45.0, 180.0, 1000.0, False)], "month int, minute int, elev double, az double, w double, lunch boolean")
    for tile in (128, 16, 1):
        got = sorted((str(r.site), r.i, r.hours) for r in light.month_cube(cells, suns, 1.5, ("site",), tile=tile).collect())
        # 40 cells of 1.5 m at 45 degrees: what is over 60 m shades.
        assert got == [("None", 0, 0.25), ("a", 0, 0.0), ("a", 0, 0.0), ("b", 0, 0.25)]
    assert light.month_cube(cells, suns.limit(0), 1.5, ("site",)).count() == light.month_cube(cells.limit(0), suns, 1.5, ("site",)).count() == 0


@pytest.mark.parametrize("seed", range(3))
def test_tiles_against_a_march_over_the_whole_grid(spark, seed):
    rng = np.random.default_rng(seed)
    n, res = 22, 1.5
    grid = {c: np.where(rng.random((n, n)) < p, rng.uniform(*x, (n, n)), 0) for c, p, x in (("roof", 0.05, (2, 30)), ("green_top", 0.05, (5, 12)), ("leaf_top", 0.05, (5, 12)), ("sheet", 0.1, (5, 6)))}
    low = {"green_bottom": np.where(grid["green_top"] > 0, rng.uniform(1, 8, (n, n)), 0), "leaf_bottom": np.where(grid["leaf_top"] > 0, rng.uniform(1, 8, (n, n)), 0), "light": rng.uniform(0.2, 0.7, (n, n))}
    grid |= low
    names = ["roof", "green_top", "green_bottom", "leaf_top", "leaf_bottom", "sheet", "light"]
    cells = spark.createDataFrame([(i, j, *(float(grid[c][i, j]) for c in names)) for i in range(n) for j in range(n)], "i long, j long, " + ", ".join(f"{c} double" for c in names))
    positions = [(int(rng.integers(1, 13)), k, float(rng.uniform(3.1, 70)), float(rng.uniform(60, 300)), float(rng.uniform(100, 900)), bool(k % 2)) for k in range(9)]
    suns = spark.createDataFrame(positions, "month int, minute int, elev double, az double, w double, lunch boolean")
    highest = max(grid[c].max() for c in ("roof", "green_top", "leaf_top"))
    want = {(m, i, j): [0.0, 0.0, 0.0] for m, *_ in positions for i in range(n) for j in range(n) if grid["roof"][i, j] == 0}
    at = lambda c, i, j: grid[c][i, j] if 0 <= i < n and 0 <= j < n else 0.0
    for month, _, elev, az, w, lunch in positions:
        tan, a, ray = math.tan(math.radians(elev)), math.radians(az), {}
        for k in range(1, 221):
            if k * res * tan > highest:
                break
            o = (round(-k * math.cos(a)), round(k * math.sin(a)))
            ray[o] = math.hypot(*o) * res * tan
        for m, i, j in want:
            if m != month:
                continue
            hit = [any(at(t, i + p, j + q) > z + 0.01 and (b is None or at(b, i + p, j + q) < z) for (p, q), z in ray.items()) for t, b in (("roof", None), ("green_top", "green_bottom"), ("leaf_top", "leaf_bottom"))]
            f = 0.0 if hit[0] else (0.15 if hit[1] else 1) * ((0.55 if month in light.BARE_MONTHS else 0.15) if hit[2] else 1)
            under = [grid["light"][p, q] for p, q in sheets(grid["sheet"], i, j, res * tan, a)]
            f *= max(under, default=1.0)
            for k, x in enumerate(((f >= 0.5) * 0.25, f * w * 0.25 / 1000, (f >= 0.5) * 15 * lunch)):
                want[m, i, j][k] += x
    for tile in (64, 7):
        got = {(r.month, r.i, r.j): (r.hours, r.insol, r.midday) for r in light.month_cube(cells, suns, res, tile=tile).collect()}
        assert got.keys() == want.keys() and all(got[k] == pytest.approx(v) for k, v in want.items())


def sheets(sheet, i, j, rise, a):
    """Cells of sheets that the ray from a cell crosses at the height of the sheet there."""
    n, out = len(sheet), []
    for h in np.unique(sheet[sheet > 0]):
        p, q = i + round(-h / rise * math.cos(a)), j + round(h / rise * math.sin(a))
        if 0 <= p < n and 0 <= q < n and sheet[p, q] == h:
            out.append((p, q))
    return out


def test_results_are_written_and_read(spark, tmp_path):
    path = f"file://{tmp_path}/r"
    edges = spark.createDataFrame([(1, 2, 0.5, None)], "a long, b long, flow double, hours double")
    origins = spark.createDataFrame([("bus", 0.2), ("bus", 0.3), ("tram", 0.5)], "mode string, w double")
    studies.write_flows(path, edges, origins, edges.limit(0))
    assert studies.read_flows(spark, path).collect() == edges.collect()
    assert {r.mode: r.w for r in studies.read_flows(spark, path, "modal_split").collect()} == {"bus": 0.5, "tram": 0.5}
    scenario = spark.createDataFrame([("s", [[1.0, 2.0]], 6.0, None)], "name string, sail_cells array<array<double>>, sail_h double, sail_tau double")
    studies.write_scenarios(scenario, f"{path}/json")
    assert json.loads(spark.read.text(f"{path}/json").first()[0]) == {"name": "s", "sail_cells": [[1.0, 2.0]], "sail_h": 6.0}
    assert studies.scenarios(spark, f"{path}/json")["sheets"].collect()[0][1:] == (1.0, 2.0, 6.0, 0.28)
    rings = spark.createDataFrame([("roof", 1), ("eave", 2)], "layer string, pos long")
    points = spark.createDataFrame([("plant", 1.0)], "kind string, x double")
    covers = spark.createDataFrame([("grass", 3)], "class string, pos long")
    studies.write_drawing(f"{path}/d", rings, points, covers)
    assert studies.read_drawing(spark, f"{path}/d", "rings").filter("layer = 'roof'").first().pos == 1
    counts = studies.element_counts(spark.createDataFrame([("a", 1), ("a", None), ("b", 2)], "kind string, v int"), "kind")
    assert {(r.kind, r.n, r.no_v) for r in counts.collect()} == {("a", 2, 1), ("b", 1, 0)}


def test_median_of_a_whole_table(spark):
    with_checkpoints(spark)
    for values in ([3.0], [1.0, 2.0], [5.0, 1.0, 1.0, None], list(range(101)), [2.0] * 50 + [9.0] * 50, [None]):
        rows = spark.createDataFrame([(None if v is None else float(v), float(k)) for k, v in enumerate(values)], "z double, y double")
        known = [v for v in values if v is not None]
        got = spatial.whole_median(rows, "z", "y").first()
        assert got.z == (statistics.median(known) if known else None) and got.y == statistics.median(range(len(values)))
