"""Queries that SQL doesn't tell, against plain Python, and edge cases of the operators."""

import heapq
import math
import random
from collections import defaultdict

import pytest

from sunlattice.functions import attributes, geometry
from sunlattice.operators import graph, placement, raster, sequences, spatial
from sunlattice.plans.registry import QUERIES
from sunlattice.session import with_checkpoints

SF = "/root/testdata/sf0.01"


def test_flows_follow_shortest_paths(spark):
    rng = random.Random(3)
    edges = {}
    for _ in range(60):
        a, b = sorted(rng.sample(range(25), 2))
        edges[a, b] = float(rng.randrange(1, 5))
    near = defaultdict(list)
    for (a, b), c in edges.items():
        near[a].append((b, c))
        near[b].append((a, c))
    want, costs = defaultdict(float), {}
    for s in (0, 7):
        dist, prev, heap = {s: 0.0}, {}, [(0.0, s)]
        while heap:
            d, u = heapq.heappop(heap)
            if d > dist[u]:
                continue
            for v, c in near[u]:
                if d + c < dist.get(v, math.inf):
                    dist[v], prev[v] = d + c, u
                    heapq.heappush(heap, (d + c, v))
        costs |= {(s, v): d for v, d in dist.items()}
        for v in dist:
            at = v
            while at != s:
                want[min(at, prev[at]), max(at, prev[at])] += 1 / (1 + v % 4)
                at = prev[at]
    with_checkpoints(spark)
    table = spark.createDataFrame([(a, b, c) for (a, b), c in edges.items()], "a long, b long, cost double")
    paths = graph.shortest_paths(table, spark.createDataFrame([(0,), (7,)], "source long")).checkpoint()
    assert {(r.source, r.node): r.dist for r in paths.collect()} == costs
    demand = paths.filter("prev is not null").selectExpr("source", "node", "1 / (1 + node % 4) w")
    got = {(r.a, r.b): r.flow for r in graph.edge_flows(paths, demand).collect()}
    assert got.keys() == want.keys() and all(abs(got[k] - want[k]) < 1e-9 for k in want)


def test_first_wins_is_no_anti_join(spark):
    with_checkpoints(spark)
    rng = random.Random(8)
    points = [(k, rng.random() * 50, rng.random() * 50) for k in range(300)]
    kept = []
    for p in points:
        if all(math.hypot(p[1] - q[1], p[2] - q[2]) >= 4 for q in kept):
            kept.append(p)
    got = spatial.first_wins(spark.createDataFrame(points, "id long, x double, y double"), 4.0)
    assert sorted(r.id for r in got.collect()) == [p[0] for p in kept]


def test_greedy_takes_the_best_each_time(spark):
    rng = random.Random(1)
    cells = {(i, j): (rng.random(), rng.random()) for i in range(14) for j in range(12) if rng.random() < 0.9}
    kernel = [(a, b, 0.8 if (a, b) == (0, 0) else 0.3) for a, b in raster.disc(1.5)]
    rows = [("k", i, j, w, s) for (i, j), (w, s) in cells.items()]
    got = placement.greedy(spark.createDataFrame(rows, "kind string, i long, j long, weight double, sun double"), kernel, 2.5, 8, 0.0).orderBy("step").collect()
    sun, free = {k: v[1] for k, v in cells.items()}, set(cells)
    for r in got:
        gain = {c: sum(x * cells[c[0] + a, c[1] + b][0] * sun[c[0] + a, c[1] + b] for a, b, x in kernel if (c[0] + a, c[1] + b) in cells) for c in free}
        assert abs(max(gain.values()) - r.gain) < 1e-9 and abs(gain[r.i, r.j] - r.gain) < 1e-9
        for a, b, x in kernel:
            if (r.i + a, r.j + b) in sun:
                sun[r.i + a, r.j + b] *= 1 - x
        free -= {c for c in free if math.hypot(c[0] - r.i, c[1] - r.j) < 2.5}
    assert len(got) == 8


def test_greedy_over_tiles(spark):
    """Only the best tiles are searched, with ties, a null kind, seeds and cells below zero; gains are exact in halves."""
    rng = random.Random(3)
    kernel, seeds, spacing, most = [(a, b, 0.5) for a, b in raster.disc(1.0)], ((-9.0, 20.0, 3.0, 2),), 2.5, 5
    grids = {k: {(i, j): (float(rng.randrange(3)), float(rng.randrange(1, 4))) for i in range(-20, 25) for j in range(-15, 30) if rng.random() < 0.8} for k in ("a", None)}
    rows = [(k, i, j, w, s, "x") for k, grid in grids.items() for (i, j), (w, s) in grid.items()]
    schema = "kind string, i int, j int, weight double, sun double, ti string"
    want = set()
    for kind, cells in grids.items():
        sun, free, n = {c: v[1] for c, v in cells.items()}, set(cells), 0

        def gain(c):
            return sum(x * cells[c[0] + a, c[1] + b][0] * sun[c[0] + a, c[1] + b] for a, b, x in kernel if (c[0] + a, c[1] + b) in cells)

        for ci, cj, radius, until in [(*seeds[0][:3], seeds[0][3]), (0, 0, 1e9, most)]:
            while n < until:
                at = min((c for c in free if math.hypot(c[0] - ci, c[1] - cj) <= radius), key=lambda c: (-gain(c), c))
                want.add((kind, n, *at, gain(at)))
                n += 1
                for a, b, x in kernel:
                    if (at[0] + a, at[1] + b) in sun:
                        sun[at[0] + a, at[1] + b] *= 1 - x
                free -= {c for c in free if math.hypot(c[0] - at[0], c[1] - at[1]) < spacing}
    for tile in (3, 64):
        got = placement.greedy(spark.createDataFrame(rows, schema), kernel, spacing, most, 0.0, seeds, tile)
        assert {tuple(r) for r in got.collect()} == want
    assert placement.greedy(spark.createDataFrame([], schema), kernel, spacing, most).count() == 0


def test_stops_of_a_name_merge_in_order(spark):
    rng = random.Random(4)
    stops = [(k, rng.choice(["a", "b", None]), rng.random() * 40, rng.random() * 40) for k in range(200)]
    found = []
    for k, name, x, y in stops:
        for c in found:
            n = len(c["x"])
            if c["name"] == name and math.hypot(sum(c["x"]) / n - x, sum(c["y"]) / n - y) < 9:
                break
        else:
            c = {"name": name, "first": k, "x": [], "y": []}
            found.append(c)
        c["x"].append(x)
        c["y"].append(y)
    schema = "id long, name string, x double, y double"
    got = sequences.cluster_named(spark.createDataFrame([*stops, (900, "a", None, 1.0)], schema).repartition(5), 9.0).collect()
    assert {(r.name, r.cluster, r.n) for r in got} == {(c["name"], c["first"], len(c["x"])) for c in found}
    assert sequences.cluster_named(spark.createDataFrame([], schema), 9.0).count() == 0


@pytest.mark.parametrize("name", ["greedy_place", "flow_accumulate", "cluster_stops"])
def test_registered(spark, name):
    assert QUERIES[name](spark, SF).count() > 0


def test_march_agrees_with_rays(spark):
    a, b = ({(r.i, r.j): r.lit for r in QUERIES[q](spark, SF).collect()} for q in ("shadow_rays", "shadow_march"))
    assert a == b and min(a.values()) < max(a.values())


def test_numbers_cells_and_rules(spark):
    from pyspark.sql import functions as F

    texts = spark.createDataFrame([("12,5 m",), ("",), (None,), ("0",), ("x",)], "t string")
    assert [r[0] for r in texts.select(attributes.parse_number(F.col("t"))).collect()] == [12.5, None, None, 0.0, None]
    # Truncation: a point less than a cell beyond the edge falls in the first cell.
    i, j = geometry.cell_of(F.lit(-1.0), F.lit(10.5), 0.0, 10.0, 1.5)
    assert spark.range(1).select(i, j).first() == (0, 0)
    assert raster.ray_offsets(3.0, 90.0, 1.5, 5.0)[0][:2] == (0, 1)
    empty = spark.createDataFrame([], "id long, x double, y double")
    assert spatial.first_wins(empty, 1.0).count() == 0
