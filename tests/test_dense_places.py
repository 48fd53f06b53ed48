"""Places that many points share, scans over tiles and what lacks a place, against plain loops."""

import random
import statistics
import time

import pytest
from pyspark.sql import functions as F

from sunlattice.operators import sites, spatial
from sunlattice.session import with_checkpoints

NAN = float("nan")


def places(seed, n, spread, whole=False):
    rng = random.Random(seed)
    at = (lambda: float(rng.randrange(int(spread)))) if whole else (lambda: rng.uniform(-spread, spread))
    return [(k, at(), at()) for k in rng.sample(range(10 * n), n)]


@pytest.mark.parametrize("most", [1 << 19, 10])
@pytest.mark.parametrize("whole", [True, False])
def test_scans_against_loops(spark, most, whole):
    with_checkpoints(spark)
    rows = places(1, 700, 120.0, whole)
    kept = []
    for k, x, y in sorted(rows):
        if not any((x - a) ** 2 + (y - b) ** 2 < 9.0 for _, a, b in kept):
            kept.append((k, x, y))
    df = spark.createDataFrame([*rows, (-1, None, 1.0), (-2, NAN, 1.0), (-3, None, 1.0)], "id long, x double, y double")
    assert {r.id for r in spatial.first_wins(df, 3.0, most).collect()} == {-1, -2, -3} | {k for k, _, _ in kept}
    level = [(k, x, y, abs(x) + abs(y)) for k, x, y in rows]
    stay = []
    for k, x, y, d in sorted(level, key=lambda r: r[3]):
        if not any((x - a) ** 2 + (y - b) ** 2 < 36.0 and e < d - 1.5 for _, a, b, e in stay):
            stay.append((k, x, y, d))
    df = spark.createDataFrame([*level, (-1, 0.0, 1.0, None), (-2, None, 0.0, 1.0)], "id long, x double, y double, d double")
    assert {r.id for r in spatial.undominated(df, 6.0, 1.5, most).collect()} == {-1, -2} | {r[0] for r in stay}


def test_own_distances_against_a_loop(spark):
    with_checkpoints(spark)
    rng = random.Random(5)
    rows = [(k, x, y, rng.choice([0.0, 2.0, 3.5, 8.0, None])) for k, x, y in places(2, 600, 60.0, True)]
    kept = []
    for k, x, y, apart in sorted(rows):
        if apart is None or not any((x - a) ** 2 + (y - b) ** 2 <= min(apart, 5.0) ** 2 for _, a, b in kept):
            kept.append((k, x, y))
    df = spark.createDataFrame(rows, "id long, x double, y double, apart double")
    assert {r.id for r in spatial.first_wins_within(df, 5.0).collect()} == {k for k, _, _ in kept}


@pytest.mark.parametrize("whole", [True, False])
def test_nearest_and_medians_against_loops(spark, whole):
    with_checkpoints(spark)
    left, right = places(3, 300, 90.0, whole), places(4, 500, 100.0, whole)
    l = spark.createDataFrame([*left, (-1, None, 0.0), (-2, NAN, NAN)], "id long, x double, y double")
    z = {k: float(k % 17) for k, _, _ in right} | {right[0][0]: None}
    r = spark.createDataFrame([*((*p, z[p[0]]) for p in right), (-5, None, 1.0, 3.0)], "rid long, rx double, ry double, z double")
    d2 = lambda p, q: (p[1] - q[1]) ** 2 + (p[2] - q[2]) ** 2
    want = {}
    for p in left:
        near = [(d2(p, q), q[0]) for q in right if d2(p, q) <= 49.0]
        if near:
            want[p[0]] = min(near)[::-1]
    assert {x.id: (x.rid, x.d2) for x in spatial.nearest_within(l, r, 7.0).collect()} == want
    whole_ = statistics.median([*(v for v in z.values() if v is not None), 3.0])
    medians = {-1: (whole_, 0), -2: (whole_, 0)}
    for p in left:
        near = [z[q[0]] for q in right if d2(p, q) <= 144.0 and z[q[0]] is not None]
        medians[p[0]] = (statistics.median(near) if len(near) >= 3 else whole_, len(near))
    assert {x.id: (x.z, x.n) for x in spatial.local_median(l, r, 12.0).collect()} == medians


def test_points_at_one_place_make_no_pairs(spark):
    """The square of the points of a place, 10^10 pairs, would take hours."""
    with_checkpoints(spark)
    began = time.perf_counter()
    df = spark.range(100_000).selectExpr("id", "id % 3 * 4.0D AS x", "0.0D AS y", "id % 3 * 4.0D AS d", "8.0D AS apart")
    samples = df.selectExpr("id AS rid", "x AS rx", "y AS ry", "d AS z")
    assert [r.id for r in spatial.first_wins(df, 5.0).orderBy("id").collect()] == [0, 2]
    assert [r.id for r in spatial.first_wins_within(df, 8.0).orderBy("id").collect()] == [0]
    assert spatial.undominated(df, 5.0, 3.0).count() == 66_667
    assert {tuple(r) for r in spatial.nearest_within(df, samples, 1.0).selectExpr("id % 3", "rid", "d2").distinct().collect()} == {(k, k, 0.0) for k in range(3)}
    assert time.perf_counter() - began < 60


def test_plants_at_one_place_make_no_pairs(spark):
    with_checkpoints(spark)
    began = time.perf_counter()
    many = spark.range(60_000).selectExpr("id", "0.0D AS x", "1.0D AS y")
    census = many.selectExpr("*", "id % 5 * 1.0D AS h", "3.0D AS crown")
    mapped = spark.createDataFrame([(7, 40.0, 1.0, None, None, True), (8, 40.0, 1.0, 5.0, None, None)], "id long, x double, y double, h double, crown double, evergreen boolean")
    got = sites.merged_plants(mapped, census, many.selectExpr("id", "x + 3.75D AS x", "y"), many.selectExpr("id", "x + id % 2 * 12 AS x", "y"))
    assert sorted(tuple(r) for r in got.collect()) == [(0, 7, 40.0, 1.0, 3.0, 3.0, True), (1, 0, 0.0, 1.0, 3.0, 3.0, False), (2, 0, 3.75, 1.0, 3.0, 3.0, False), (3, 1, 12.0, 1.0, 3.0, 3.0, False)]
    assert time.perf_counter() - began < 60


def test_stops_and_doors_at_one_place_make_no_pairs(spark):
    """The pairs of stops, 4 x 10^8 a place, would take long; doors at one place count each."""
    with_checkpoints(spark)
    began = time.perf_counter()
    metro = spark.range(60_000).selectExpr("id", "'metro' AS kind", "'m' AS name", "id % 3 * 100.0D AS x", "0.0D AS y")
    doors = spark.createDataFrame([(70_000, 3.0), (70_001, 3.0), (70_002, 0.0)], "id long, x double").selectExpr("id", "'metro_entrance' AS kind", "CAST(NULL AS string) AS name", "x", "0.0D AS y")
    got = sites.walk_origins(metro.union(doors), (-1.0, 1.0, -1.0, 1.0), {"metro": 1.0}, cutoff=150.0, radius=90.0, gain=5.0, entrance=4.0)
    found = {(r.x, r.y): (r.n, r.w) for r in got.groupBy("x", "y").agg(F.count("*").alias("n"), F.sum("w").alias("w")).collect()}
    assert found == {(3.0, 0.0): (40_000, pytest.approx(1 / 3)), (0.0, 0.0): (20_000, pytest.approx(1 / 6)), (100.0, 0.0): (20_000, pytest.approx(0.5))}
    assert time.perf_counter() - began < 60
