"""Zones against plain loops."""

import random

import pytest

from sunlattice.operators import zones


@pytest.mark.parametrize("radius", [0.0, 1.0, 2.5, 6.67])
def test_within_is_a_disc_around_each_cell(spark, radius):
    rng = random.Random(3)
    cells = {(rng.randrange(30), rng.randrange(25)) for _ in range(25)} | {(4, j) for j in range(9)}
    rows = [*cells, (4, 3), (None, 3), (2, None)]
    got = [tuple(r) for r in zones.within(spark.createDataFrame(rows, "i long, j long"), radius, 30, 25).collect()]
    assert len(got) == len(set(got))
    assert set(got) == {(i, j) for i in range(30) for j in range(25) if any((i - a) ** 2 + (j - b) ** 2 <= radius * radius for a, b in cells)}


def test_the_last_ring_decides_and_nothing_gives_nothing(spark):
    ring = lambda a, b: [(a, a), (b, a), (b, b), (a, b)]
    rows = [(1, [("inner", ring(2.0, 4.0)), ("outer", ring(0.0, 6.0))]), (2, [("outer", ring(3.0, 5.0))])]
    kind = "ordinal long, rings array<struct<role: string, ring: array<struct<x: double, y: double>>>>"
    buildings = spark.createDataFrame(rows, kind)
    roofs = spark.createDataFrame([(i, j) for i in range(8) for j in range(8)], "i long, j long")
    got = {(8 - 1 - r.i, r.j) for r in zones.building_cells(buildings, roofs, 0.0, 8.0, 1.0, 8, 8).collect()}
    hole = {(y, x) for y in (2, 3) for x in (2, 3)} - {(3, 3)}
    assert got == {(y, x) for y in range(6) for x in range(6)} - hole
    assert zones.zone(buildings.limit(0), roofs, 0.0, 8.0, 1.0, 8, 8).count() == 0
    totals = zones.green_totals(roofs.limit(0), roofs.limit(3), roofs.limit(2), 2.0, 3.0, 0.5).collect()
    assert [(r.scenario, r.plants) for r in totals] == [("baseline", 0), ("trees", 3), ("sails", 0)] and totals[2].canopy_m2 == 9.0


def test_plants_inside_keep_their_columns_and_repeats(spark):
    plants = spark.createDataFrame([(0.5, 7.5, "a"), (0.5, 7.5, "a"), (5.5, 7.5, "b"), (None, 7.5, "c")], "x double, y double, cell string")
    cells = spark.createDataFrame([(0, 0)], "i long, j long")
    got = zones.plants_inside(plants, cells, 0.0, 8.0, 1.0)
    assert got.columns == ["x", "y", "cell"] and [r.cell for r in got.collect()] == ["a", "a"]
    assert zones.plants_inside(plants, cells.limit(0), 0.0, 8.0, 1.0).count() == 0
