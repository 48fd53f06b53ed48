"""Flows of segments on cells, against a plain walk along each segment."""

import math
import random

import pytest

from sunlattice.operators import raster

SCHEMA = "id long, flow double, ax double, ay double, bx double, by double"


def plain(rows, step, top, res):
    cut = lambda v: math.trunc(round(v, 9))
    sums = {}
    for _, flow, ax, ay, bx, by in rows:
        n = max(2, int(math.sqrt((bx - ax) ** 2 + (by - ay) ** 2) / step) + 1)
        at = [(ax + k / (n - 1) * (bx - ax), ay + k / (n - 1) * (by - ay)) for k in range(n)]
        for i, j in {(cut((top - y) / res) + a, cut(x / res) + b) for x, y in at for a in (-1, 0, 1) for b in (-1, 0, 1)}:
            old = sums.get((i, j))
            sums[i, j] = old if flow is None else (old or 0.0) + flow
    return sums


@pytest.mark.parametrize("spread", [60.0, 9000.0])
def test_cells_of_segments_count_once(spark, spread):
    rng = random.Random(3)
    ends = lambda: [rng.uniform(-spread, spread) for _ in range(4)]
    rows = [(k, None if k % 9 == 0 else rng.random(), *ends()) for k in range(60 if spread < 100 else 9)]
    rows += [(100, 2.0, 1.5, 1.5, 1.5, 1.5), (101, 0.0, 500.0, 3.0, 700.0, 3.0), (102, None, 9000.0, 0.0, 9002.3, 0.0), (103, 1.0, 0.0, 0.0, 2.3, 2.3)]
    got = {(r.i, r.j): r.flow for r in raster.flow_cells(spark.createDataFrame(rows, SCHEMA), 1.2, 90.0, 1.5).collect()}
    assert got == {k: None if v is None else pytest.approx(v) for k, v in plain(rows, 1.2, 90.0, 1.5).items()}


def test_segments_without_a_place_keep_their_row(spark):
    rows = spark.createDataFrame([(1, 2.0, None, 1.0, 3.0, 1.0), (2, 3.0, None, None, None, None)], SCHEMA)
    got = {(r.i, r.j): r.flow for r in raster.flow_cells(rows, 1.2, 90.0, 1.5).collect()}
    assert got == {(58, None): 2.0, (59, None): 2.0, (60, None): 2.0, (None, None): 3.0}


def test_no_row_of_a_segment_and_cell_is_shuffled(spark):
    """Samples, cells and neighbours stay in the task: the shuffle holds a sum a cell and task."""
    rows = spark.range(2000).selectExpr("id", "1.0D AS flow", "id % 50 * 1.0D AS ax", "id % 40 * 1.0D AS ay", "id % 7 * 9.0D AS bx", "id % 11 * 5.0D AS by")
    df = raster.flow_cells(rows, 1.2, 90.0, 1.5)
    df.collect()

    def written(plan):
        name, metrics = plan.nodeName(), plan.metrics()
        own = metrics.apply("shuffleRecordsWritten").value() if name == "Exchange" else 0
        if name == "AdaptiveSparkPlan":
            return written(plan.executedPlan())
        below = [written(plan.plan())] if name.startswith("ShuffleQueryStage") else [written(plan.children().apply(k)) for k in range(plan.children().size())]
        return own + sum(below)

    assert written(df._jdf.queryExecution().executedPlan()) <= 8 * 64 * 64
