"""Graphs that are dealt to tasks: against a search with a heap, over edges without cost, and without the driver."""

import heapq
import random

import numpy as np
import pytest
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sunlattice.operators import graph
from sunlattice.session import with_checkpoints

EDGES = "a long, b long, cost double"


def by_heap(edges, source):
    """dist and prev as they are settled: the least of (cost, distance of the node before, node before)."""
    near = {}
    for a, b, c in edges:
        near.setdefault(a, []).append((b, c)), near.setdefault(b, []).append((a, c))
    out, heap = {}, [(0.0, 0.0, -1, source)]
    while heap:
        d, _, p, n = heapq.heappop(heap)
        if n not in out:
            out[n] = (d, None if p < 0 else p)
            for v, c in near.get(n, ()):
                heapq.heappush(heap, (d + c, d, n, v))
    return out


def some_edges(seed, n, m, costs):
    rng = random.Random(seed)
    best = {tuple(sorted(rng.sample(range(n), 2))): rng.choice(costs) for _ in range(m)}
    return [(a, b, c) for (a, b), c in best.items()]


@pytest.mark.parametrize("costs", [[1.0, 2.0, 3.0], [0.0, 0.0, 1.0], [0.1, 0.2, 0.3, 1e-18], [0.0], [1.0, float("inf"), float("nan")]])
def test_arrays_settle_as_a_heap_does(costs):
    for seed in range(40):
        edges = some_edges(seed, 40, 70, costs)
        rows = graph.Rows([np.array(c) for c in zip(*edges)])
        for s in (0, len(rows.nodes) - 1):
            for run in (1, 1 << 20):
                node, dist, prev, edge = rows.paths(s, run)
                got = {int(rows.nodes[v]): (d, None if p < 0 else int(rows.nodes[p])) for v, d, p in zip(node, dist, prev)}
                want = by_heap([e for e in edges if e[2] == e[2]], int(rows.nodes[s]))
                assert got == want
                assert (rows.to[edge[prev >= 0]] == prev[prev >= 0]).all()
            assert np.array_equal(rows.costs(s, 1), rows.costs(s), equal_nan=True)


@pytest.mark.parametrize("most", [1 << 23, 3])
def test_flows_of_trees_match_those_of_paths(spark, most):
    with_checkpoints(spark)
    e = spark.createDataFrame(some_edges(5, 60, 90, [1.0, 2.0, 2.5]), EDGES)
    sources = spark.createDataFrame([(0,), (7,), (7,), (12,), (999,), (None,)], "source long")
    paths = graph.shortest_paths(e, sources).checkpoint()
    want = {(r.a, r.b): pytest.approx(r.flow) for r in graph.edge_flows(paths, paths.select("source", "node", (F.col("node") % 3).alias("w"))).collect()}
    got = {(r.a, r.b): r.flow for r in graph.routed_flows(e, sources, lambda node: node % 3, most).collect()}
    assert got == want
    assert graph.routed_flows(e.limit(0), sources, lambda node: node, most).count() == graph.routed_flows(e, sources.limit(0), lambda node: node, most).count() == 0


def test_graphs_do_not_pass_through_the_driver(spark, monkeypatch):
    with_checkpoints(spark)
    for name in ("toArrow", "toPandas"):
        monkeypatch.setattr(type(spark.range(1)), name, lambda self: pytest.fail("rows on the driver"))
    edges = spark.range(200_000).selectExpr("id AS a", "(id * 7 + 1) % 200000 AS b", "1.0D AS cost")
    sources = spark.range(3).selectExpr("id AS source")
    assert graph.shortest_paths(edges, sources).agg(F.max("dist")).count() == 1
    assert isinstance(graph.routed_flows(edges, sources, lambda node: 1.0 + node % 2), DataFrame)
