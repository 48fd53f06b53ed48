"""Routes and flows over arrays in tasks, against the rounds of joins and against plain searches."""

import heapq
import random
import time

import pytest

from sunlattice.operators import graph
from sunlattice.plans.registry import QUERIES, flows
from sunlattice.session import with_checkpoints

SF = "/root/testdata/sf0.001"
EDGES = "a long, b long, cost double"


def plain(edges, source):
    """dist and prev of each node: the least of (cost, distance of the node before, node before)."""
    near = {}
    for a, b, c in edges:
        near.setdefault(a, []).append((b, c)), near.setdefault(b, []).append((a, c))
    dist, heap = {}, [(0.0, source)]
    while heap:
        d, n = heapq.heappop(heap)
        if n not in dist:
            dist[n] = d
            for v, c in near.get(n, ()):
                heapq.heappush(heap, (d + c, v))
    return {v: (d, None if v == source else min((dist[u], u) for u, c in near[v] if u in dist and dist[u] + c == d)[1]) for v, d in dist.items()}


def some_edges(seed, n=60, m=110):
    rng = random.Random(seed)
    best = {}
    for _ in range(m):
        a, b = sorted(rng.sample(range(n), 2))
        best[a, b] = float(rng.randrange(1, 5))
    return [(a, b, c) for (a, b), c in best.items()]


@pytest.mark.parametrize("most", [1 << 21, 3])
def test_paths_and_flows_against_plain_searches(spark, most):
    with_checkpoints(spark)
    edges = some_edges(1)
    sources = [(0,), (7,), (7,), (999,), (None,)]
    e = spark.createDataFrame([*edges, (None, 1, 1.0), (1, 2, None), (3, None, 1.0)], EDGES)
    paths = graph.shortest_paths(e, spark.createDataFrame(sources, "source long"), most).checkpoint()
    got = {(r.source, r.node): (r.dist, r.prev) for r in paths.collect()}
    want = {(s, v): x for s in (0, 7) for v, x in plain(edges, s).items()} | {(999, 999): (0.0, None)}
    assert got == want
    rng = random.Random(2)
    demand = [(s, rng.randrange(60), rng.random()) for s in (0, 7, 999) for _ in range(80)] + [(0, 0, 1.0), (7, 5000, 1.0), (0, 3, None)]
    sums = {}
    for s, v, w in demand:
        while w and (s, v) in want and want[s, v][1] is not None:
            u = want[s, v][1]
            sums[min(u, v), max(u, v)] = sums.get((min(u, v), max(u, v)), 0) + w
            v = u
    d = spark.createDataFrame(demand, "source long, node long, w double")
    found = {(r.a, r.b): r.flow for r in graph.edge_flows(paths, d, most).collect()}
    assert found == {k: pytest.approx(v) for k, v in sums.items()}
    assert graph.edge_flows(paths, d.limit(0), most).count() == graph.edge_flows(paths.limit(0), d, most).count() == 0
    assert graph.shortest_paths(e.limit(0), spark.createDataFrame([(4,)], "source long"), most).collect() == [(4, 4, 0.0, None)]


def test_edges_without_cost_make_no_circles(spark):
    with_checkpoints(spark)
    edges = spark.createDataFrame([(1, 2, 0.0), (1, 9, 0.0), (2, 9, 0.0), (2, 3, 1.0)], EDGES)
    paths = graph.shortest_paths(edges, spark.createDataFrame([(9,)], "source long")).checkpoint()
    up = {r.node: r.prev for r in paths.collect()}
    for n in up:
        for _ in range(5):
            n = up.get(n) if n != 9 else 9
        assert n == 9
    trips = spark.createDataFrame([(9, 3, 1.0)], "source long, node long, w double")
    assert graph.edge_flows(paths, trips).filter("a = 2 and b = 3").first().flow == 1.0
    with pytest.raises(ValueError):
        graph.shortest_paths(spark.createDataFrame([(1, 2, -1.0)], EDGES), spark.createDataFrame([(1,)], "source long"))


def test_a_long_chain_takes_seconds(spark):
    with_checkpoints(spark)
    n = 10_000
    edges = spark.range(n).selectExpr("id AS a", "id + 1 AS b", "1.0D AS cost")
    began = time.perf_counter()
    paths = graph.shortest_paths(edges, spark.createDataFrame([(0,), (n // 2,)], "source long")).checkpoint()
    assert paths.count() == 2 * (n + 1) and paths.agg({"dist": "max"}).first()[0] == n
    flow = graph.edge_flows(paths, spark.createDataFrame([(0, n, 1.0), (n // 2, n, 2.0)], "source long, node long, w double"))
    assert {r[0]: r[1] for r in flow.groupBy("flow").count().collect()} == {1.0: n // 2, 3.0: n // 2}
    assert time.perf_counter() - began < 30


def test_flows_of_the_whole_graph(spark):
    edges, sources = flows._one_graph(spark, SF)
    rows = [tuple(r) for r in edges.select("a", "b", "cost").collect()]
    want = {}
    for s in {r.source for r in sources.collect()}:
        up = plain(rows, s)
        for v in up:
            w, n = 1 / (1 + v % 4), v
            while up[n][1] is not None:
                a, b = sorted((n, up[n][1]))
                want[a, b] = want.get((a, b), 0) + w
                n = up[n][1]
    assert {(r.a, r.b): r.flow for r in QUERIES["walk_flows"](spark, SF).collect()} == {k: pytest.approx(v, abs=1e-5) for k, v in want.items()}
