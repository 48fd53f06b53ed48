"""Walking graphs as edge tables."""

from __future__ import annotations

import heapq
from collections.abc import Callable

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def undirected(segments: DataFrame) -> DataFrame:
    """a < b with the least cost of parallel segments (u, v, cost, ordinal) and the tag of the last; loops go."""
    s = segments.filter("u <> v").withColumn("a", F.least("u", "v")).withColumn("b", F.greatest("u", "v"))
    return s.groupBy("a", "b").agg(F.min("cost").alias("cost"), F.max_by("tag", "ordinal").alias("tag"))


def components(edges: DataFrame) -> DataFrame:
    """node, label (the least node of its component) over edges (a, b), by least labels with shortcuts."""
    both = edges.select("a", "b").union(edges.select("b", "a")).checkpoint()
    labels = both.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("b")).select("node", F.least("node", "b").alias("label")).checkpoint()
    while True:
        near = both.join(labels.withColumnRenamed("node", "b"), "b").groupBy(F.col("a").alias("node")).agg(F.min("label").alias("near"))
        top = labels.select(F.col("node").alias("label"), F.col("label").alias("top"))
        step = labels.join(near, "node").join(top, "label").select("node", F.col("label").alias("old"), F.least("label", "near", "top").alias("label")).checkpoint()
        labels = step.select("node", "label")
        if not step.filter("label < old").limit(1).count():
            return labels


def largest_component(edges: DataFrame) -> DataFrame:
    """node, label of the component with most nodes (the least label on a tie)."""
    labels = components(edges)
    sizes = labels.groupBy("label").agg(F.count("*").alias("n"))
    best = sizes.agg(F.max(F.struct("n", (-F.col("label")).alias("neg"))).alias("best")).select((-F.col("best.neg")).alias("label"))
    return labels.join(F.broadcast(best), "label")


class Rows:
    """A graph as arrays: the edges of each node one behind the other. Nodes are numbered in the order of their ids."""

    def __init__(self, columns: list[np.ndarray]):
        """columns: ends and cost of the edges; the list is emptied, so that they can go as soon as they are read."""
        u, v, cost = columns
        columns.clear()
        if np.isnan(cost).any():
            known = ~np.isnan(cost)
            u, v, cost = u[known], v[known], cost[known]
        # Sorted in place: sets of numbers take several times their memory.
        ends = np.concatenate([u, v])
        ends.sort()
        self.nodes = ends[np.concatenate([[True], ends[1:] != ends[:-1]])] if len(ends) else ends
        del ends
        # Edges fit a task's memory, so numbers are short.
        a = np.searchsorted(self.nodes, u).astype(np.int32)
        del u
        b = np.searchsorted(self.nodes, v).astype(np.int32)
        del v
        from_ = np.concatenate([a, b])
        order = np.argsort(from_, kind="stable").astype(np.int32)
        self.first = np.zeros(len(self.nodes) + 1, np.int64)
        np.cumsum(np.bincount(from_, minlength=len(self.nodes)), out=self.first[1:])
        del from_
        self.to = np.concatenate([b, a])[order]
        order[order >= len(cost)] -= len(cost)
        self.cost = cost[order]
        self.width = float(cost.mean()) if len(cost) else 0.0

    def _edges(self, nodes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """How many edges each of the nodes has, and the numbers of all these edges."""
        n = self.first[nodes + 1] - self.first[nodes]
        return n, np.arange(n.sum()) + np.repeat(self.first[nodes] - np.cumsum(n) + n, n)

    def costs(self, source: int, run: int = 1 << 20) -> np.ndarray:
        """Least cost of each node; NaN where it isn't reached.

        Nodes whose cost has fallen pass it on together, those up to a limit first; it
        rises by the mean cost of an edge once there are none.
        """
        dist = np.full(len(self.nodes), np.nan)
        changed = np.zeros(len(dist), bool)
        dist[source], limit = 0.0, 0.0
        front, far = np.array([source]), []

        def each(found: list[np.ndarray]) -> np.ndarray:
            if sum(map(len, found)) < len(changed) >> 6:
                return np.unique(np.concatenate(found))
            for x in found:
                changed[x] = True
            out = np.flatnonzero(changed)
            changed[out] = False
            return out

        while len(front):
            upto, lo, fallen = np.cumsum(self.first[front + 1] - self.first[front]), 0, []
            while lo < len(front):
                hi = max(lo + 1, int(np.searchsorted(upto, (upto[lo - 1] if lo else 0) + run, side="right")))
                n, at = self._edges(front[lo:hi])
                to, d = self.to[at], np.repeat(dist[front[lo:hi]], n) + self.cost[at]
                less = ~(d >= dist[to])
                fallen.append(to[less])
                np.fmin.at(dist, fallen[-1], d[less])
                lo = hi
            to = each(fallen)
            near = dist[to] <= limit
            front = to[near]
            far.append(to[~near].astype(np.int32))
            if not len(front):
                wait = each(far)
                wait = wait[dist[wait] > limit]
                if len(wait):
                    limit = dist[wait].min() + self.width
                near = dist[wait] <= limit
                front, far = wait[near], [wait[~near].astype(np.int32)]
        return dist

    def paths(self, source: int, run: int = 1 << 20) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Numbers of the nodes reached, the distances, the nodes before them and the edges to those (-1 at the source).

        Of equal costs the predecessor nearer to the source wins, then the lower one.
        Nodes that only edges without cost lead to, from nodes as far, are settled
        after the others of their distance, so that routes make no circles.
        """
        dist = self.costs(source)
        prev, edge = np.full(len(dist), -1, np.int32), np.full(len(dist), -1, np.int32)
        none, lo = np.iinfo(np.int32).max, 0
        while lo < len(dist):
            hi = max(lo + 1, int(np.searchsorted(self.first, self.first[lo] + run, side="right")) - 1)
            begin, end = self.first[lo], self.first[hi]
            starts, n = self.first[lo:hi] - begin, np.diff(self.first[lo : hi + 1])
            to, own = self.to[begin:end], np.repeat(dist[lo:hi], n)
            before = dist[to]
            fits = (before < own) & (before + self.cost[begin:end] == own)
            fits &= before == np.repeat(np.minimum.reduceat(np.where(fits, before, np.inf), starts), n)
            least = np.minimum.reduceat(np.where(fits, to, none), starts)
            fits &= to == np.repeat(least, n)
            at = np.minimum.reduceat(np.where(fits, np.arange(end - begin), end - begin), starts)
            found = least < none
            prev[lo:hi][found], edge[lo:hi][found] = least[found], at[found] + begin
            lo = hi
        left = np.flatnonzero((prev < 0) & ~np.isnan(dist))
        loose = set(left[left != source].tolist())
        if loose:
            level = lambda v: ((k, int(self.to[k])) for k in range(self.first[v], self.first[v + 1]) if dist[self.to[k]] == dist[v] == dist[v] + self.cost[k])
            back = {(u, v): k for v in loose for k, u in reversed(list(level(v)))}
            heap = [(dist[v], u, v) for u, v in back if u not in loose]
            heapq.heapify(heap)
            while heap:
                d, u, v = heapq.heappop(heap)
                if v in loose:
                    loose.discard(v)
                    prev[v], edge[v] = u, back[u, v]
                    for _, w in level(v):
                        if w in loose:
                            heapq.heappush(heap, (d, v, w))
        node = np.flatnonzero(~np.isnan(dist))
        return node, dist[node], prev[node], edge[node]

    def add_flows(self, flow: np.ndarray, node: np.ndarray, prev: np.ndarray, edge: np.ndarray, w: np.ndarray) -> None:
        """Adds the weights of trips to the nodes of a tree of paths to the flow of the edges they take, from its far ends."""
        at = np.full(len(self.nodes), -1, np.int32)
        at[node] = np.arange(len(node))
        up = np.where(prev >= 0, at[prev], -1)
        # Ancestors twice as far each time count how deep a node is.
        deep, over = (up >= 0).astype(np.int32), up.copy()
        while True:
            some = np.flatnonzero(over >= 0)
            if not len(some):
                break
            deep[some] += deep[over[some]]
            over[some] = over[over[some]]
        order = np.argsort(deep, kind="stable")
        ends = np.cumsum(np.bincount(deep))
        w = w.copy()
        for k in range(len(ends) - 1, 0, -1):
            own = order[ends[k - 1] : ends[k]]
            np.add.at(w, up[own], w[own])
            flow[edge[own]] += w[own]


_PATHS = "source long, node long, dist double, prev long"


def _known(edges: DataFrame, sources: DataFrame) -> tuple[DataFrame, DataFrame, int]:
    """Whole edges (a, b, cost), written out, different sources and the number of edges."""
    known = edges.filter("a is not null and b is not null and cost is not null").select(F.col("a").cast("long"), F.col("b").cast("long"), F.col("cost").cast("double")).checkpoint()
    size = known.agg(F.count("*").alias("n"), F.min("cost").alias("least")).first()
    if size.n and size.least < 0:
        raise ValueError("costs must not be negative")
    return known, sources.select(F.col("source").cast("long").alias("source")).filter("source is not null").distinct(), size.n


def _searched(known: DataFrame, starts: DataFrame, size: int, search, schema: str) -> DataFrame:
    """What search(graph, sources) yields in each task: sources are dealt evenly, the graph is shuffled to as many tasks as run at once.

    Neither passes through the driver.
    """
    starts = starts.checkpoint()
    session = known.sparkSession
    parts = max(1, min(starts.count(), session.sparkContext.defaultParallelism, int(session.conf.get("spark.sql.shuffle.partitions"))))
    part = (F.row_number().over(Window.orderBy("source")) % parts).cast("int")
    none = F.lit(None).cast("long")
    copies = known.withColumn("part", F.explode(F.sequence(F.lit(0), F.lit(parts - 1))))
    rows = copies.select("part", "a", "b", "cost", none.alias("source")).union(starts.select(part.alias("part"), none, none, F.lit(None).cast("double"), "source"))

    def run(batches):
        columns, at, sources = [np.empty(size, np.int64), np.empty(size, np.int64), np.empty(size)], 0, []
        for batch in batches:
            sources.extend(batch.column(4).drop_null().to_pylist())
            batch = batch.filter(batch.column(1).is_valid())
            for k, column in enumerate(columns):
                column[at : at + batch.num_rows] = batch.column(k + 1).to_numpy()
            at += batch.num_rows
        if sources:
            yield from search(Rows(columns), sources)

    return rows.repartitionById(parts, F.col("part")).mapInArrow(run, schema)


def shortest_paths(edges: DataFrame, sources: DataFrame, max_edges: int = 1 << 23) -> DataFrame:
    """source, node, dist, prev from each different source over undirected edges (a, b, cost of 0 or more).

    Of equal costs the predecessor that is nearer to the source, then the lower
    one, is kept. A graph of at most `max_edges` edges (its size is counted) is
    dealt to tasks, each of which holds it as arrays and searches from its sources,
    so the work follows sources x edges and not the length of routes. A larger
    graph is walked by rounds of joins (`relaxed_paths`), with the same rows.

    A source without edges reaches itself. Null sources and edges with a null end
    or cost are left out; a negative cost is an error. No sources give no rows.
    """
    known, starts, size = _known(edges, sources)
    if size > max_edges:
        return relaxed_paths(known, starts)

    def search(g, sources, run: int = 1 << 18):
        names = ["source", "node", "dist", "prev"]
        for source in sources:
            at = int(np.searchsorted(g.nodes, source))
            if at == len(g.nodes) or g.nodes[at] != source:
                yield pa.RecordBatch.from_arrays([pa.array([source]), pa.array([source]), pa.array([0.0]), pa.array([None], pa.int64())], names)
                continue
            node, dist, prev, _ = g.paths(at)
            for lo in range(0, len(node), run):
                own, before = node[lo : lo + run], prev[lo : lo + run]
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(own), source)), pa.array(g.nodes[own]), pa.array(dist[lo : lo + run]), pa.array(g.nodes[before], mask=before < 0)], names)

    return _searched(known, starts, size, search, _PATHS)


def routed_flows(edges: DataFrame, sources: DataFrame, weight: Callable, max_edges: int = 1 << 23) -> DataFrame:
    """a, b, flow: `edge_flows` of the shortest paths from the sources, with a trip to each node reached.

    weight(node) is a trip's weight, of a column or of an array of nodes. Trees are
    added up where they are searched: only sums an edge and task are shuffled.
    """
    known, starts, size = _known(edges, sources)
    if size > max_edges:
        paths = relaxed_paths(known, starts).checkpoint()
        return edge_flows(paths, paths.select("source", "node", weight(F.col("node")).alias("w")))

    def search(g, sources, run: int = 1 << 18):
        flow = np.zeros(len(g.to))
        for source in sources:
            at = int(np.searchsorted(g.nodes, source))
            if at < len(g.nodes) and g.nodes[at] == source:
                node, _, prev, edge = g.paths(at)
                g.add_flows(flow, node, prev, edge, np.asarray(weight(g.nodes[node]), float))
        used = np.flatnonzero(flow)
        for lo in range(0, len(used), run):
            k = used[lo : lo + run]
            a, b = g.nodes[np.searchsorted(g.first, k, side="right") - 1], g.nodes[g.to[k]]
            yield pa.RecordBatch.from_arrays([pa.array(np.minimum(a, b)), pa.array(np.maximum(a, b)), pa.array(flow[k])], ["a", "b", "w"])

    return _searched(known, starts, size, search, "a long, b long, w double").groupBy("a", "b").agg(F.sum("w").alias("flow"))


def relaxed_paths(edges: DataFrame, sources: DataFrame) -> DataFrame:
    """The rows of `shortest_paths` by rounds that relax the edges of what has changed, for graphs of any size."""
    both = edges.select(F.col("a").alias("u"), F.col("b").alias("v"), "cost").union(edges.select("b", "a", "cost")).checkpoint()
    best = sources.select("source", F.col("source").alias("node"), F.lit(0.0).alias("dist"), F.lit(None).cast("long").alias("prev"), F.lit(0.0).alias("before")).checkpoint()
    front = best
    while front.limit(1).count():
        step = front.join(both, front.node == both.u).select("source", F.col("v").alias("node"), (F.col("dist") + F.col("cost")).alias("dist"), F.col("u").alias("prev"), F.col("dist").alias("before"))
        all_ = best.union(step)
        new = all_.groupBy("source", "node").agg(F.min(F.struct("dist", "before", F.coalesce("prev", F.lit(-1)).alias("prev"))).alias("m"))
        new = new.select("source", "node", "m.dist", F.when(F.col("m.prev") >= 0, F.col("m.prev")).alias("prev"), "m.before").checkpoint()
        front = new.join(best.select("source", "node", F.col("dist").alias("old")), ["source", "node"], "left").filter("old is null or dist < old").drop("old").checkpoint()
        best = new
    return best.drop("before")


def edge_flows(paths: DataFrame, demand: DataFrame, max_nodes: int = 1 << 21) -> DataFrame:
    """a, b, flow: weights of trips (source, node, w) summed over the edges of their paths (source, node, dist, prev).

    The paths from a source are a tree: weights are added up from its far ends, a
    source a group. Trees of more than `max_nodes` nodes are walked by rounds of
    joins instead (`relayed_flows`). Trips to nodes without a path, trips that walk
    nowhere and null weights give nothing; without trips there are no rows.
    """
    largest = paths.groupBy("source").count().agg(F.max("count")).first()[0] or 0
    trips = demand.groupBy("source", "node").agg(F.sum("w").alias("w"))
    if largest > max_nodes:
        return relayed_flows(paths, trips)
    rows = paths.select("source", "node", "prev").join(trips, ["source", "node"], "left")

    def one(pdf: pd.DataFrame) -> pd.DataFrame:
        nodes, prev, w = pdf["node"].to_numpy(), pdf["prev"].to_numpy(dtype=float), pdf["w"].fillna(0.0).to_numpy(dtype=float).copy()
        rooted = ~np.isnan(prev)
        order = np.argsort(nodes)
        parent = np.where(rooted, order[np.searchsorted(nodes[order], np.where(rooted, prev, nodes).astype(np.int64))], -1)
        # Far ends first: a node is passed on once all behind it are.
        behind = np.bincount(parent[rooted], minlength=len(nodes)).tolist()
        todo = [k for k, n in enumerate(behind) if not n]
        up, weight = parent.tolist(), w.tolist()
        while todo:
            k = todo.pop()
            p = up[k]
            if p >= 0:
                weight[p] += weight[k]
                behind[p] -= 1
                if not behind[p]:
                    todo.append(p)
        weight = np.array(weight)
        used = rooted & (weight != 0)
        a, b = nodes[used], prev[used].astype(np.int64)
        return pd.DataFrame({"a": np.minimum(a, b), "b": np.maximum(a, b), "w": weight[used]})

    parts = int(paths.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    flows = rows.repartition(parts, "source").groupBy("source").applyInPandas(one, "a long, b long, w double")
    return flows.groupBy("a", "b").agg(F.sum("w").alias("flow"))


def relayed_flows(paths: DataFrame, trips: DataFrame) -> DataFrame:
    """The rows of `edge_flows` by rounds that pass all weights on by one edge."""
    at = trips.checkpoint()
    flows = at.select(F.col("node").alias("a"), F.col("node").alias("b"), "w").limit(0)
    while at.limit(1).count():
        moved = at.join(paths.select("source", "node", "prev"), ["source", "node"]).filter("prev is not null").checkpoint()
        part = moved.select(F.least("node", "prev").alias("a"), F.greatest("node", "prev").alias("b"), "w")
        flows = flows.union(part)
        at = moved.groupBy("source", F.col("prev").alias("node")).agg(F.sum("w").alias("w")).checkpoint()
    return flows.groupBy("a", "b").agg(F.sum("w").alias("flow"))


def door_trips(paths: DataFrame, origins: DataFrame, doors: DataFrame) -> DataFrame:
    """source, node, w: trips of each origin (id, node, w) to each destination's doors (id, node, w, a row a door).

    A destination's weight is split evenly over those of its doors that a path
    reaches; doors at one node count each. Destinations that no path reaches get
    no trip. paths: source, node from the node of each origin.
    """
    ends = doors.select(F.col("id").alias("to"), "node", F.col("w").alias("w_to")).join(paths.select("source", "node"), "node")
    # A row a source and destination.
    reached = ends.groupBy("source", "to").agg(F.count("*").alias("n"))
    split = ends.join(reached, ["source", "to"]).groupBy("source", "node").agg(F.sum(F.col("w_to") / F.col("n")).alias("share"))
    from_ = origins.groupBy(F.col("node").alias("source")).agg(F.sum("w").alias("w_from"))
    return split.join(from_, "source").select("source", "node", (F.col("w_from") * F.col("share")).alias("w"))


def pair_usage(paths: DataFrame, doors: DataFrame) -> DataFrame:
    """a, b, flow: walks between all pairs of doors (id, node, w) that paths connect, each pair once with the product of its weights.

    paths: from the node of each door. Pairs come from joins on nodes; two doors at one node walk nowhere.
    """
    ends = paths.join(doors.select(F.col("id").alias("to"), "node", F.col("w").alias("w_to")), "node")
    pairs = ends.join(doors.select(F.col("id").alias("from"), F.col("node").alias("source"), F.col("w").alias("w_from")), "source").filter("from < to and source <> node")
    return edge_flows(paths, pairs.select("source", "node", (F.col("w_from") * F.col("w_to")).alias("w")))


def shade_of_routes(edges: DataFrame, limit: float) -> DataFrame:
    """One row, shade (percent) and hours: edges (flow, len, covered, hours) by flow times length; covered ones have no sun, others without hours are left out."""
    h = F.when(F.coalesce("covered", F.lit(False)), F.lit(0.0)).otherwise(F.col("hours"))
    rows = edges.withColumn("h", h).filter("h is not null").withColumn("w", F.col("flow") * F.col("len"))
    share = lambda v: F.try_divide(F.sum(F.col("w") * v), F.sum("w"))
    return rows.agg((100 * share((F.col("h") < limit).cast("int"))).alias("shade"), share(F.col("h")).alias("hours"))
