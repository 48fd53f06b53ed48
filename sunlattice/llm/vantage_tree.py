"""Hard negatives by vantage-point trees over norm-augmented vectors.

Components become integers, scores are integer inner products. With one more
component, sqrt(M^2 - |x|^2) for rows and 0 for queries (M: the largest norm),
the squared distance of a query q to a row x is |q|^2 + M^2 - 2 * score: the best
score is the nearest row, and a window of scores is an annulus of distances.

The index has two levels. A tree over a bounded sample (`max_sample` rows, at most
`max_cells` leaves) divides the space into cells, of which the driver keeps for
each vantage point above a cell the least and largest distance of its rows. A
cell's rows are dealt by hash to blocks of about `block` rows, so a cell of very many
equal or near vectors is several blocks, and a task builds a tree of its own over
each block that a query goes to. Every row is in one block: the sample bounds
nothing but the shape of the cells.

Two searches, each one shuffle of rows and queries by block: first the positives
(rows of the anchor's label, nearest first), then for each positive the rows of
other labels within its annulus, nearest first. A query goes to the cells that may
hold a better row than the k-th best of the sample, which is exact. In a block the
traversal is incremental and takes a run of queries together: each query looks at its
leaves by their least possible distance, at one, then as many again as it has seen,
and a leaf's scores with all queries that look at it are one product. A query stops
where no leaf left may hold a better row than its k-th best. A block with more than
`chunk` queries is searched in as many copies as it takes.

Null ids, labels or vectors and vectors with a null or non-finite component take no
part. Rows that repeat id, label and vector are one row; different rows with one id
are rows of their own. A vector that is shorter than others ends in zeros; an empty
one scores 0 with all. Equal scores are ordered by id. Empty tables give no rows,
and an anchor without positives or without negatives in a window gives none. Other
columns play no part. Components must fit 32 bits and scores 64 bits once they are
integers, or the search raises an error.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sunlattice.llm.common import buffers, discard, prepare, saved

#: Rows of a leaf of a block's tree, and candidates for a vantage point.
LEAF, TRIED = 128, 5
#: Distances are compared with this slack, so rounding never drops a row.
SLACK = 1e-6
#: Queries of a block that are searched together, and scores that are looked at at once.
RUN, AT_ONCE = 512, 1 << 20
#: Beyond every score: a window without an end.
OPEN = 2**62


def _scores(x: np.ndarray, q: np.ndarray) -> np.ndarray:
    """Exact inner products of integer rows with an integer vector."""
    if not x.size:
        return np.zeros(len(x), np.int64)
    most = float(np.abs(x).max()) * float(np.abs(q).max()) * len(q)
    if most >= 2**62:
        raise ValueError("scores do not fit 64 bits")
    return (x @ q).astype(np.int64) if most < 2**53 else x.astype(np.int64) @ q.astype(np.int64)


def _products(x: np.ndarray, q: np.ndarray, most: float | None = None) -> np.ndarray:
    """The same of many vectors, a row each; `most` is no less than any product of two components."""
    if not x.size or not q.size:
        return np.zeros((len(q), len(x)), np.int64)
    if most is None:
        most = float(np.abs(x).max()) * float(np.abs(q).max())
    # Whole numbers of doubles; larger ones are looked at vector by vector.
    return q @ x.T if most * x.shape[1] < 2**53 else np.array([_scores(x, row) for row in q])


def _away(whole: np.ndarray, score: np.ndarray) -> np.ndarray:
    return np.sqrt(np.maximum(whole - 2.0 * score, 0))


def _augmented(x: np.ndarray, top: float) -> np.ndarray:
    rest = np.sqrt(np.maximum(top - (x * x).sum(1), 0))
    return np.concatenate([x, rest[:, None]], axis=1)


def _vantage(x: np.ndarray, rng: np.random.Generator) -> tuple[int, np.ndarray]:
    """Of a few rows the one with the widest spread of distances, and these."""
    best = None
    for at in rng.choice(len(x), min(TRIED, len(x)), replace=False):
        d = np.sqrt(((x - x[at]) ** 2).sum(1))
        if best is None or d.std() > best[1].std():
            best = (int(at), d)
    return best


class Tree:
    """A vantage-point tree over integer rows (n, dim), `top` being the largest squared norm of all rows."""

    def __init__(self, x: np.ndarray, top: float, leaf: int = LEAF, depth: int = 64):
        rng = np.random.default_rng(len(x))
        self.top, self.x = top, x
        self.widest = float(np.abs(x).max()) if x.size else 0.0
        wide = _augmented(x, top)
        #: A node: (number of vantage, inner child with least and largest distance, outer child likewise), or the rows of a leaf.
        self.nodes: list[tuple | np.ndarray] = []
        self.cuts: list[float] = []
        vantages: list[np.ndarray] = []

        def grow(rows: np.ndarray, deep: int) -> int:
            me = len(self.nodes)
            self.nodes.append(rows)
            self.cuts.append(0.0)
            if len(rows) <= leaf or deep == 0:
                return me
            at, d = _vantage(wide[rows], rng)
            cut = float(np.median(d))
            inner = d <= cut
            if inner.all():
                inner = d < cut
            if not inner.any():
                return me
            v = len(vantages)
            vantages.append(wide[rows[at]])
            self.cuts[me] = float(d[inner].max())
            ends = [(float(d[m].min()), float(d[m].max())) for m in (inner, ~inner)]
            below = [grow(rows[m], deep - 1) for m in (inner, ~inner)]
            self.nodes[me] = (v, *[(b, *e) for b, e in zip(below, ends)])
            return me

        if len(x):
            grow(np.arange(len(x)), depth)
        self.vantages = np.array(vantages) if vantages else np.zeros((0, x.shape[1] + 1))

    def far(self, q: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """|q|^2 + M^2 of each query, and its distances to all vantage points."""
        whole = (q * q).sum(1) + self.top
        return whole, _away(whole[:, None], q @ self.vantages[:, :-1].T)

    def reach(self, away: np.ndarray) -> tuple[list[int], np.ndarray, np.ndarray]:
        """The leaves, and the least and largest possible distance of each query to their rows."""
        leaves, least, most = [], [], []
        todo = [(0, np.zeros(len(away)), np.full(len(away), np.inf))] if self.nodes else []
        while todo:
            node, low, high = todo.pop()
            if not isinstance(self.nodes[node], tuple):
                leaves.append(node), least.append(low), most.append(high)
                continue
            d = away[:, self.nodes[node][0]]
            for child, lo, hi in self.nodes[node][1:]:
                todo.append((child, np.maximum(low, np.maximum(lo - d, d - hi) - SLACK), np.minimum(high, d + hi)))
        none = np.zeros((len(away), 0))
        return leaves, np.stack(least, 1) if leaves else none, np.stack(most, 1) if leaves else none

    def cell_of(self, x: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray]:
        """The leaf's node of each row, and its distances to the vantage points above (`most` columns, NaN beyond)."""
        wide = _augmented(x, self.top)
        cell, path = np.zeros(len(x), np.int64), np.full((len(x), most), np.nan)
        todo = [(0, np.arange(len(x)), 0)] if len(x) and self.nodes else []
        while todo:
            node, rows, deep = todo.pop()
            if not isinstance(self.nodes[node], tuple):
                cell[rows] = node
                continue
            v, (inner, *_), (outer, *_) = self.nodes[node]
            d = np.sqrt(((wide[rows] - self.vantages[v]) ** 2).sum(1))
            path[rows, deep] = d
            side = d <= self.cuts[node]
            todo += [(inner, rows[side], deep + 1), (outer, rows[~side], deep + 1)]
        return cell, path

    def paths(self) -> dict[int, list[int]]:
        """Vantage points above each leaf, from the root."""
        out, todo = {}, [(0, [])] if self.nodes else []
        while todo:
            node, above = todo.pop()
            if isinstance(self.nodes[node], tuple):
                todo += [(child, [*above, self.nodes[node][0]]) for child, *_ in self.nodes[node][1:]]
            else:
                out[node] = above
        return out


class View:
    """What a run of queries (n, dim) sees of a tree; `accepted` (n, rows) are the rows that each may find. Rows are in the order of ids."""

    def __init__(self, tree: Tree, q: np.ndarray, ids: np.ndarray, accepted: np.ndarray, k: int):
        self.tree, self.q, self.ids, self.k = tree, np.atleast_2d(q), ids, k
        self.accepted = np.atleast_2d(accepted)
        self.whole, away = tree.far(self.q)
        self.leaves, self.least, self.most = tree.reach(away)
        self.widest = tree.widest * (float(np.abs(self.q).max()) if self.q.size else 0.0)
        #: Leaves that a query has looked at: (query, leaf).
        self.seen: set[tuple[int, int]] = set()

    def best(self, low: int | None = None, high: int | None = None) -> list[tuple[int, int, int]]:
        """(score, id, row) of the first query's best rows with low <= score <= high, by falling score and then id."""
        n = len(self.q)
        ask, score, row = self.nearest(np.full((n, 1), -OPEN if low is None else low), np.full((n, 1), OPEN if high is None else high))
        return [(int(s), int(self.ids[r]), int(r)) for a, s, r in zip(ask, score, row) if a == 0]

    def nearest(self, low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Ask, score and row of the k best rows of each ask, by ask, falling score and then id.

        low, high: (n, asks) windows of scores, asks being numbered row by row. A window with low > high finds nothing.
        """
        whole = self.whole[:, None]
        # Only a row before these, of a score or row number, is of use: the window's end, then the k-th best.
        floor, floor_row = low.astype(np.int64), np.full(low.shape, len(self.tree.x))
        near = np.where(high >= OPEN, 0, _away(whole, high) - SLACK)
        # The place of each leaf in a query's order.
        place = np.argsort(np.argsort(self.least, axis=1, kind="stable"), axis=1)
        best, start, stop = [np.zeros(0, np.int64)] * 3, 0, 1
        while start < len(self.leaves):
            rim = np.where(floor <= -OPEN, np.inf, _away(whole, floor) + SLACK)
            rim[low > high] = -np.inf
            inside = (place >= start) & (place < stop) & (self.least <= rim.max(1, keepdims=True))
            if not inside.any() and not (self.least <= rim.max(1, keepdims=True))[place >= stop].any():
                break
            pending = [best]
            for leaf in np.flatnonzero(inside.any(0)):
                at = np.flatnonzero(inside[:, leaf])
                at = at[((self.least[at, leaf, None] <= rim[at]) & (self.most[at, leaf, None] >= near[at])).any(1)]
                if not len(at):
                    continue
                self.seen.update((int(i), self.leaves[leaf]) for i in at)
                rows = self.tree.nodes[self.leaves[leaf]]
                step = max(LEAF, AT_ONCE // (len(at) * low.shape[1]))
                for lo in range(0, len(rows), step):
                    pending += self._found(at, rows[lo : lo + step], floor, floor_row, high)
                    if sum(len(p[0]) for p in pending) > AT_ONCE:
                        pending = [self._kept(pending, floor, floor_row)]
            best = self._kept(pending, floor, floor_row)
            start, stop = stop, 2 * stop
        return tuple(best)

    def _found(self, at: np.ndarray, rows: np.ndarray, floor: np.ndarray, floor_row: np.ndarray, high: np.ndarray) -> list[list[np.ndarray]]:
        """For each ask of the queries `at`: asks, scores and numbers of the rows that may be among its best."""
        scores = _products(self.tree.x[rows], self.q[at], self.widest)
        i, r = np.nonzero(scores >= floor[at].min(1, keepdims=True).astype(scores.dtype))
        scores, query, row = scores[i, r].astype(np.int64), at[i], rows[r]
        ok = self.accepted[query, row] if len(self.accepted) > 1 else self.accepted[0, row]
        scores, query, row = scores[ok], query[ok], row[ok]
        out = []
        for ask in range(high.shape[1]):
            least = floor[query, ask]
            ok = (scores <= high[query, ask]) & ((scores > least) | ((scores == least) & (row < floor_row[query, ask])))
            out.append([query[ok] * high.shape[1] + ask, scores[ok], row[ok]])
        return out

    def _kept(self, found: list[list[np.ndarray]], floor: np.ndarray, floor_row: np.ndarray) -> list[np.ndarray]:
        """The k best of each ask; `floor` and `floor_row` become the k-th."""
        ask, score, row = (np.concatenate(c) for c in zip(*found))
        order = np.lexsort((row, -score, ask))
        ask, score, row = ask[order], score[order], row[order]
        rank = np.arange(len(ask)) - np.searchsorted(ask, ask)
        last = rank == self.k - 1
        floor.flat[ask[last]], floor_row.flat[ask[last]] = score[last], row[last]
        return [c[rank < self.k] for c in (ask, score, row)]


def integers(vectors: DataFrame, scale: int = 256) -> DataFrame:
    """vec_id, key (hash of label and vector), label, vec (32-bit integers), dim, norm (squared) of the rows that take part, from vec_id, label, embedding."""
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("label").cast("long").alias("label"), F.col("embedding").cast("array<double>").alias("embedding")).na.drop()

    def run(batches):
        for batch in batches:
            lists = batch.column(2)
            size = lists.value_lengths().to_numpy().astype(np.int64)
            flat = lists.flatten()
            x = np.floor(scale * flat.to_numpy(zero_copy_only=False).astype(np.float64))
            row = np.repeat(np.arange(len(size)), size)
            bad = np.bincount(row, ~np.isfinite(x), len(size)) > 0
            keep = np.flatnonzero(~bad)
            off = np.concatenate([[0], np.cumsum(size)])
            if (np.abs(x[~bad[row]]) >= 2**31).any():
                raise ValueError("components do not fit 32 bits")
            norm = np.bincount(row, np.where(bad[row], 0, x) ** 2, len(size))
            x = np.where(bad[row], 0, x).astype("<i4")
            where = pa.array(keep)
            columns = [batch.column(0).take(where), batch.column(1).take(where), pa.array([x[off[k] : off[k + 1]].tobytes() for k in keep], pa.binary()), pa.array(size[keep].astype(np.int32)), pa.array(norm[keep])]
            yield pa.RecordBatch.from_arrays(columns, ["vec_id", "label", "vec", "dim", "norm"])

    out = rows.mapInArrow(run, "vec_id long, label long, vec binary, dim int, norm double")
    return out.select("vec_id", F.xxhash64("label", "vec").alias("key"), "label", "vec", "dim", "norm")


def _matrix(column: pa.Array | pa.ChunkedArray, dim: int) -> np.ndarray:
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    data, off = buffers(column)
    if (np.diff(off) == 4 * dim).all():
        return data[off[0] : off[-1]].view("<i4").reshape(len(column), dim).astype(np.float64)
    out = np.zeros((len(column), dim))
    for k, (lo, hi) in enumerate(zip(off[:-1], off[1:])):
        out[k, : (hi - lo) // 4] = data[lo:hi].view("<i4")
    return out


class Cells:
    """The upper tree with what is known of all rows of its cells, and the sample it comes from."""

    def __init__(self, tree: Tree, ids: np.ndarray, keys: np.ndarray, labels: np.ndarray):
        self.tree, self.ids, self.keys, self.labels = tree, ids, keys, labels
        self.above = tree.paths()
        self.depth = max(map(len, self.above.values()), default=0)
        self.cells: list[int] = []

    def bound(self, stats) -> None:
        """stats: rows with cell, n and the least and largest distances lo0, hi0, lo1, ..."""
        self.cells = [r.cell for r in stats]
        n = len(self.cells)
        self.vantage = np.zeros((n, self.depth), np.int64)
        self.low, self.high = np.zeros((n, self.depth)), np.full((n, self.depth), np.inf)
        for k, r in enumerate(stats):
            for deep, v in enumerate(self.above[r.cell]):
                self.vantage[k, deep], self.low[k, deep], self.high[k, deep] = v, r[f"lo{deep}"], r[f"hi{deep}"]

    def reach(self, away: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Least and largest possible distance of a query to the rows of each cell."""
        if not self.depth:
            return np.zeros(len(self.cells)), np.full(len(self.cells), np.inf)
        d = away[self.vantage]
        return np.maximum(np.maximum(self.low - d, d - self.high).max(1), 0) - SLACK, (d + self.high).min(1) + SLACK


def _sampled(rows: DataFrame, total: int, dim: int, top: float, max_sample: int, max_cells: int, cell_rows: int) -> Cells:
    share = min(1.0, max_sample / max(total, 1))
    steps = 1 << 30
    picked = rows.filter(F.pmod(F.xxhash64("vec_id", "key"), F.lit(steps)) < int(share * steps)) if share < 1 else rows
    found = picked.select("vec_id", "key", "label", "vec").toArrow().combine_chunks()
    order = np.lexsort((found["key"].to_numpy(), found["vec_id"].to_numpy()))
    found = found.take(pa.array(order))
    depth = int(np.ceil(np.log2(min(max_cells, max(1, -(-total // cell_rows))))))
    tree = Tree(_matrix(found["vec"], dim), top, 1, depth)
    return Cells(tree, found["vec_id"].to_numpy(), found["key"].to_numpy(), found["label"].to_numpy())


_ANCHOR = "vec_id long, key long, label long, vec binary"
_WANT = "pos_id long, pos_key long, pos_score long, low long"


def _sent_to(anchors: DataFrame, cells: Cells, dim: int, k: int, window: tuple[int, int] | None) -> DataFrame:
    """Anchors by cell that they must be searched in, with the least score of use; with `window`, with the positives that ask for it."""
    shared = anchors.sparkSession.sparkContext.broadcast(cells)

    def run(batches):
        c: Cells = shared.value
        step = max(1, AT_ONCE // max(1, len(c.ids)))
        for batch in batches:
            x = _matrix(batch.column(3), dim)
            at, cell, wants = [], [], []
            whole_of, away = c.tree.far(x)
            for row in range(len(x)):
                if row % step == 0:
                    known_of = _products(c.tree.x, x[row : row + step])
                known, whole, me, key, label = known_of[row % step], whole_of[row], batch.column(0)[row].as_py(), batch.column(1)[row].as_py(), batch.column(2)[row].as_py()
                least, most = c.reach(away[row])
                if window is None:
                    own = known[(c.labels == label) & ~((c.ids == me) & (c.keys == key))]
                    low = int(np.partition(own, -k)[-k]) if len(own) >= k else None
                    rim = np.inf if low is None else _away(whole, low) + SLACK
                    for place in np.flatnonzero(least <= rim):
                        at.append(row), cell.append(c.cells[place]), wants.append([{"low": low}])
                    continue
                other, asked = known[c.labels != label], [[] for _ in c.cells]
                for p in batch.column(4)[row].as_py():
                    high = p["pos_score"]
                    low = -(-window[0] * high // window[1])
                    inside = other[(other >= low) & (other <= high)]
                    if len(inside) >= k:
                        low = int(np.partition(inside, -k)[-k])
                    if low > high:
                        continue
                    near, rim = _away(whole, high) - SLACK, _away(whole, low) + SLACK
                    for place in np.flatnonzero((least <= rim) & (most >= near)):
                        asked[place].append({**p, "low": low})
                for place, own in enumerate(asked):
                    if own:
                        at.append(row), cell.append(c.cells[place]), wants.append(own)
            kind = pa.list_(pa.struct([(w.split()[0], pa.int64()) for w in _WANT.split(", ")]))
            where = pa.array(at, pa.int64())
            yield pa.RecordBatch.from_arrays([*(batch.column(i).take(where) for i in range(4)), pa.array(cell, pa.int64()), pa.array(wants, kind)], ["vec_id", "key", "label", "vec", "cell", "wants"])

    return anchors.mapInArrow(run, f"{_ANCHOR}, cell long, wants array<struct<{_WANT.replace(' long', ': long')}>>")


def _searched(rows: DataFrame, sent: DataFrame, parts: DataFrame, dim: int, top: float, k: int, chunk: int, same: bool) -> DataFrame:
    """For each anchor, block and want its k best rows, of the anchor's label if `same` and of others if not."""
    sent = sent.join(F.broadcast(parts), "cell").withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1))).drop("parts")
    sent = saved(sent, "anchors-sent")
    asked = sent.groupBy("cell", "part").agg(F.ceil(F.count("*") / chunk).cast("int").alias("chunks"))
    queries = sent.join(asked, ["cell", "part"]).withColumn("chunk", F.pmod(F.xxhash64("vec_id", "key"), F.col("chunks")).cast("int"))
    found = rows.join(asked, ["cell", "part"]).withColumn("chunk", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)))
    columns = ["cell", "part", "chunk", "query", "vec_id", "key", "label", "vec"]
    one = found.withColumn("query", F.lit(False)).select(*columns, F.lit(None).cast(sent.schema["wants"].dataType).alias("wants"))
    both = one.unionByName(queries.withColumn("query", F.lit(True)).select(*columns, "wants"))
    dealt = both.repartition("cell", "part", "chunk").sortWithinPartitions("cell", "part", "chunk", "query", "vec_id", "key")

    def run(batches):
        block, held, tree = None, [], None
        for batch in batches:
            if not len(batch):
                continue
            names = np.stack([batch.column(i).to_numpy(zero_copy_only=False).astype(np.int64) for i in range(4)], 1)
            edges = [0, *(np.flatnonzero((names[1:] != names[:-1]).any(1)) + 1).tolist(), len(names)]
            for lo, hi in zip(edges, edges[1:]):
                if block != (name := tuple(names[lo, :3])):
                    block, held, tree = name, [], None
                if not names[lo, 3]:
                    held.append(batch.slice(lo, hi - lo))
                    continue
                if tree is None:
                    tree = _block(held, dim, top)
                    held = []
                for at in range(lo, hi, RUN):
                    yield _answers(*tree, batch.slice(at, min(RUN, hi - at)), dim, k, same)

    return dealt.mapInArrow(run, _FOUND)


_FOUND = "vec_id long, key long, pos_id long, pos_key long, pos_score long, found_id long, found_key long, score long"


def _block(held: list[pa.RecordBatch], dim: int, top: float) -> tuple[Tree, np.ndarray, np.ndarray, np.ndarray]:
    """Tree, ids, keys and labels of a block's rows, in the order of ids and keys; repeated rows once."""
    pieces = pa.Table.from_batches(held).combine_chunks() if held else None
    if pieces is None:
        return Tree(np.zeros((0, dim)), top), *(np.zeros(0, np.int64) for _ in range(3))
    ids, keys = pieces["vec_id"].to_numpy(), pieces["key"].to_numpy()
    new = np.ones(len(ids), bool)
    new[1:] = (ids[1:] != ids[:-1]) | (keys[1:] != keys[:-1])
    return Tree(_matrix(pieces["vec"].filter(pa.array(new)), dim), top), ids[new], keys[new], pieces["label"].to_numpy()[new]


def _answers(tree: Tree, ids, keys, labels, asking: pa.RecordBatch, dim: int, k: int, same: bool) -> pa.RecordBatch:
    """What a run of queries finds in a block."""
    me, key, label = (asking.column(i).to_numpy() for i in (4, 5, 6))
    wants = asking.column(8)
    of = np.repeat(np.arange(len(me)), wants.value_lengths().to_numpy())
    wants = wants.flatten()
    first = np.searchsorted(of, of)
    ask = np.arange(len(of)) - first
    shape = (len(me), int(ask.max(initial=0)) + 1)
    low, high, want = np.full(shape, OPEN), np.full(shape, -OPEN), np.full(shape, -1)
    low[of, ask] = wants.field("low").fill_null(-OPEN).to_numpy()
    high[of, ask] = wants.field("pos_score").fill_null(OPEN).to_numpy()
    want[of, ask] = np.arange(len(of))
    accepted = labels == label[:, None]
    accepted = accepted & ~((ids == me[:, None]) & (keys == key[:, None])) if same else ~accepted
    found, score, row = View(tree, _matrix(asking.column(7), dim), ids, accepted, k).nearest(low, high)
    query, where = found // shape[1], pa.array(want.ravel()[found])
    positive = [wants.field(c).take(where) for c in ("pos_id", "pos_key", "pos_score")]
    return pa.RecordBatch.from_arrays([pa.array(me[query]), pa.array(key[query]), *positive, pa.array(ids[row]), pa.array(keys[row]), pa.array(score)], [c.split()[0] for c in _FOUND.split(", ")])


def mine(vectors: DataFrame, anchors, positives: int = 5, negatives: int = 5, window: tuple[int, int] = (80, 100), scale: int = 256, max_sample: int = 16_384, max_cells: int = 1024, cell_rows: int = 4096, block: int | None = None, chunk: int = 16_384) -> DataFrame:
    """anchor_id, positive_id, rank (from 1), negative_id, positive_score, negative_score.

    vectors: vec_id, label, embedding. anchors: a boolean column over vec_id, the rows that are queries.
    For each anchor and each of its `positives` best rows of the same label: the
    `negatives` best of another label whose score is at most the positive's and at
    least window[0] / window[1] of it.
    """
    prepare(vectors.sparkSession)
    rows = saved(integers(vectors, scale), "vectors")
    size = rows.agg(F.count("*").alias("n"), F.max("dim").alias("dim"), F.max("norm").alias("top")).first()
    total, dim, top = size.n, size.dim or 0, size.top or 0.0
    cells = _sampled(rows, total, dim, top, max_sample, max_cells, cell_rows)
    block = block or min(65_536, max(512, -(-total // 64)))

    depth, tree = cells.depth, vectors.sparkSession.sparkContext.broadcast(cells.tree)

    def route(batches):
        for batch in batches:
            cell, path = tree.value.cell_of(_matrix(batch.column(3), dim), depth)
            lists = pa.ListArray.from_arrays(np.arange(len(cell) + 1, dtype=np.int32) * depth, pa.array(path.ravel()))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(cell), lists], ["vec_id", "key", "label", "vec", "cell", "path"])

    placed = saved(rows.select("vec_id", "key", "label", "vec").mapInArrow(route, f"{_ANCHOR}, cell long, path array<double>"), "vectors-placed")
    ends = [x for deep in range(depth) for x in (F.min(F.get("path", F.lit(deep))).alias(f"lo{deep}"), F.max(F.get("path", F.lit(deep))).alias(f"hi{deep}"))]
    # A row a cell.
    stats = placed.groupBy("cell").agg(F.count("*").alias("n"), *ends).orderBy("cell").collect()
    cells.bound(stats)
    parts = vectors.sparkSession.createDataFrame([(r.cell, -(-r.n // block)) for r in stats], "cell long, parts int")
    in_part = F.pmod(F.xxhash64("vec_id", "key"), F.col("parts")).cast("int").alias("part")
    dealt = placed.drop("path").join(F.broadcast(parts), "cell").select("cell", in_part, "vec_id", "key", "label", "vec")

    asking = saved(placed.filter(anchors).select("vec_id", "key", "label", "vec").dropDuplicates(["vec_id", "key"]), "anchors")
    best = lambda keys: Window.partitionBy(*keys).orderBy(F.desc("score"), "found_id", "found_key")
    own = ["vec_id", "key"]
    near = _searched(dealt, _sent_to(asking, cells, dim, positives, None), parts, dim, top, positives, chunk, True)
    near = near.withColumn("rank", F.row_number().over(best(own))).filter(F.col("rank") <= positives)
    # At most `positives` a row.
    lists = near.groupBy(*own).agg(F.collect_list(F.struct(F.col("found_id").alias("pos_id"), F.col("found_key").alias("pos_key"), F.col("score").alias("pos_score"))).alias("found"))
    again = saved(asking.join(lists, own).select("vec_id", "key", "label", "vec", "found"), "anchors-found")
    hard = _searched(dealt, _sent_to(again, cells, dim, negatives, window), parts, dim, top, negatives, chunk, False)
    hard = hard.withColumn("rank", F.row_number().over(best([*own, "pos_id", "pos_key"]))).filter(F.col("rank") <= negatives)
    out = saved(hard.select(F.col("vec_id").alias("anchor_id"), F.col("pos_id").alias("positive_id"), "rank", F.col("found_id").alias("negative_id"), F.col("pos_score").alias("positive_score"), F.col("score").alias("negative_score")), "negatives")
    discard(rows, placed, asking, again)
    return out
