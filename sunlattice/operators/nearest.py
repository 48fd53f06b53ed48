"""The nearest target of each point, however far: a k-d tree over the targets, searched in tasks."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Targets of a leaf of a task's own tree.
LEAF = 32


class Split:
    """A k-d tree over places (n, 2): nodes are (axis, cut, left, right) or the numbers of a leaf's places."""

    def __init__(self, xy: np.ndarray, leaf: int, depth: int = 64):
        self.xy, self.nodes = xy, []

        def grow(at: np.ndarray, deep: int) -> int:
            me = len(self.nodes)
            self.nodes.append(at)
            own = xy[at]
            if len(at) > leaf and deep:
                axis = int(np.ptp(own, axis=0).argmax())
                cut = float(np.median(own[:, axis]))
                left = own[:, axis] <= cut
                if left.all():
                    left = own[:, axis] < cut
                if left.any():
                    # Whatever is equal to the cut is left of it, in the search as well.
                    cut = float(own[left, axis].max())
                    self.nodes[me] = (axis, cut, grow(at[left], deep - 1), grow(at[~left], deep - 1))
            return me

        grow(np.arange(len(xy)), depth)

    def leaf_of(self, xy: np.ndarray) -> np.ndarray:
        """The node of the leaf that each place falls in."""
        out, todo = np.zeros(len(xy), np.int64), [(0, np.arange(len(xy)))]
        while todo:
            node, at = todo.pop()
            if isinstance(self.nodes[node], tuple):
                axis, cut, left, right = self.nodes[node]
                side = xy[at, axis] <= cut
                todo += [(left, at[side]), (right, at[~side])]
            else:
                out[at] = node
        return out

    def nearest(self, xy: np.ndarray, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Squared distance and id of the nearest place of each of xy; the lower id on a tie. All points go down together."""
        best, found = np.full(len(xy), np.inf), np.full(len(xy), np.iinfo(np.int64).max)

        def look(node: int, at: np.ndarray) -> None:
            if not len(at):
                return
            if isinstance(self.nodes[node], tuple):
                axis, cut, left, right = self.nodes[node]
                away = xy[at, axis] - cut
                near = away <= 0
                for first, other, own, gap in ((left, right, at[near], away[near]), (right, left, at[~near], away[~near])):
                    look(first, own)
                    look(other, own[gap * gap <= best[own]])
                return
            places = self.nodes[node]
            order = places[np.argsort(ids[places])]
            for k in range(0, len(at), 4096):
                own = at[k : k + 4096]
                d2 = ((xy[own, None, :] - self.xy[order][None]) ** 2).sum(2)
                pick = d2.argmin(1)
                least, who = d2[np.arange(len(own)), pick], ids[order][pick]
                better = (least < best[own]) | (least == best[own]) & (who < found[own])
                best[own[better]], found[own[better]] = least[better], who[better]

        look(0, np.arange(len(xy)))
        return best, found


def _there(df: DataFrame, key: str, x: str, y: str) -> DataFrame:
    """Rows with a finite place, as key, x, y."""
    number = lambda c: F.col(c).cast("double")
    fine = lambda c: number(c).isNotNull() & (F.abs(number(c)) < float("inf"))
    return df.filter(fine(x) & fine(y)).select(F.col(key), number(x).alias("x"), number(y).alias("y"))


def _searched(points: DataFrame, targets: DataFrame, chunk: int) -> DataFrame:
    """id, x, y, d2, rid: the nearest target in the cell of each row of points (id, x, y, cell)."""
    asked = points.groupBy("cell").agg(F.ceil(F.count("*") / chunk).alias("chunks"))
    # A cell that very many points ask is searched in several copies.
    own = points.join(asked, "cell").withColumn("chunk", F.pmod(F.xxhash64("x", "y"), F.col("chunks"))).drop("chunks")
    held = targets.join(asked, "cell").withColumn("chunk", F.explode(F.sequence(F.lit(0).cast("long"), F.col("chunks") - 1))).drop("chunks")
    both = held.select("cell", "chunk", F.lit(False).alias("asks"), "x", "y", F.col("rid").alias("key")).unionByName(own.select("cell", "chunk", F.lit(True).alias("asks"), "x", "y", F.col("id").alias("key")))
    dealt = both.repartition("cell", "chunk").sortWithinPartitions("cell", "chunk", "asks")

    def run(batches):
        block, xs, ids, tree = None, [], [], None
        for batch in batches:
            cell, part, asks = (batch.column(k).to_numpy(zero_copy_only=False) for k in range(3))
            xy = np.stack([batch.column(3).to_numpy(), batch.column(4).to_numpy()], axis=1)
            key = batch.column(5).to_numpy()
            new = np.flatnonzero((cell[1:] != cell[:-1]) | (part[1:] != part[:-1]) | (asks[1:] != asks[:-1])) + 1
            for lo, hi in zip([0, *new.tolist()], [*new.tolist(), len(cell)]):
                if (cell[lo], part[lo]) != block:
                    block, xs, ids, tree = (cell[lo], part[lo]), [], [], None
                if not asks[lo]:
                    xs.append(xy[lo:hi]), ids.append(key[lo:hi])
                    continue
                if tree is None:
                    tree, rid = Split(np.concatenate(xs), LEAF), np.concatenate(ids)
                    xs, ids = [], []
                d2, found = tree.nearest(xy[lo:hi], rid)
                yield pa.RecordBatch.from_arrays([pa.array(key[lo:hi]), *(pa.array(c) for c in (xy[lo:hi, 0], xy[lo:hi, 1], d2, found))], ["id", "x", "y", "d2", "rid"])

    return dealt.mapInArrow(run, "id long, x double, y double, d2 double, rid long")


def nearest(points: DataFrame, targets: DataFrame, max_sample: int = 65_536, cell_rows: int = 4096, chunk: int = 1 << 20) -> DataFrame:
    """id, rid, d2: the nearest target (rid, rx, ry) of each point (id, x, y) however far it is; the lower rid on a tie.

    A k-d tree over a bounded sample of the targets deals them to cells; what a cell
    holds is told by the box around it, so the sample bounds nothing but the shape.
    Each point is first searched in the cell whose box is nearest, then in those
    whose boxes are no farther than what was found: two shuffles, however the places
    lie. Targets at one place count once, by their lowest rid.

    Points and targets without a place (null or not finite) are not searched and not
    found; a null id or rid neither. Points that repeat an id give one row, the
    nearest of all. Without targets there are no rows.
    """
    spark = points.sparkSession
    long_ = lambda df, key: df.withColumn(key, F.col(key).cast("long")).filter(F.col(key).isNotNull())
    left = long_(_there(points, "id", "x", "y"), "id")
    right = long_(_there(targets, "rid", "rx", "ry"), "rid").groupBy("x", "y").agg(F.min("rid").alias("rid")).checkpoint()
    total = right.count()
    none = spark.createDataFrame([], "id long, rid long, d2 double")
    if not total:
        return none
    steps = 1 << 30
    share = min(1.0, max_sample / total)
    picked = right.filter(F.pmod(F.xxhash64("x", "y"), F.lit(steps)) < int(share * steps)) if share < 1 else right
    places = np.array(sorted((r.x, r.y) for r in picked.select("x", "y").collect())).reshape(-1, 2)
    upper = Split(places, 1, int(np.ceil(np.log2(max(1, -(-total // cell_rows))))))

    def deal(batches):
        for batch in batches:
            xy = np.stack([batch.column(0).to_numpy(), batch.column(1).to_numpy()], axis=1)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(upper.leaf_of(xy))], ["x", "y", "rid", "cell"])

    dealt = right.mapInArrow(deal, "x double, y double, rid long, cell long").checkpoint()
    # A row a cell.
    boxes = dealt.groupBy("cell").agg(F.min("x"), F.max("x"), F.min("y"), F.max("y")).orderBy("cell").collect()
    cells, box = np.array([r[0] for r in boxes]), np.array([r[1:] for r in boxes])

    def to_boxes(xy: np.ndarray) -> np.ndarray:
        dx = np.maximum(np.maximum(box[:, 0] - xy[:, :1], xy[:, :1] - box[:, 1]), 0)
        dy = np.maximum(np.maximum(box[:, 2] - xy[:, 1:], xy[:, 1:] - box[:, 3]), 0)
        return dx * dx + dy * dy

    def first(batches):
        for batch in batches:
            xy = np.stack([batch.column(1).to_numpy(), batch.column(2).to_numpy()], axis=1)
            own = [to_boxes(xy[k : k + 4096]).argmin(1) for k in range(0, len(xy), 4096)]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(cells[np.concatenate(own)] if own else np.zeros(0, np.int64))], ["id", "x", "y", "cell"])

    def others(batches):
        for batch in batches:
            xy, d2 = np.stack([batch.column(1).to_numpy(), batch.column(2).to_numpy()], axis=1), batch.column(3).to_numpy()
            rows, where = [], []
            for k in range(0, len(xy), 4096):
                far = to_boxes(xy[k : k + 4096])
                far[np.arange(len(far)), far.argmin(1)] = np.inf
                r, c = np.nonzero(far <= d2[k : k + 4096, None])
                rows.append(r + k), where.append(cells[c])
            at = pa.array(np.concatenate(rows) if rows else np.zeros(0, np.int64))
            yield pa.RecordBatch.from_arrays([*(batch.column(k).take(at) for k in range(3)), pa.array(np.concatenate(where) if where else np.zeros(0, np.int64))], ["id", "x", "y", "cell"])

    asks = "id long, x double, y double, cell long"
    near = _searched(left.mapInArrow(first, asks), dealt, chunk).checkpoint()
    more = _searched(near.select("id", "x", "y", "d2").mapInArrow(others, asks), dealt, chunk)
    every = near.select("id", "d2", "rid").unionByName(more.select("id", "d2", "rid"))
    return every.groupBy("id").agg(F.min(F.struct("d2", "rid")).alias("best")).select("id", "best.rid", "best.d2")
