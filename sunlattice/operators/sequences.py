"""Operators whose result depends on the order of rows: drawing objects, stops of one name, stems along lines."""

from __future__ import annotations

import math
from array import array

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sunlattice.functions import geometry
from sunlattice.operators import graph


def polylines(objects: DataFrame, least: int = 3) -> DataFrame:
    """tile, ring, points of drawing objects (tile, pos, kind, x, y) in order of pos.

    A row of kind 'head' opens a ring and closes one that is open, 'vertex' adds
    a point to the open ring, 'end' closes it. Vertices outside a ring, and
    rings with fewer than `least` points, are dropped. A tile is one file of a
    survey.
    """
    order = Window.partitionBy("tile").orderBy("pos")
    kind = F.col("kind")
    opened = F.sum((kind == "head").cast("int")).over(order)
    state = F.last(F.when(kind.isin("head", "end"), kind), ignorenulls=True).over(order)
    inside = objects.withColumn("ring", opened).withColumn("state", state).filter("kind = 'vertex' and state = 'head'")
    rings = inside.groupBy("tile", "ring").agg(F.sort_array(F.collect_list(F.struct("pos", "x", "y"))).alias("points"))
    return rings.filter(F.size("points") >= least)


def cluster_named(stops: DataFrame, radius: float) -> DataFrame:
    """name, cluster, x, y, n: stops (id, name, x, y) of one name merged in order of id.

    A stop joins the first cluster of its name whose centre, the mean of its
    members so far, is nearer than the radius; else it begins one, named by its
    id. Names are dealt over tasks and rows stream past in order, so a task holds
    the clusters of one name, not its stops. Null names are one name; stops
    without a place are dropped.
    """
    placed = stops.filter("x is not null and y is not null")
    dealt = placed.repartition("name").sortWithinPartitions("name", "id").select("id", "name", "x", "y")

    def run(frames):
        name, found, xs, ys = run, [], array("d"), array("d")  # no name is equal to a function
        for pdf in frames:
            of = []
            for r in pdf.itertuples(index=False):
                own = r.name if isinstance(r.name, str) else None
                if own != name:
                    name, found, xs, ys = own, [], array("d"), array("d")
                # A look at all centres at once, a little wide, then the exact one at those near in their order.
                near = range(len(found))
                if len(found) > 32:
                    near = np.flatnonzero((np.frombuffer(xs) - r.x) ** 2 + (np.frombuffer(ys) - r.y) ** 2 < radius * radius * (1 + 1e-9)).tolist()
                for k in near:
                    c = found[k]
                    if math.hypot(xs[k] - r.x, ys[k] - r.y) < radius:
                        c[1] += 1
                        xs[k] += (r.x - xs[k]) / c[1]
                        ys[k] += (r.y - ys[k]) / c[1]
                        break
                else:
                    c = [r.id, 1]
                    found.append(c)
                    xs.append(r.x), ys.append(r.y)
                of.append(c[0])
            yield pd.DataFrame({"id": pdf["id"], "name": pdf["name"], "cluster": of, "x": pdf["x"], "y": pdf["y"]})

    rows = dealt.mapInPandas(run, "id long, name string, cluster long, x double, y double")
    return rows.groupBy("name", "cluster").agg(F.avg("x").alias("x"), F.avg("y").alias("y"), F.count("*").alias("n"))


def stems(segments: DataFrame, spacing: float) -> DataFrame:
    """id, k, x, y: points from the start of each segment (id, ax, ay, bx, by), a spacing apart, its end excluded.

    A segment without length has none.
    """
    dx, dy = F.col("bx") - F.col("ax"), F.col("by") - F.col("ay")
    rows = segments.withColumn("len", F.sqrt(dx * dx + dy * dy)).filter("len > 0")
    rows = rows.withColumn("k", F.explode(F.sequence(F.lit(0).cast("long"), F.ceil(F.col("len") / spacing) - 1)))
    t = F.col("k") * spacing / F.col("len")
    return rows.select("id", "k", (F.col("ax") + t * dx).alias("x"), (F.col("ay") + t * dy).alias("y"))


def chain_rings(lines: DataFrame, least: float = 1.0, most: float = 60_000.0) -> DataFrame:
    """tile, class, ring of closed rings from boundary lines (tile, class, pos, points), with areas between the limits.

    A line of four points or more that ends where it begins is a ring. Others
    are followed from the first in order of pos: what comes next is the first
    unused line that touches the end, either way round, until the chain closes
    or none is left. Lines that touch are one connected part, found in Spark, and
    parts are chained in parallel: a task holds one part's lines, not a tile's.
    Rings leave out the last point. Null or empty lines give nothing.
    """
    p, n = F.col("points"), F.size("points")
    rows = lines.filter("points is not null and size(points) >= 2")
    end = lambda q: F.concat_ws("|", F.col("tile").cast("string"), F.col("class").cast("string"), q.x.cast("string"), q.y.cast("string"))
    rows = rows.withColumn("a", end(p[0])).withColumn("b", end(F.element_at(p, -1)))
    whole = (n >= 4) & (F.col("a") == F.col("b"))
    closed = rows.filter(whole).select("tile", "class", F.slice("points", F.lit(1), n - 1).alias("ring"))
    loose = rows.filter(~whole).checkpoint()
    part = graph.components(loose.select("a", "b").distinct()).select(F.col("node").alias("a"), "label")

    def chain(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("pos")
        paths = [[(q["x"], q["y"]) for q in points] for points in pdf["points"]]
        touching: dict[tuple, list[int]] = {}
        for k, path in enumerate(paths):
            for corner in {path[0], path[-1]}:
                touching.setdefault(corner, []).append(k)
        free, rings = dict.fromkeys(range(len(paths))), []
        while free:
            first = next(iter(free))
            del free[first]
            ring = list(paths[first])
            while ring[0] != ring[-1]:
                after = next((k for k in touching[ring[-1]] if k in free), None)
                if after is None:
                    break
                del free[after]
                step = paths[after] if paths[after][0] == ring[-1] else paths[after][::-1]
                ring.extend(step[1:])
            if len(ring) >= 4 and ring[0] == ring[-1]:
                rings.append(ring[:-1])
        out = {c: [pdf[c].iloc[0]] * len(rings) for c in ("tile", "class")} | {c: [[p[k] for p in r] for r in rings] for k, c in enumerate("xy")}
        # As objects, so that empty columns have no type of their own.
        return pd.DataFrame(out, dtype=object)

    types = {f.name: f.dataType.simpleString() for f in lines.schema.fields}
    grouped = loose.join(part, "a").select("label", "tile", "class", "pos", "points").groupBy("label")
    chained = grouped.applyInPandas(chain, f"tile {types['tile']}, class {types['class']}, x array<double>, y array<double>").select("tile", "class", F.arrays_zip("x", "y").alias("ring"))
    area = F.abs(geometry.signed_area(F.col("ring")))
    return closed.union(chained).filter(area.between(least, most))
