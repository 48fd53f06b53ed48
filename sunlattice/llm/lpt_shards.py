"""Sharding by longest-processing-time scheduling.

Documents with equal texts form a group that stays together. All groups, sorted
by size, go one by one to the least-loaded shard through a heap. Groups of equal
size are interchangeable, so the driver only needs how many groups have each
size: at most sqrt(2 x all bytes) numbers, as different sizes add up at least so
fast. A run of many equal sizes is dealt in closed form, with the result that the
heap would give. Within a run, groups are numbered in order of their hash (by
ranges, none of which needs the others' rows), and their number says the shard.

A shard's load differs from another's by no more than the last group it got.

Slots number the rows of each shard without gaps in order of doc_id: rows are
dealt by ranges of (shard, doc_id), numbered within each range, and a range's
first number comes from the counts of the ranges before it.

A null text has size 1 and is grouped with empty texts; null ids come first in
their shard; repeated rows get a slot each. Very long texts are only measured and
hashed. A group too large for an even split stays whole. Empty tables give an
empty result; other columns are ignored.
"""

from __future__ import annotations

import heapq
from itertools import groupby

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sunlattice.llm.common import discard, saved


def deal(runs: list[tuple[int, int]], shards: int) -> list[list[int]]:
    """How many groups of each run (size, count) go to each shard: by falling size, each group to the shard with the least load, the first of equals."""
    loads, out = [0] * shards, []
    for size, count in sorted(runs, reverse=True):
        given = _few(loads, size, count) if count <= 4 * shards else _many(loads, size, count)
        out.append(given)
        loads = [load + size * n for load, n in zip(loads, given)]
    return out


def _few(loads: list[int], size: int, count: int) -> list[int]:
    heap = [(load, s) for s, load in enumerate(loads)]
    heapq.heapify(heap)
    given = [0] * len(loads)
    for _ in range(count):
        load, s = heap[0]
        given[s] += 1
        heapq.heapreplace(heap, (load + size, s))
    return given


def _many(loads: list[int], size: int, count: int) -> list[int]:
    """As the heap: of all loads that a shard has before one more group, the `count` least ones, earlier shards first."""

    def upto(most: int) -> list[int]:
        return [max(0, (most - load) // size + 1) for load in loads]

    low, high = min(loads), max(loads) + size * count
    while low < high:
        mid = (low + high) // 2
        if sum(upto(mid)) >= count:
            high = mid
        else:
            low = mid + 1
    given = upto(low - 1)
    left = count - sum(given)
    for s, load in enumerate(loads):
        if left and load <= low and (low - load) % size == 0:
            given[s] += 1
            left -= 1
    return given


def schedule(units: list[tuple[int, int]], shards: int) -> dict[int, int]:
    """Shard of each unit (id, size)."""
    runs = [(size, [u for u, _ in same]) for size, same in groupby(sorted(units, key=lambda u: (-u[1], u[0])), key=lambda u: u[1])]
    given = deal([(size, len(ids)) for size, ids in runs], shards)
    return {u: s for (_, ids), n in zip(runs, given) for u, s in zip(ids, (s for s, k in enumerate(n) for _ in range(k)))}


def assign(docs: DataFrame, shards: int = 16, hot: int = 4096) -> DataFrame:
    """doc_id, size, text_crc32, shard of each row of docs (doc_id, text).

    Groups with one in `hot` of all rows or more are sent to all executors (there
    are at most `hot` such), so no task gets all their rows; the rest is joined by group.
    """
    spark = docs.sparkSession
    text = F.coalesce("text", F.lit(""))
    rows = docs.select("doc_id", (F.octet_length(text) + 1).cast("long").alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"), F.unhex(F.sha2(text, 256)).alias("group"))
    rows = saved(rows, "shard-sizes")
    total = rows.count()
    groups = saved(slots(rows.groupBy("group").agg(F.sum("size").alias("whole"), F.count("*").alias("copies")), "whole", ["group"]), "shard-groups")
    runs = sorted(((r.whole, r.n) for r in groups.groupBy("whole").agg(F.count("*").alias("n")).collect()), reverse=True)
    # A row for each size: up to which number its groups go to each shard.
    upto = [(size, np.cumsum(n).tolist()) for (size, _), n in zip(runs, deal(runs, shards))]
    plan = spark.createDataFrame(upto, "whole long, upto array<long>")
    placed = groups.join(plan, "whole").select("group", "copies", F.size(F.filter("upto", lambda x: x <= F.col("slot"))).alias("shard"))
    placed = saved(placed, "shard-placed")
    kept = ["doc_id", "size", "text_crc32", "shard"]
    often = rows.join(F.broadcast(placed.filter(F.col("copies") * hot >= total).select("group", "shard")), "group", "left")
    seldom = often.filter("shard is null").drop("shard").join(placed.filter(F.col("copies") * hot < total).select("group", "shard"), "group")
    out = saved(often.filter("shard is not null").select(*kept).unionByName(seldom.select(*kept)), "shard-of-rows")
    discard(rows, groups, placed)
    return out


def slots(rows: DataFrame, shard: str = "shard", order: list[str] | None = None) -> DataFrame:
    """rows with `slot`: gapless from 0 in each value of the integer column `shard`, in the given order."""
    order = order or ["doc_id"]
    sorted_ = rows.repartitionByRange(shard, *order).sortWithinPartitions(shard, *order)
    place, names = rows.columns.index(shard), rows.columns

    def run(batches):
        part, last, count = TaskContext.get().partitionId(), None, 0
        for batch in batches:
            s = batch.column(place).to_numpy()
            at = np.arange(len(s))
            begin = np.maximum.accumulate(np.where(np.concatenate([[True], s[1:] != s[:-1]]), at, 0)) if len(s) else at
            local = at - begin
            if len(s):
                # A shard that the last batch began goes on.
                local[s == s[0]] += count if s[0] == last else 0
                last, count = s[-1], int(local[-1]) + 1
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(np.full(len(s), part, np.int32)), pa.array(local)], [*names, "part", "local"])

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema) + ", part int, local long"
    numbered = saved(sorted_.mapInArrow(run, schema), "shard-slots")
    # A row for each range and each shard in it: as many as ranges and shards together.
    counts = numbered.groupBy(F.col(shard).alias("s"), F.col("part").alias("p")).agg(F.count("*").alias("n"))
    base = counts.select("s", "p", (F.sum("n").over(Window.partitionBy("s").orderBy("p")) - F.col("n")).alias("base"))
    joined = numbered.join(base, (F.col(shard) == F.col("s")) & (F.col("part") == F.col("p")))
    return joined.select(*names, (F.col("base") + F.col("local")).alias("slot"))


def shard(docs: DataFrame, shards: int = 16, hot: int = 4096) -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot, grown_shard of each row."""
    assigned = assign(docs, shards, hot)
    placed = slots(assigned, order=["doc_id", "text_crc32", "size"])
    out = placed.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))
    discard(assigned)
    return out
