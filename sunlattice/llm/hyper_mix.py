"""Mixing sources to target weights with a multivariate-hypergeometric splitting tree.

Each source is cut into up to `blocks` blocks of documents by hash. Its target
number of words says how many of its blocks are drawn: whole passes over all its
blocks, then blocks in the order of a permutation until the sum of their words
comes nearest to the target. These quotas of blocks, a number per source, are
split among the output shards by a tree: at each node the two halves share the
quotas as a multivariate-hypergeometric draw would, so each shard gets an exact
number of draws of each source and all together exactly the quotas. A shard
takes the next so many blocks of the source's permutation, so no draw is in two
shards, and its rows are shuffled by a hash within it.

What the driver holds is one number per source and shard. Targets: sources in
order of their code points, null last, have weights 3, 1, 2 repeating; they share
`share` times all words by weight; a target stops at twice the source's size and
the excess is shared again by weight.

Draws depend on (seed, doc_id, text) only: reruns agree. Null texts have size 0.
Rows repeated with their id are drawn together. An empty table gives an empty
result; a source without words has target 0 and none of its documents is drawn.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sunlattice.llm.common import free_name, saved

WORD = r"[^\x20\x09-\x0D]+"


def targets(sizes: DataFrame, weights: tuple[int, ...] = (3, 1, 2), share: float = 1.5, limit: float = 2.0) -> DataFrame:
    """sizes (source, source_size) with target: shares by weight, stopped at limit x source_size.

    Where the sources in order of limit per weight are stopped up to some place,
    the rest share what is left; the level that results must not pass the next limit.
    """
    rank = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1
    weight = F.element_at(F.array(*map(F.lit, weights)), (F.col("rank") % len(weights) + 1).cast("int")).cast("double")
    rows = sizes.withColumn("rank", rank).withColumn("weight", weight).withColumn("most", limit * F.col("source_size"))
    rows = rows.withColumn("level", F.col("most") / F.col("weight"))
    whole = Window.partitionBy()
    by = Window.orderBy("level", "rank").rowsBetween(Window.unboundedPreceding, -1)
    total = F.sum("source_size").over(whole) * share
    stopped = F.coalesce(F.sum("most").over(by), F.lit(0.0))
    rest = F.sum("weight").over(whole) - F.coalesce(F.sum("weight").over(by), F.lit(0.0))
    rows = rows.withColumn("even", (total - stopped) / rest)
    # The first place where those not stopped can take the even share.
    level = F.min(F.when(F.col("even") <= F.col("level"), F.struct("level", "rank", "even"))).over(whole)["even"]
    target = F.least(F.col("most"), F.coalesce(level, F.lit(float("inf"))) * F.col("weight"))
    return rows.select("source", "source_size", "rank", target.alias("target"))


def split(quotas: np.ndarray, shards: int, seed: int) -> np.ndarray:
    """Draws of each source (column) in each shard (row): quotas split by halves of the shards."""
    rng = np.random.default_rng(seed)
    out = np.zeros((shards, len(quotas)), np.int64)
    nodes = [(0, shards, quotas.astype(np.int64))]
    while nodes:
        lo, hi, have = nodes.pop()
        if hi - lo == 1:
            out[lo] = have
            continue
        mid = (lo + hi) // 2
        take = int(have.sum()) * (mid - lo) // (hi - lo)
        left = np.zeros_like(have)
        after = int(have.sum())
        # Multivariate hypergeometric, a source at a time.
        for k, h in enumerate(have.tolist()):
            after -= h
            left[k] = rng.hypergeometric(h, after, take) if take and h else 0
            take -= int(left[k])
        nodes += [(lo, mid, left), (mid, hi, have - left)]
    return out


def _sized(docs: DataFrame, seed: int, blocks: int) -> DataFrame:
    source = F.col("source").cast("string")
    key = F.xxhash64(F.lit(seed), F.col("doc_id"), "text")
    return docs.select(F.col("doc_id"), F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("long").alias("size"), source.alias("source"), F.pmod(key, F.lit(blocks)).cast("int").alias("block"), key.alias("key"))


def plan(sized: DataFrame, shards: int, seed: int, blocks: int, weights=(3, 1, 2), share: float = 1.5) -> tuple[DataFrame, DataFrame]:
    """Targets by source, and draws: source, block, pass and the shard that takes it."""
    spark = sized.sparkSession
    of_block = saved(sized.groupBy("source", "block").agg(F.sum("size").alias("words")), "mix-blocks")
    goal = saved(targets(of_block.groupBy("source").agg(F.sum("words").alias("source_size")), weights, share), "mix-targets")
    mixed = F.xxhash64(F.lit(seed + 1), "source", "block")
    order = Window.partitionBy("source").orderBy(mixed, "block")
    b = of_block.join(goal, of_block.source.eqNullSafe(goal.source)).drop(goal.source)
    # As many as `blocks` rows a source from here on.
    b = b.withColumn("place", F.row_number().over(order))
    b = b.withColumn("upto", F.sum("words").over(order.rowsBetween(Window.unboundedPreceding, Window.currentRow)))
    b = b.withColumn("passes", F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size") + 1e-12)).otherwise(F.lit(0)).cast("long"))
    left = F.col("target") - F.col("passes") * F.col("source_size")
    # Drawn once more while the sum comes nearer to the target.
    b = b.withColumn("more", (F.abs(F.col("upto") - left) < F.abs(F.col("upto") - F.col("words") - left)) & (F.col("upto") - F.col("words") < left))
    b = b.withColumn("draws", F.when(F.col("source_size") > 0, F.col("passes") + F.col("more").cast("long")).otherwise(F.lit(0)))
    b = saved(b, "mix-draws")
    quota = b.groupBy("rank").agg(F.sum("draws").alias("quota")).orderBy("rank").collect()
    parts = split(np.array([r.quota for r in quota]), shards, seed)
    ends = np.cumsum(parts, axis=0)
    rows = [(int(q.rank), s, int(ends[s, k] - parts[s, k]), int(ends[s, k])) for k, q in enumerate(quota) for s in range(shards) if parts[s, k]]
    of_shard = spark.createDataFrame(rows, "rank int, shard int, low long, high long")
    each = b.filter("draws > 0").withColumn("turn", F.explode(F.sequence(F.lit(0).cast("long"), F.col("draws") - 1)))
    each = each.withColumn("draw", F.row_number().over(Window.partitionBy("source").orderBy("turn", "place")) - 1)
    dealt = each.join(F.broadcast(of_shard), (each["rank"] == of_shard["rank"]) & (F.col("draw") >= F.col("low")) & (F.col("draw") < F.col("high")))
    return goal, dealt.select("source", "block", "turn", "shard")


def taken(docs: DataFrame, shards: int = 16, seed: int = 7, blocks: int = 1024) -> DataFrame:
    """doc_id, size, source_size, target, taken, draws, shards of each row of docs (doc_id, text, source)."""
    sized = saved(_sized(docs, seed, blocks).drop("key"), "mix-sizes")
    goal, draws = plan(sized, shards, seed, blocks)
    per_block = saved(draws.groupBy("source", "block").agg(F.count("*").alias("draws"), F.sort_array(F.collect_list("shard")).alias("shards")), "mix-taken")
    out = sized.join(per_block.withColumnsRenamed({"source": "s", "block": "b"}), F.col("source").eqNullSafe(F.col("s")) & (F.col("block") == F.col("b")), "left").drop("s", "b")
    out = out.join(goal.select(F.col("source").alias("s"), "source_size", "target"), F.col("source").eqNullSafe(F.col("s")))
    return out.select("doc_id", "size", "source_size", "target", (F.col("size") * F.coalesce("draws", F.lit(0))).alias("taken"), F.coalesce("draws", F.lit(0)).alias("draws"), F.coalesce("shards", F.array().cast("array<int>")).alias("shards"))


def mix(docs: DataFrame, shards: int = 16, seed: int = 7, blocks: int = 1024) -> DataFrame:
    """The mix: rows of docs, as often as drawn, in shuffled order within each shard; same columns."""
    sized = saved(_sized(docs, seed, blocks).select("source", "block", "size"), "mix-sizes")
    _, draws = plan(sized, shards, seed, blocks)
    draws = saved(draws, "mix-plan")
    names, used = docs.columns, list(docs.columns)
    free = {}
    for k in ("block", "key", "src", "s", "b", "turn", "shard"):
        free[k] = free_name(used, f"mix_{k}")
        used.append(free[k])
    key = F.xxhash64(F.lit(seed), F.col("doc_id"), "text")
    rows = docs.withColumns({free["key"]: key, free["block"]: F.pmod(key, F.lit(blocks)).cast("int"), free["src"]: F.col("source").cast("string")})
    draws = draws.select(F.col("source").alias(free["s"]), F.col("block").alias(free["b"]), F.col("turn").alias(free["turn"]), F.col("shard").alias(free["shard"]))
    # A row a draw; sent to all executors only while it is small.
    draws = F.broadcast(draws) if draws.count() <= 250_000 else draws
    drawn = rows.join(draws, F.col(free["src"]).eqNullSafe(F.col(free["s"])) & (F.col(free["block"]) == F.col(free["b"])))
    order = [F.col(free["shard"]), F.xxhash64(F.lit(seed + 2), free["key"], free["turn"])]
    drawn = drawn.withColumn(free["key"], order[1])
    return drawn.repartitionByRange(free["shard"], free["key"]).sortWithinPartitions(free["shard"], free["key"]).select(*[F.col(f"`{c}`") for c in names])
