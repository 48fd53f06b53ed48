"""Every group is scheduled on its own: loads are those of a plain heap over all groups."""

import heapq
import random
from collections import Counter, defaultdict

from sunlattice.llm import common, lpt_shards


def brute_loads(sizes, shards):
    heap = [(0, s) for s in range(shards)]
    for size in sorted(sizes, reverse=True):
        load, s = heapq.heappop(heap)
        heapq.heappush(heap, (load + size, s))
    return {s: load for load, s in heap}


def test_runs_of_equal_sizes_are_dealt_as_by_the_heap():
    rng = random.Random(8)
    for _ in range(300):
        shards = rng.randrange(1, 9)
        runs = [(size, rng.choice([1, 2, 7, 40, 333])) for size in rng.sample(range(1, 60), rng.randrange(1, 9))]
        runs.sort(reverse=True)
        given = lpt_shards.deal(runs, shards)
        assert [sum(n) for n in given] == [count for _, count in runs]
        load = Counter()
        for (size, _), n in zip(runs, given):
            for s, k in enumerate(n):
                load[s] += k * size
        assert {s: load[s] for s in range(shards)} == brute_loads([size for size, count in runs for _ in range(count)], shards)
    for _ in range(200):
        loads, size, count = [rng.randrange(50) for _ in range(5)], rng.randrange(1, 9), rng.randrange(1, 90)
        assert lpt_shards._few(loads, size, count) == lpt_shards._many(loads, size, count)


def test_loads_of_the_shards(spark):
    rng = random.Random(9)
    texts = ["x" * rng.choice([0, 1, 2, 3, 50, 51, 900]) + rng.choice("abcdefgh") * rng.choice([0, 1]) for _ in range(900)]
    texts += [None, "", "y" * 40_000] + ["hot text"] * 500
    docs = common.prepare(spark).createDataFrame([(k, t, 0) for k, t in enumerate(texts)], "doc_id long, text string, shard int")
    groups = Counter()
    for t in texts:
        groups[t or ""] += len((t or "").encode()) + 1
    for hot in (4096, 2):
        got = lpt_shards.shard(docs, 7, hot).collect()
        load, of = Counter(), defaultdict(set)
        for r in got:
            load[r.shard] += r.size
            of[texts[r.doc_id] or ""].add(r.shard)
        assert len(got) == len(texts) and all(len(s) == 1 for s in of.values())
        assert {s: load[s] for s in range(7)} == brute_loads(groups.values(), 7)
