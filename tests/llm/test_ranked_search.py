"""Ranked search against a plain count of every document, over odd rows and against its SQL."""

import math
import random
import re
from collections import Counter

import duckdb
import numpy as np

from sunlattice.llm import common, queries, ranked_search

TERM = re.compile(rb"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def terms(text):
    return TERM.findall((text or "").encode().lower())


def brute(docs, items, k=10):
    counts = [(d, Counter(terms(t))) for d, t in docs]
    counts = [(d, c, sum(c.values())) for d, c in counts if c]
    n_docs, length = len(counts), sum(n for *_, n in counts)
    df = Counter(t for _, c, _ in counts for t in c)
    out = []
    for item, text in sorted(set(items), key=repr):
        scored = []
        for d, c, n in counts:
            m = 10 + (90 * n * n_docs) // length
            s = sum(math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * (1_000_000_000 * c[t] // (1000 * c[t] + 8 * m)) for t in set(terms(text)) if t in c)
            if s > 0:
                scored.append((-s, 2**63 if d is None else d))
        out += [(item, r, None if d == 2**63 else d, -s) for r, (s, d) in enumerate(sorted(scored)[:k], 1)]
    return sorted(out, key=repr)


def found(spark, docs, items, **more):
    d = common.prepare(spark).createDataFrame([(*x, "n", 1) for x in docs], "doc_id long, text string, item_id string, rank int").repartition(5)
    b = spark.createDataFrame([(*x, "e") for x in items], "item_id long, text string, score string")
    return sorted((tuple(r) for r in ranked_search.search(d, b, **more).collect()), key=repr)


def test_scores_ties_nulls_and_repeats(spark):
    rng = random.Random(3)
    words = "sun ray Shade WALL été ß 日本 x1 42 a-b it's the the the the".split()
    docs = [(k, " ".join(rng.choice(words) + rng.choice(["", "", str(rng.randrange(9))]) for _ in range(rng.randrange(1, 60)))) for k in range(300)]
    docs += [(1000 + k, "the same text of ties") for k in range(25)] + [(7, None), (8, ""), (9, " .,; "), (None, "the same text of ties"), (None, None)]
    docs += [docs[3], docs[3], (5000, "sun " * 40_000 + "rare")]
    items = [(k, " ".join(rng.choice(words) for _ in range(rng.randrange(1, 12)))) for k in range(30)]
    items += [items[0], (1, "the second text of one id"), (None, "same ties"), (40, None), (41, ""), (42, "nowhere"), (43, "the same text of ties")]
    want = brute(docs, items)
    assert found(spark, docs, items) == want and len(want) > 250
    assert found(spark, docs, items, part_words=40) == want
    assert found(spark, docs, items, k=3) == brute(docs, items, 3)


def test_empty_tables(spark):
    assert found(spark, [], [(1, "a")]) == found(spark, [(1, "a")], []) == found(spark, [(1, None)], [(1, None)]) == []


def test_radix_order_and_sums_of_wide_keys():
    rng = np.random.default_rng(1)
    keys = rng.integers(0, 1 << 45, 5000)
    assert (keys[ranked_search.radix_order(keys)] == np.sort(keys)).all()
    item, row, impact = rng.integers(0, 70_000, 9000), rng.integers(0, 3, 9000), rng.integers(0, 99, 9000)
    want = Counter()
    for i, r, x in zip(item.tolist(), row.tolist(), impact.tolist()):
        want[i, r] += x
    got = ranked_search.accumulate(item, row, impact, 3)
    assert list(zip(*(x.tolist() for x in got))) == [(*k, v) for k, v in sorted(want.items())]


def test_long_documents_of_large_tables_do_not_overflow():
    n = np.array([1, 10**9])
    assert ranked_search._product_over(90 * n, 10**11, 10**13).tolist() == [0, 90 * 10**9 * 10**11 // 10**13]


def test_query_matches_sql(spark):
    con, sf = duckdb.connect(), "/root/testdata/sf0.01"
    for t in ("documents", "benchmark"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    want = con.execute(f"SELECT item_id, rank, doc_id, score FROM ({queries.SEARCH_SQL})").fetchall()
    got = queries.op11_ranked_search(spark, sf).select("item_id", "rank", "doc_id", "score").collect()
    assert sorted(tuple(r) for r in got) == sorted(want) and len(want) == 400
