"""Hard negatives against brute force: clusters, ties, repeats, odd rows, many cells and chunks, and the SQL."""

import duckdb
import numpy as np
import pytest

from sunlattice.llm import common, queries, vantage_tree

KEEP = ["anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"]


def brute(rows, k=5, m=5):
    ok = {(i, l, tuple(int(np.floor(256 * float(x))) for x in v)) for i, v, l in rows if i is not None and l is not None and v is not None and all(x is not None and np.isfinite(x) for x in v)}
    ok = sorted(ok)
    dim = max((len(v) for *_, v in ok), default=0)
    x = np.array([list(v) + [0] * (dim - len(v)) for *_, v in ok], np.int64).reshape(len(ok), dim)
    out = []
    for a, (i, label, _) in enumerate(ok):
        if i % 100:
            continue
        s = x @ x[a]
        by = lambda at: sorted(at, key=lambda r: (-s[r], ok[r][0]))
        for p in by([r for r in range(len(ok)) if r != a and ok[r][1] == label])[:k]:
            inside = by([r for r in range(len(ok)) if ok[r][1] != label and 80 * s[p] <= 100 * s[r] <= 100 * s[p]])[:m]
            out += [(i, ok[p][0], rank, ok[n][0], int(s[p]), int(s[n])) for rank, n in enumerate(inside, 1)]
    return sorted(out)


def mined(spark, rows, **more):
    df = common.prepare(spark).createDataFrame([(*r, "x", 1) for r in rows], "vec_id long, embedding array<float>, label int, cell string, score int").repartition(6)
    return sorted(tuple(r) for r in vantage_tree.mine(df, vantage_tree.F.col("vec_id") % 100 == 0, **more).select(*KEEP).collect())


def vectors(n, dim=8, seed=1, spread=0.15):
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(12, dim))
    at = rng.integers(0, 12, n)
    x = centres[at] + spread * rng.normal(size=(n, dim))
    return [(k, [float(np.float32(c)) for c in x[k]], int((at[k] + rng.integers(0, 2)) % 4)) for k in range(n)]


@pytest.mark.parametrize("small", [{}, {"max_sample": 200, "cell_rows": 50, "block": 40, "chunk": 2}])
def test_clusters_of_different_norms(spark, small):
    rows = vectors(1500)
    want = brute(rows)
    assert mined(spark, rows, **small) == want and len(want) > 150


def test_ties_repeats_and_odd_rows(spark):
    rng = np.random.default_rng(4)
    rows = [(k, [float(x) for x in rng.integers(0, 3, 4)], int(rng.integers(0, 3))) for k in range(700)]
    rows += rows[:40] + [(5000 + k, rows[0][1], k % 3) for k in range(400)]
    rows += [(100, [9.0, 9.0, 1.0, 0.5], 1), (None, [1.0] * 4, 1), (1200, None, 1), (1300, [1.0] * 4, None), (1400, [1.0, None, 2.0, 3.0], 1), (1500, [float("nan"), 1.0, 1.0, 1.0], 2), (1600, [float("inf"), 1.0, 1.0, 1.0], 0), (1700, [], 1), (1800, [2.0], 2), (1900, [-1.0] * 4, 2)]
    want = brute(rows)
    for small in ({}, {"max_sample": 100, "cell_rows": 30, "block": 30, "chunk": 3}):
        assert mined(spark, rows, **small) == want


def test_empty_tables_and_lone_rows(spark):
    assert mined(spark, []) == mined(spark, [(100, [1.0], 1)]) == mined(spark, [(100, [1.0], 1), (1, [1.0], 2)]) == mined(spark, [(100, None, 1)]) == []


def test_traversal_skips_far_nodes():
    rng = np.random.default_rng(2)
    centres = 4000 * rng.normal(size=(40, 16))
    x = np.floor(np.repeat(centres, 100, axis=0) + 20 * rng.normal(size=(4000, 16)))
    top = float((x * x).sum(1).max())
    tree = vantage_tree.Tree(x, top, 32)
    view = vantage_tree.View(tree, x[7], np.arange(4000), np.ones(4000, bool), 5)
    s = x @ x[7]
    assert [r for _, _, r in view.best()] == np.lexsort((np.arange(4000), -s))[:5].tolist()
    leaves = sum(not isinstance(n, tuple) for n in tree.nodes)
    assert len(view.seen) < leaves / 2


def test_scores_too_large_are_an_error():
    with pytest.raises(ValueError):
        vantage_tree._scores(np.full((1, 4), 2.0**31), np.full(4, 2.0**31))


def test_query_matches_sql(spark):
    con, sf = duckdb.connect(), "/root/testdata/sf0.01"
    con.execute(f"CREATE VIEW embeddings AS SELECT * FROM '{sf}/embeddings.parquet'")
    want = con.execute(f"SELECT {', '.join(KEEP)} FROM ({queries.NEGATIVES_SQL})").fetchall()
    got = queries.op12_vantage_tree(spark, sf).select(*KEEP).collect()
    assert sorted(tuple(r) for r in got) == sorted(want) and len(want) > 50


@pytest.mark.parametrize("wide", [False, True])
def test_a_run_of_queries_shares_the_products_of_a_leaf(monkeypatch, wide):
    """Equal rows, labels and windows: the same as brute force, in as many products as leaves and rounds need."""
    rng = np.random.default_rng(5)
    x = np.floor(300 * rng.normal(size=(1500, 12)))
    x[400:900] = x[400]
    # Products of wide components pass 2^53.
    x = x * 2.0**19 if wide else x
    labels, at = rng.integers(0, 3, 1500), np.arange(0, 1500, 5)
    s = np.array([[sum(int(a) * int(b) for a, b in zip(x[q], x[r])) for r in range(0, 1500, 7)] for q in at[:5]])
    assert (vantage_tree._products(x, x[at])[:5, ::7] == s).all()
    calls, whole = [], vantage_tree._products
    monkeypatch.setattr(vantage_tree, "_products", lambda *a: calls.append(a) or whole(*a))
    monkeypatch.setattr(vantage_tree, "AT_ONCE", 4096)
    tree = vantage_tree.Tree(x, float((x * x).sum(1).max()), 64)
    view = vantage_tree.View(tree, x[at], np.arange(1500), labels == labels[at][:, None], 4)
    scores = x.astype(np.int64) @ x[at].astype(np.int64).T
    tops = np.sort(scores, axis=0)[::-1][[3, 40]].T
    low, high = np.stack([tops[:, 1], tops[:, 0] + 1, np.full(300, -vantage_tree.OPEN)], 1), np.stack([tops[:, 0], tops[:, 0], np.full(300, vantage_tree.OPEN)], 1)
    got = list(zip(*(c.tolist() for c in view.nearest(low, high))))
    want = []
    for n, q in enumerate(at):
        for w in range(3):
            ok = [r for r in range(1500) if labels[r] == labels[q] and low[n, w] <= scores[r, n] <= high[n, w]]
            want += [(3 * n + w, int(scores[r, n]), r) for r in sorted(ok, key=lambda r: (-scores[r, n], r))[:4]]
    assert got == want and len(want) > 2000
    assert len(calls) < 300
