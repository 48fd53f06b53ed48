"""The near-duplicate stage on five-word shingles at 0.8, against brute force."""

import random
from collections import defaultdict

import corpus_pipeline
from test_operators import SPACED, lower

from sunlattice.llm import common, signature_tree

SF = "/root/testdata/sf0.001"
STAGE = dict(corpus_pipeline.STAGES)["near_duplicates"]


def shingle_set(text, width):
    w = SPACED.findall(lower(text))
    return frozenset(tuple(w[i : i + width]) for i in range(len(w) - width + 1)) if len(w) >= width else frozenset([tuple(w)] if w else [])


def brute_components(rows, width, percent):
    """Component of each id; ids are distinct and not null."""
    sets = {d: shingle_set(t, width) for d, t in rows}
    near = defaultdict(set)
    for a, x in sets.items():
        for b, y in sets.items():
            if percent * max(len(x), len(y)) > 100 * min(len(x), len(y)):
                continue  # too different in size
            both = len(x & y)
            if both and 100 * both >= percent * (len(x) + len(y) - both):
                near[a].add(b)
    out = {}
    for d in sorted(sets):
        todo = [d]
        while todo:
            if (k := todo.pop()) not in out:
                out[k] = d
                todo += near[k]
    return out


def edited():
    """Texts with two words in a hundred changed, far from each other: 0.82 on five words, under 0.9 on three. Also short ones."""
    rng = random.Random(5)
    rows = []
    for g in range(6):
        base = [f"g{g}w{k}" for k in range(500)]
        rows.append((10 * g, " ".join(base)))
        for c in range(1, 4):
            one = list(base)
            for k in range(10):
                one[50 * k + rng.randrange(10, 40)] = f"g{g}c{c}n{k}"
            rows.append((10 * g + c, " ".join(one)))
    return rows + [(100 + k, t) for k, t in enumerate(["a", "a b", "a b c", "a b c d", "a b c e", "a b c d", "a b c d e", "A B C d e", "", "b a"])]


def test_stage_on_five_words(spark):
    rows = edited()
    docs = common.prepare(spark).createDataFrame([(d, t, "en", "s", len(t)) for d, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    kept = sorted(r.doc_id for r in STAGE(spark, docs, SF).collect())
    want = brute_components(rows, 5, 80)
    assert [want[10 * g + c] for g in range(6) for c in range(4)] == [10 * g for g in range(6) for _ in range(4)]
    assert kept == sorted(d for d, c in want.items() if d == c)


def test_stage_on_the_small_table(spark):
    docs = common.table(spark, SF, "documents")
    rows = {(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()}
    want = brute_components(rows, 5, 80)
    assert sorted(r.doc_id for r in STAGE(spark, docs, SF).select("doc_id").collect()) == sorted(d for d, c in want.items() if d == c)


def test_components_by_width(spark):
    rows = edited()
    docs = common.prepare(spark).createDataFrame(rows, "doc_id long, text string")
    for width, percent in ((2, 70), (3, 90), (5, 80), (7, 80)):
        got = signature_tree.jaccard_components(docs, percent, width).collect()
        assert {r.doc_id: r.component_id for r in got} == brute_components(rows, width, percent)
        assert {r.doc_id: r.n_shingles for r in got} == {d: len(shingle_set(t, width)) for d, t in rows}


def test_without_keeps_all_other_rows(spark):
    """Rows of an id go or stay together, a null id is one of its own, and empty tables on either side are fine."""
    from sunlattice.llm import signature_tree

    rows = [(k, f"text {k}", "a") for k in range(300)] + [(None, "no id", "a"), (5, "again", None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, gone_id string")
    gone = spark.createDataFrame([(5,), (None,), (77,), (5,)], "doc_id long")
    kept = sorted(tuple(r) for r in signature_tree.without(docs, gone).collect())
    assert kept == sorted(r for r in rows if r[0] not in (5, None, 77))
    assert signature_tree.without(docs, gone.limit(0)).count() == len(rows)
    assert signature_tree.without(docs.limit(0), gone).columns == docs.columns
