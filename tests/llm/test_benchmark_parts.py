"""A benchmark in several automata gives what one gives, and no column gets in the way."""

import random
from collections import Counter

from test_operators import brute_marks

from sunlattice.llm import common, suffix_automaton


def test_parts_add_up(spark):
    rng = random.Random(12)
    words = [f"v{k}" for k in range(40)]
    items = [(k, " ".join(rng.choice(words) for _ in range(rng.randrange(3, 40)))) for k in range(30)]
    rows = []
    for d in range(80):
        text = [rng.choice(words) for _ in range(rng.randrange(60))]
        for _ in range(rng.randrange(3)):
            item = rng.choice(items)[1].split()
            s = rng.randrange(len(item))
            text[s:s] = item[s : s + rng.randrange(1, 25)]
        rows.append((d, " ".join(text), "old"))
    rows += [(100, None, "old"), (101, "", None), (102, " ".join(x for _, x in items) * 40, "old")]
    docs = common.prepare(spark).createDataFrame(rows, "doc_id long, text string, contamination string")
    bench = spark.createDataFrame(items, "item_id long, text string")
    want = Counter((d, *brute_marks(t, items)) for d, t, _ in rows)
    for part in (1 << 19, 60, 1):
        got = suffix_automaton.digest(suffix_automaton.mark(docs, bench, part_words=part))
        assert Counter((r.doc_id, r.n_words, r.n_hit, r.n_items, r.items_sha256, r.contaminated) for r in got.collect()) == want
    assert any(x[2] for x in want) and not all(x[2] for x in want)
