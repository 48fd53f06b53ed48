"""Every link is counted, also between sets that hang on one head."""

import random

from test_near_duplicates import shingle_set

from sunlattice.llm import common, signature_tree


def brute(rows, width, percent):
    """(least id reachable, links to other sets) of each id."""
    sets = {d: shingle_set(t, width) for d, t in rows}
    near = {x: {y for y in set(sets.values()) if y != x and (n := len(x & y)) and 100 * n >= percent * (len(x) + len(y) - n)} for x in set(sets.values())}
    out = {}
    for d, s in sets.items():
        seen, todo = set(), [s]
        while todo:
            if (x := todo.pop()) not in seen:
                seen.add(x)
                todo += near[x]
        out[d] = (min(k for k, v in sets.items() if v in seen) if s else d, len(near[s]))
    return out


def test_links_between_near_copies(spark, monkeypatch):
    rng = random.Random(6)
    rows = []
    for g, size in enumerate((30, 12, 3, 1)):
        base = [f"g{g}t{k}" for k in range(140)]
        for _ in range(size):
            one = list(base)
            for _ in range(rng.randrange(5)):
                one[rng.randrange(140)] = f"n{rng.random()}"
            rows.append((len(rows), " ".join(one[: rng.choice([140, 138, 130])])))
    rows += [(100, rows[0][1]), (101, rows[3][1]), (102, ""), (103, "a b"), (104, "a b")]
    docs = common.prepare(spark).createDataFrame(rows, "doc_id long, text string")
    for block, width, percent in ((2048, 3, 90), (4, 5, 80)):
        monkeypatch.setattr(signature_tree, "BLOCK", block)
        want = brute(rows, width, percent)
        assert max(n for _, n in want.values()) > 5
        assert {r.doc_id: (r.component_id, r.n_links) for r in signature_tree.jaccard_components(docs, percent, width).collect()} == want
        few = {r.doc_id: (r.component_id, r.n_links) for r in signature_tree.jaccard_components(docs, percent, width, all_links=False).collect()}
        assert all(few[d][0] == c and few[d][1] <= n for d, (c, n) in want.items())
