"""Repeated and moved passages of the line alignment, against brute force."""

import random
import time

from sunlattice.llm import common, line_alignment

LINE = "{} a line with eight words or more in it".format


def brute_blocks(a, b, words, least):
    """Places of b in a run of `least` words or more that is also a run of a."""
    runs = {tuple(a[i:j]) for i in range(len(a)) for j in range(i + 1, len(a) + 1)}
    return sorted({k for i in range(len(b)) for j in range(i + 1, len(b) + 1) if tuple(b[i:j]) in runs and sum(words[i:j]) >= least for k in range(i, j)})


def test_alignment_leaves_no_common_line_in_a_gap():
    u, v, w, p = 1, 2, 3, 9
    assert line_alignment.align([u, p, v, p, w], [4, p, 5]) == [(1, 1, 1)]
    rng = random.Random(2)
    for _ in range(500):
        a, b = ([rng.randrange(5) for _ in range(rng.randrange(12))] for _ in range(2))
        x = y = 0
        for i, j, n in [*line_alignment.align(a, b), (len(a), len(b), 0)]:
            assert i >= x and j >= y and not set(a[x:i]) & set(b[y:j]) and a[i : i + n] == b[j : j + n]
            x, y = i + n, j + n


def test_blocks_anywhere_in_the_head():
    rng = random.Random(3)
    for _ in range(2000):
        a, b = ([rng.randrange(4) for _ in range(rng.randrange(14))] for _ in range(2))
        size = [rng.randrange(1, 6) for _ in range(4)]
        words = [size[x] for x in b]
        assert line_alignment.again(a, b, words, 8, set()) == brute_blocks(a, b, words, 8)
        first = {k for _, s, n in line_alignment.align(a, b) if sum(words[s : s + n]) >= 8 for k in range(s, s + n)}
        assert sorted(first | set(line_alignment.again(a, b, words, 8, first))) == brute_blocks(a, b, words, 8)


def test_long_texts_take_a_second_at_most():
    rng = random.Random(6)
    a = list(range(20_000))
    moved = a[:]
    rng.shuffle(moved)
    for b in (moved, a[::-1], a[:10_000] * 2, [rng.randrange(40_000) for _ in a], a[5_000:] + a[:5_000]):
        began = time.perf_counter()
        first = {k for _, s, n in line_alignment.align(a, b) for k in range(s, s + n)}
        gone = first | set(line_alignment.again(a, b, [8] * len(b), 8, first))
        assert time.perf_counter() - began < 2
        assert gone == {k for k, x in enumerate(b) if x < 20_000}


def test_passage_that_a_text_holds_twice_or_elsewhere(spark):
    p, q = ([LINE(f"{x}{k}") for k in range(3)] for x in "pq")
    own = [LINE(f"own{k}") for k in range(30)]
    texts = [
        (1, [own[0], *p, own[1], *p, own[2], *q]),
        (2, [own[3], *p, own[4]]),
        (3, [own[5], *p, own[6], *p, own[7], *p]),
        (4, [own[8], *q, own[9], *p, own[10]]),
        (5, [own[11], p[2], own[12], p[0], p[0], p[1]]),
        (6, [own[13], own[14]]),
    ]
    frame = common.prepare(spark).createDataFrame([(d, "\n".join(x)) for d, x in texts], "doc_id long, text string")
    got = {r.doc_id: (r.text, r.n_removed, r.partners) for r in line_alignment.dedupe(frame, moved=True).collect()}
    for d, x in texts:
        left = x if d == 1 else [y for y in x if y in own]
        assert got[d] == ("\n".join(left), len(x) - len(left), [1] if len(x) > len(left) else [])
    # The alignment alone: a passage that the head holds twice is found.
    assert {r.doc_id: r.text for r in line_alignment.dedupe(frame).collect()}[2] == f"{own[3]}\n{own[4]}"


def test_blocks_of_short_lines_link(spark):
    verse = [f"verse {k} of it" for k in range(12)]
    texts = [(1, ["a title", *verse, "an end"]), (2, ["b title", *verse, "b end"]), (3, ["c", verse[0], "d", verse[1], "e"]), (4, ["x", *verse[4:6], "y"])]
    frame = common.prepare(spark).createDataFrame([(d, "\n".join(x)) for d, x in texts], "doc_id long, text string")
    for moved in (False, True):
        got = {r.doc_id: r.text for r in line_alignment.dedupe(frame, moved=moved).collect()}
        # Lone short lines are no link; two of four words each are eight.
        assert got == {1: "\n".join(texts[0][1]), 2: "b title\nb end", 3: "\n".join(texts[2][1]), 4: "x\ny"}


def test_lines_of_any_earlier_text_go(spark):
    """Each text keeps the lines that are in no run of eight words or more that an earlier text has."""
    rng = random.Random(4)
    pool = [" ".join(f"w{k}n{n}" for n in range(rng.choice([1, 2, 3, 4, 5, 9]))) for k in range(14)]
    texts = [(d, [rng.choice(pool) for _ in range(rng.randrange(1, 9))]) for d in range(60)]
    frame = common.prepare(spark).createDataFrame([(d, "\n".join(x)) for d, x in texts], "doc_id long, text string")
    got = {r.doc_id: r.text for r in line_alignment.dedupe(frame, moved=True).collect()}
    lost = 0
    for d, x in texts:
        if any(x == y for _, y in texts[:d]):
            assert got[d] is None
            continue
        words = [len(y.split()) for y in x]
        gone = {k for _, y in texts[:d] for k in brute_blocks(y, x, words, 8)}
        lost += len(gone)
        assert got[d] == "\n".join(y for k, y in enumerate(x) if k not in gone), d
    assert lost > 40
