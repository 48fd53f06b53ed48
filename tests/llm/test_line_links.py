"""Which texts are aligned with which: all pairs of rare runs, and common ones without a hot task."""

import random
import time

from test_line_blocks import brute_blocks

from sunlattice.llm import common, line_alignment


def frame(spark, texts):
    return common.prepare(spark).createDataFrame([(d, "\n".join(x), 1, "x") for d, x in texts], "doc_id long, text string, line long, head string")


def test_cases_of_shared_blocks_beside_a_common_line(spark):
    line, m = "a line of eight words that all of them share", "another line of eight words that two of them share"
    texts = [(1, [line]), (2, ["own two", line, "short a", "short b", "short c"]), (3, ["own three", line, "short a", "short b", "short c"]), (11, [f"{line} 1", "x", m]), (12, [m, f"{line} 1"]), (13, ["z", m, f"{line} 1", "tail"])]
    got = {r.doc_id: (r.text, r.partners) for r in line_alignment.dedupe(frame(spark, texts)).collect()}
    assert got[3] == ("own three", [1, 2]) and got[2] == ("own two\nshort a\nshort b\nshort c", [1])
    assert got[13] == ("z\ntail", [11, 12])


def test_every_pair_against_brute_force(spark, monkeypatch):
    rng = random.Random(14)
    pool = [" ".join(f"w{k}n{n}" for n in range(rng.choice([2, 4, 9, 11]))) for k in range(60)]
    hot = "the very same line that nearly all of the texts have"
    texts = [(d, [x for _ in range(rng.randrange(1, 12)) for x in [rng.choice(pool)]] + [hot] * rng.choice([0, 1, 1]) + [f"own {d}"]) for d in range(70)]
    want = {}
    for d, x in texts:
        words = [len(y.split()) for y in x]
        gone = {k for _, y in texts[:d] for k in brute_blocks(y, x, words, 8)}
        want[d] = "\n".join(y for k, y in enumerate(x) if k not in gone)
    for rare, big in ((4, 4096), (0, 4096), (100, 4096), (2, 1)):
        monkeypatch.setattr(line_alignment, "HOT", big)
        monkeypatch.setattr(line_alignment, "PARTNERS", 7)
        got = {r.doc_id: r.text for r in line_alignment.dedupe(frame(spark, texts), moved=True, rare=rare).collect()}
        assert got == want
    # Pairs of a rare run: the earlier text is a partner wherever both have a block.
    found = {r.doc_id: r.partners for r in line_alignment.dedupe(frame(spark, texts), moved=True, rare=100).collect()}
    for d, x in texts:
        words = [len(y.split()) for y in x]
        assert found[d] == [e for e, y in texts[:d] if brute_blocks(y, x, words, 8)]


def test_texts_of_many_lines(spark):
    lines = [f"line {k} of a very long text with eight words" for k in range(20_000)]
    texts = [(1, lines), (2, ["new", *lines[:9000], "mid", *lines[9000:]]), (3, lines[::2])]
    docs = frame(spark, texts)
    began = time.time()
    got = {r.doc_id: (r.text, r.n_removed) for r in line_alignment.dedupe(docs).collect()}
    assert got[2] == ("new\nmid", 20_000) and got[3] == ("", 10_000)
    assert time.time() - began < 60
