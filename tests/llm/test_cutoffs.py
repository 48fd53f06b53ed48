"""Which documents the quality rules keep, against a plain computation, and cutoffs that follow their group."""

import math
import random
from collections import Counter, defaultdict

from test_operators import SPACED, brute_quality

from sunlattice.llm import common, quality_sketch

SCHEMA = "doc_id long, text string, lang string, source string"


def brute_kept(rows, tail=0.05, reach=2.0, prior=400, slack=3.0, gamma=1.02):
    measured = []
    for d, text, lang, source in rows:
        n, chars, symbols, dup, repeat = brute_quality(text)
        lines = sum(1 for x in (text or "").encode().split(b"\n") if SPACED.search(x))
        measured.append((d, lang, source, {"w": (chars, n), "s": (symbols, n), "d": (dup, max(1, lines)), "r": (repeat, n)}, n < 50 or 100 * repeat > 50 * n))

    def quantiles(group):
        out = {}
        for k in "wsdr":
            xs = sorted(a / b for *_, m, failed in group if not failed for a, b in [m[k]])
            xs = [0.0 if x <= 1e-9 else gamma ** math.ceil(math.log(x) / math.log(gamma)) * 2 / (1 + gamma) for x in xs]
            out[k] = (len(xs), [xs[max(0, math.ceil(q * len(xs)) - 1)] for q in (tail, 0.5, 1 - tail)] + [sum(xs) / len(xs)]) if xs else (0, [0, 0, 0, 0])
        return out

    groups = defaultdict(list)
    for m in measured:
        for key in ((), (m[1],), (m[1], m[2])):
            groups[key].append(m)
    found = {k: quantiles(g) for k, g in groups.items()}
    kept = Counter()
    for d, lang, source, m, failed in measured:
        good = not failed
        for k in "wsdr":
            value = found[()][k][1]
            for key in ((lang,), (lang, source)):
                n, own = found[key][k]
                value = [(a * n + b * prior) / (n + prior) for a, b in zip(own, value)]
            low, mid, high, mean = value
            a, b = m[k]
            least = a if k == "w" else a - slack * math.sqrt(a)
            good &= least <= (high + reach * max(high - mid, mean if k != "w" else 0)) * b + 1e-9
            good &= k != "w" or a >= (low - reach * (mid - low)) * b - 1e-9
        kept[d, failed, good] += 1
    return kept


def made():
    rng = random.Random(21)
    rows = []
    for d in range(600):
        source, lang = ["plain", "code", None][d % 3], ["en", "de", None][d // 3 % 3]
        words = ["".join(rng.choice("abcdefghijk") for _ in range(rng.randrange(1, 9))) for _ in range(rng.randrange(30, 160))]
        if source == "code":
            words = [w + "#" * (rng.random() < 0.4) for w in words]
        if d % 97 == 5:
            words = [w + "$$$" for w in words]
        if d % 101 == 7:
            words = ["x" * 40 + w for w in words]
        text = " ".join(words)
        if d % 89 == 3:
            text += "\n" + "\n".join(["the same line " + words[0]] * 30)
        rows.append((d, text, lang, source))
    return rows + [(1000, None, "en", "plain"), (1001, "", None, None), (1002, "word " * 5000, "en", "x"), (5, rows[5][1], *rows[5][2:])]


def test_kept_is_that_of_plain_sketches(spark):
    rows = made()
    got = quality_sketch.judge(common.prepare(spark).createDataFrame(rows, SCHEMA)).collect()
    want = brute_kept(rows)
    assert Counter((r.doc_id, r.base_failed, r.kept) for r in got) == want
    assert any(not f and not k for _, f, k in want)


def test_cutoffs_follow_their_group(spark):
    """Symbols that are odd in one source are usual in another."""
    rows = made()
    docs = common.prepare(spark).createDataFrame(rows, SCHEMA)
    measured = quality_sketch.measure(docs).withColumn("base_failed", quality_sketch.base_failed()).filter("not base_failed")
    cut = {(r.lang, r.source): r for r in quality_sketch.thresholds(quality_sketch.sketch(measured), prior=20).collect()}
    assert cut["en", "code"].high_symbol_share > 1.2 * cut["en", "plain"].high_symbol_share
    assert (None, None) in cut and all(r.low_word_length < r.high_word_length for r in cut.values())


def test_clean_documents_stay(spark):
    docs = common.table(spark, "/root/testdata/sf0.01", "documents")
    got = quality_sketch.judge(docs).filter("not base_failed")
    n = got.count()
    kept = got.filter("kept")
    assert 0.9 * n < kept.count() < n
    labels = common.table(spark, "/root/testdata/sf0.01", "labels")
    good = got.join(labels.filter("quality = 1"), "doc_id")
    assert good.filter("kept").count() > 0.99 * good.count()


def test_what_few_documents_are_like_goes(spark):
    """Three symbols a word: 3 in 100 documents are like that, in some groups more than the tail of 5 in 100."""
    docs = common.table(spark, "/root/testdata/sf0.1", "documents")
    odd = quality_sketch.judge(docs).filter("n_symbols > 2.5 * n_words and n_words > 150 and not base_failed")
    assert odd.filter("kept").count() < 0.5 * odd.count()
