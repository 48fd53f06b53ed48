"""Kneser-Ney probabilities against a plain model, bounded samples, and languages beyond one block."""

import math
import random
from collections import Counter, defaultdict

import numpy as np

from sunlattice.llm import common, kneser_ney


def brute_cross_entropy(texts, text, order):
    """Nats a symbol of text under an interpolated Kneser-Ney model of texts, from its definition."""

    def symbols(t):
        out = []
        for c in t:
            x = c.lower() if c.isalpha() else " "
            if x != " " or out and out[-1] != " ":
                out.append(x)
        return out if not out or out[-1] == " " else [*out, " "]

    counts = [Counter() for _ in range(order + 1)]
    for t in texts:
        s = [" "] * (order - 1) + symbols(t)
        counts[order].update(tuple(s[i - order + 1 : i + 1]) for i in range(order - 1, len(s)))
    for k in range(order - 1, 0, -1):
        counts[k].update(g[1:] for g in counts[k + 1])
    total = [defaultdict(int) for _ in range(order + 1)]
    kinds = [defaultdict(int) for _ in range(order + 1)]
    discount = [0.0] * (order + 1)
    for k in range(1, order + 1):
        for g, n in counts[k].items():
            total[k][g[:-1]] += n
            kinds[k][g[:-1]] += 1
        once, twice = (sum(n == x for n in counts[k].values()) for x in (1, 2))
        discount[k] = min(0.9, max(0.1, once / max(1, once + 2 * twice)))

    def p(history, x, k):
        if k == 0:
            return 1 / (len(counts[1]) + 1)
        h = tuple(history[len(history) - k + 1 :])
        low = p(history, x, k - 1)
        if not total[k][h]:
            return low
        return max(0, counts[k][(*h, x)] - discount[k] if (*h, x) in counts[k] else 0) / total[k][h] + discount[k] * kinds[k][h] / total[k][h] * low

    s = [" "] * (order - 1) + symbols(text)
    return -sum(math.log(p(s[:i], s[i], order)) for i in range(order - 1, len(s))) / (len(s) - order + 1)


def texts(seed, alphabet, n):
    rng = random.Random(seed)
    return [" ".join("".join(rng.choice(alphabet) for _ in range(rng.randrange(1, 7))) for _ in range(rng.randrange(1, 30))) for _ in range(n)]


def test_cross_entropy_is_that_of_the_definition(spark):
    known = {"x": texts(1, "abcdé", 12), "y": texts(2, "cdefñ", 9)}
    rows = common.prepare(spark).createDataFrame([(k, t) for k, ts in known.items() for t in ts], "lang string, text string")
    tried = ["abba dec", "ñef zz", "q", "a. B! é", *texts(3, "abcdef", 5)]
    for order in (2, 4):
        m = kneser_ney.train(rows, order)
        data = "".join(tried).encode()
        off = np.cumsum([0, *(len(t.encode()) for t in tried)])
        got, _ = m.cross_entropy(np.frombuffer(data, np.uint8), off)
        for d, t in enumerate(tried):
            for c, lang in enumerate(m.langs):
                assert abs(got[d, c] - brute_cross_entropy(known[lang], t, order)) < 1e-4, (t, lang)


def test_blocks_of_languages_change_nothing(spark, monkeypatch):
    rows = common.prepare(spark).createDataFrame([(f"l{k}", t) for k in range(5) for t in texts(k, "abcdefg"[k : k + 3], 10)], "lang string, text string")
    data = "abc cde efg".encode()
    whole = kneser_ney.train(rows, 3).cross_entropy(np.frombuffer(data, np.uint8), np.array([0, len(data)]))[0]
    monkeypatch.setattr(kneser_ney.Models, "BLOCK", 2)
    parts = kneser_ney.train(rows, 3).cross_entropy(np.frombuffer(data, np.uint8), np.array([0, len(data)]))[0]
    assert np.allclose(whole, parts, atol=1e-5)


def test_roles_of_labelled_rows(spark):
    made = [("en", f"text number {k}") for k in range(2000)] + [("de", f"nummer {k}") for k in range(10)] + [(None, "x"), ("en", None)]
    rows = common.prepare(spark).createDataFrame(made, "lang string, text string")
    got = Counter((r.lang, r.role) for r in kneser_ney.roles(rows).collect())
    assert got["de", 2] == 10 and got[None, None] == 1 and got["en", None] == 1
    assert got["en", 0] + got["en", 1] == 2000 and 150 < got["en", 1] < 350
    few = Counter((r.lang, r.role) for r in kneser_ney.roles(rows, max_rows=500).collect())
    assert 450 < few["en", 0] + few["en", 1] <= 500 and few["de", 2] == 10
    # Copies of a text are on one side.
    twice = kneser_ney.roles(rows.union(rows)).distinct().groupBy("lang", "text").count()
    assert twice.filter("count > 1").count() == 0


def test_rejection_is_calibrated(spark):
    """Rows of a learned kind stay, those of no learned kind go, whatever the spread of the language."""
    narrow, wide = texts(5, "abc", 400), texts(6, "mnopqrstuvw", 400)
    rows = [(k, t, "n") for k, t in enumerate(narrow)] + [(1000 + k, t, "w") for k, t in enumerate(wide)] + [(5000 + k, "жшщ ьъы " * 30, None) for k in range(3)]
    docs = common.prepare(spark).createDataFrame([(*r, "s", 1) for r in rows], "doc_id long, text string, lang string, source string, language int")
    kept = {r.doc_id for r in kneser_ney.keep_known(docs).collect()}
    assert not kept & {5000, 5001, 5002} and len(kept) > 0.99 * 800
    assert kneser_ney.keep_known(docs).columns == docs.columns
    assert kneser_ney.keep_known(docs.limit(0)).count() == 0
