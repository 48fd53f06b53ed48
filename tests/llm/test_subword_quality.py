"""The quality classifier: features against a plain count, held-out accuracy, odd rows, and that ids and labels stay out of scores."""

import zlib
from collections import Counter

import numpy as np

from sunlattice.llm import common, queries, subword_quality

SF = "/root/testdata/sf0.01"


def brute_pieces(text):
    """Words, repeats and runs of 3 and 4 characters with blanks at the edges only, as counted keys."""
    blank = lambda c: c in " \t\n\v\f\r"
    padded = "\n" + text + "\n"
    words = "".join(" " if blank(c) else c for c in text).split(" ")
    words = [w for w in words if w]
    out = Counter(("word", w) for w in words)
    out["repeat"] += sum(a == b for a, b in zip(words, words[1:]))
    for n in (3, 4):
        for k in range(len(padded) - n + 1):
            own = padded[k : k + n]
            if not any(blank(c) for c in own[1:-1]):
                out[n, own] += 1
    return out


def test_features_against_a_plain_count():
    texts = ["The the the cat", "", None, " été ÉTÉ 日本語 x\n\n y", "a" * 50, "\ud800 odd", "a b", "b a a"]
    buckets = 1 << 28
    got = [Counter() for _ in texts]
    for bucket, row in subword_quality.features(texts, buckets):
        for b, r in zip(bucket.tolist(), row.tolist()):
            got[r][b] += 1
    for t, g in zip(texts, got):
        want = brute_pieces(t or "")
        assert sum(g.values()) == sum(want.values()) and g[0] == want["repeat"]
        assert sorted(g.values()) == sorted(v for v in want.values() if v), t
    alone = subword_quality.bag(texts[0], buckets)[0]
    assert set(alone.tolist()) == set(got[0])


def labelled(spark, n=600):
    docs = [(k, ("good plain words of a text number %d " % k) * 5 if k % 3 else ("BAD!! LOUD!! %d " % k) * 9) for k in range(n)]
    labels = [(k, int(k % 3 > 0)) for k in range(n)]
    return docs, labels


def judged(spark, docs, labels, **more):
    d = common.prepare(spark).createDataFrame([(*x, 1, 0.5) for x in docs], "doc_id long, text string, quality int, score double").repartition(5)
    b = spark.createDataFrame(labels, "doc_id long, quality int")
    return subword_quality.judge(d, b, queries.F.lit(True), **more).collect()


def test_odd_rows_have_a_score(spark):
    docs, labels = labelled(spark)
    odd = [(9000, None), (9001, ""), (9002, " \n\t"), (None, "good plain words of a text"), (9004, "LOUD!! " * 100_000), (5, docs[5][1]), (5, "another text")]
    rows = judged(spark, docs + odd, labels + [(3, 1), (4, None), (None, 1), (7, 5), (10**9, 1), (6, 0), (6, 0)])
    assert len(rows) == len(docs) + len(odd) and all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.7) for r in rows)
    by = {r.doc_id: r for r in rows if r.doc_id is not None and r.doc_id >= 9000}
    assert by[9000].score == by[9001].score == by[9002].score and by[9004].predicted == 0
    assert next(r for r in rows if r.doc_id is None).predicted == 1
    right = [r.predicted == int(r.doc_id % 3 > 0) for r in rows if r.doc_id is not None and r.doc_id < 600]
    assert np.mean(right) > 0.98


def test_bounded_sample_and_reruns(spark):
    docs, labels = labelled(spark, 2000)
    first = judged(spark, docs, labels, max_rows=150)
    assert np.mean([r.predicted == int(r.doc_id % 3 > 0) for r in first]) > 0.98
    assert sorted(map(tuple, first)) == sorted(map(tuple, judged(spark, docs, labels, max_rows=150)))
    d = spark.createDataFrame(docs, "doc_id long, text string")
    b = spark.createDataFrame(labels, "doc_id long, quality int")
    size = lambda *most: subword_quality.training_rows(d, b, queries.F.col("doc_id") % 4 != 2, "quality", *most).agg({"text": "count", "doc_id": "sum"}).first()[0]
    assert 50 < size(100, 1 << 30) < 160 and 0 < size(10**6, 20_000) < 200 and size(10**6, 1 << 30) == 1500


def test_no_labels_and_empty_tables(spark):
    assert [r.score for r in judged(spark, [(1, "a text"), (2, None)], [])] == [0.5, 0.5]
    assert judged(spark, [], [(1, 1)]) == []


def test_held_out_accuracy(spark):
    rows = {r.doc_id: r for r in queries.op13_subword_quality(spark, SF).collect()}
    labels = spark.read.parquet(f"{SF}/labels.parquet").collect()
    out = [r for r in labels if zlib.crc32(str(r.doc_id).encode()) % 4 == 2]
    assert len(rows) == 1000 and all(rows[r.doc_id].held_out for r in out)
    assert np.mean([rows[r.doc_id].predicted == r.quality for r in out]) >= 0.97
