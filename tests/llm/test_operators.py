"""Each operator against brute force on a small table with odd rows, and on empty tables."""

import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest

from sunlattice.llm import common, html_render, hyper_mix, kneser_ney, line_alignment, lpt_shards, orc_tokens, quality_sketch, signature_tree, suffix_automaton, warc_zstd
from sunlattice.llm.components import components
from sunlattice.llm.queries import END_ID, tokenizer_path

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, label string, block int, contamination string, language string"
SPACED = re.compile(rb"[^\x20\x09-\x0D]+")
ALNUM = re.compile(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


@pytest.fixture(scope="module")
def rows(spark):
    found = [tuple(r) for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()]
    words = "sun ray shade Wall roof TREE été ß straße niño 日本 x1 42 a-b &c".split()
    rng = random.Random(5)
    long_ = " ".join(rng.choice(words) + str(rng.randrange(50)) for _ in range(60_000))
    base = [f"w{k}" for k in range(200)]
    odd = [None, "", " \t\n", "one", "One two", "one TWO", "a b  c", "x" * 50_000, long_, long_ + " end", "### $$$ <|endoftext|> q", "é café 'll 's", "\n\nsame line of eight words in it all here\nsame line of eight words in it all here\n"]
    for k in range(30):
        one = list(base)
        for _ in range(k % 5):
            one[rng.randrange(200)] = f"new{k}"
        odd.append(" ".join(one))
    out = found + [(1000 + k, t, [None, "en", "de"][k % 3], [None, "srcX"][k % 2], None) for k, t in enumerate(odd)]
    out += [out[-10], (None, "no id at all but words", None, None, None), (None, odd[14], "fr", "src1", 1)]
    return [(*r, "l", 1, "c", "g") for r in out]


@pytest.fixture(scope="module")
def docs(spark, rows):
    return common.prepare(spark).createDataFrame(rows, SCHEMA).repartition(5).cache()


@pytest.fixture(scope="module")
def none(spark):
    return common.prepare(spark).createDataFrame([], SCHEMA)


def lower(text):
    return (text or "").encode().lower()


def shingle_set(text):
    w = SPACED.findall(lower(text))
    return frozenset(tuple(w[i : i + 3]) for i in range(len(w) - 2)) if len(w) > 2 else frozenset([tuple(w)] if w else [])


def brute_components(rows, percent=90):
    sets = [shingle_set(r[1]) for r in rows]
    root = list(range(len(rows)))

    def find(a):
        while root[a] != a:
            a = root[a]
        return a

    for i in range(len(rows)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if both and 100 * both >= percent * (len(sets[i]) + len(sets[j]) - both):
                root[find(i)] = find(j)
    least = defaultdict(list)
    for i, r in enumerate(rows):
        if r[0] is not None:
            least[find(i)].append(r[0])
    return Counter((r[0], len(sets[i]), min(least[find(i)], default=None) if sets[i] else r[0]) for i, r in enumerate(rows))


def test_jaccard_components(docs, rows, none):
    got = signature_tree.jaccard_components(docs)
    assert Counter((r.doc_id, r.n_shingles, r.component_id) for r in got.collect()) == brute_components(rows)
    assert signature_tree.jaccard_components(none).count() == 0


def test_signature_tree_prunes_no_pair(monkeypatch):
    rng = np.random.default_rng(3)
    sets = []
    for _ in range(60):
        s = rng.integers(0, 2**63, rng.integers(3, 90)).astype(np.uint64)
        sets += [s, np.concatenate([s[: len(s) - len(s) // 12], rng.integers(0, 2**63, 1).astype(np.uint64)])]
    sizes = np.array([len(s) for s in sets])
    least = min(signature_tree._bits(len(s)) for s in sets) // 64
    bits = np.concatenate([signature_tree._fold(np.frombuffer(signature_tree._signature(s), "<u8")[None, :], least) for s in sets])
    order = np.argsort(sizes)
    labels = np.arange(len(sets))
    tree = signature_tree.Tree(sizes[order], labels[order], bits[order])
    a, b = tree.pairs(tree, 80)
    left = {frozenset((int(order[x]), int(order[y]))) for x, y in zip(a, b)}
    want = {frozenset((i, j)) for i in range(len(sets)) for j in range(i) if (n := len(np.intersect1d(sets[i], sets[j]))) * 100 >= 80 * (sizes[i] + sizes[j] - n)}
    assert want and want <= left


def test_search_over_blocks_of_hot_buckets(spark, monkeypatch):
    """Blocks of two: the pairs that are found stay the same."""
    monkeypatch.setattr(signature_tree, "BLOCK", 2)
    rng = random.Random(9)
    base = [f"t{k}" for k in range(120)]
    rows = []
    for k in range(40):
        one = list(base)
        for _ in range(rng.randrange(6)):
            one[rng.randrange(120)] = f"n{k}{rng.random()}"
        rows.append((k, " ".join(one)))
    got = signature_tree.jaccard_components(common.prepare(spark).createDataFrame(rows, "doc_id long, text string"))
    assert Counter((r.doc_id, r.n_shingles, r.component_id) for r in got.collect()) == brute_components(rows)


def test_components_of_paths(spark):
    edges = [(i, i + 1) for i in range(0, 40)] + [(100, 90), (90, 95), (7, 7)]
    got = {r.node: r.label for r in components(common.prepare(spark).createDataFrame(edges, "a long, b long")).collect()}
    assert got == {**{i: 0 for i in range(41)}, 100: 90, 90: 90, 95: 90}


def brute_quality(text):
    data = (text or "").encode()
    w = SPACED.findall(data)
    win = Counter(tuple(w[i : i + 3]) for i in range(len(w) - 2))
    hit = {i + k for i in range(len(w) - 2) if win[tuple(w[i : i + 3])] > 1 for k in range(3)}
    lines = [x for x in data.split(b"\n") if SPACED.search(x)]
    return len(w), sum(len(x.decode()) for x in w), sum(data.count(c.encode()) for c in "#*$%&|<>"), len(lines) - len(set(lines)), len(hit)


def test_quality_counts_and_keeps(docs, rows, none):
    got = quality_sketch.judge(docs).collect()
    assert Counter((r.doc_id, r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) for r in got) == Counter((r[0], *brute_quality(r[1])) for r in rows)
    for r in got:
        assert r.base_failed == (r.n_words < 50 or 100 * r.n_repeat_words > 50 * r.n_words)
        assert not (r.base_failed and r.kept)
    assert sum(r.kept for r in got) > 0.8 * sum(not r.base_failed for r in got)
    assert quality_sketch.judge(none).count() == 0


def test_sketch_quantiles_and_merging(spark):
    xs = [random.Random(4).expovariate(0.2) for _ in range(3000)]
    rows = spark.createDataFrame([("l", f"s{k % 3}", x) for k, x in enumerate(xs)], "lang string, source string, word_chars double").selectExpr("lang", "source", "word_chars", "1 n_words", "0 n_symbols", "0 n_lines", "0 n_dup_lines", "0 n_repeat_words")
    sketches = quality_sketch.sketch(rows)
    merged = quality_sketch.quantiles(quality_sketch.merge(sketches, "lang"), ["lang"], {"q1": 0.25, "q3": 0.75}).filter("ratio = 'word_length'").first()
    assert merged.n == 3000
    for q, v in ((0.25, merged.q1), (0.75, merged.q3)):
        assert abs(v / np.quantile(xs, q, method="inverted_cdf") - 1) < 0.0101
    zero = quality_sketch.quantiles(sketches, ["lang", "source"], {"q1": 0.5}).filter("ratio = 'symbol_share'").collect()
    assert [r.q1 for r in zero] == [0.0] * 3


def test_orc_round_trip(spark, docs, rows, none):
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(tokenizer_path())
    want = Counter()
    got = orc_tokens.round_trip(docs, tokenizer_path(), END_ID).collect()
    texts = list({r[1] or "" for r in rows})
    ids = {t: [*e.ids, END_ID] for t, e in zip(texts, tokenizer.encode_batch(texts, add_special_tokens=False))}
    for r in rows:
        x = ids[r[1] or ""]
        want[r[0], len(x), zlib.crc32(np.array(x, "<u4").tobytes())] += 1
    assert Counter((r.doc_id, r.n_tokens, r.ids_crc32) for r in got) == want
    at = 0
    for r in sorted(got, key=lambda r: r.start):
        assert r.start == at
        at += r.n_tokens
    by_start = [r.doc_id for r in sorted(got, key=lambda r: r.start)]
    assert by_start == sorted(by_start, key=lambda x: (x is not None, x))
    assert orc_tokens.round_trip(none, tokenizer_path(), END_ID).count() == 0


def test_encoder_equals_the_tokenizer():
    from tokenizers import Tokenizer

    rng, tokenizer, encoder = random.Random(6), Tokenizer.from_file(tokenizer_path()), orc_tokens.Encoder(tokenizer_path(), 50)
    parts = ["a", "B", "don't", "I'LL", ".", ",", ",,", ".)", "'", "é", "e\u0301", "É", "\u0301", "ß", "İ", "Σ", "1", "²", " ", "  ", "\n", "\u00a0", "\u2028", "\x1c", "…", "’", "<|endoftext|>", "<|ENDOFTEXT|>", "<|", "日本", "ﬁ", "\0", "🙂", "Straße,", "x.y", "3.14."]
    texts = ["".join(rng.choice(parts) for _ in range(rng.randrange(25))) for _ in range(4000)]
    want = [np.array(e.ids, "<u4").tobytes() for e in tokenizer.encode_batch(texts, add_special_tokens=False)]
    for i in range(0, len(texts), 7):
        assert encoder.encode([t.encode() for t in texts[i : i + 7]]) == want[i : i + 7]


def test_orc_lookup_prunes_and_encoder_forgets(spark, docs, rows):
    path = common.shared_dir(spark, "lookup")
    orc_tokens.write(docs, path, tokenizer_path(), END_ID, words_kept=40)
    some = orc_tokens.read(spark, path, common.F.col("doc_id").isin(7, 1008))
    plan = some._jdf.queryExecution().toString()
    assert "PushedFilters: [In(doc_id" in plan or "In(doc_id, [7,1008])" in plan
    got = {r.doc_id: r.ids for r in some.collect()}
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(tokenizer_path())
    for k in (7, 1008):
        assert got[k] == [*tokenizer.encode(next(r[1] for r in rows if r[0] == k), add_special_tokens=False).ids, END_ID]


def test_shards_hold_groups_and_are_even(docs, rows, none):
    got = lpt_shards.shard(docs, 4, 64).collect()
    assert Counter((r.doc_id, r.size, r.text_crc32) for r in got) == Counter((r[0], len((r[1] or "").encode()) + 1, zlib.crc32((r[1] or "").encode())) for r in rows)
    of_text, slots, load = defaultdict(set), defaultdict(list), Counter()
    for r in got:
        of_text[r.text_crc32, r.size].add(r.shard)
        slots[r.shard].append(r.slot)
        load[r.shard] += r.size
    assert all(len(x) == 1 for x in of_text.values())
    assert all(sorted(x) == list(range(len(x))) for x in slots.values())
    assert lpt_shards.shard(none, 4).count() == 0


def test_schedule_is_longest_first():
    units = [(1, 7), (2, 7), (3, 6), (4, 5), (5, 5), (6, 4), (7, 4)]
    got = lpt_shards.schedule(units, 3)
    load = Counter()
    for u, s in units:
        load[got[u]] += s
    assert max(load.values()) == 15 and sum(load.values()) == 38


def test_language_on_held_out_rows(spark, none):
    real = common.table(spark, "/root/testdata/sf0.01", "documents")
    held = zlib.crc32
    training = common.F.pmod(common.F.crc32(common.F.col("doc_id").cast("string").cast("binary")), common.F.lit(4)) != 2
    got = kneser_ney.identify(real, training).collect()
    lang = {r.doc_id: r.lang for r in real.select("doc_id", "lang").collect()}
    out = [r for r in got if held(str(r.doc_id).encode()) % 4 == 2]
    assert out and all(not r.in_training for r in out)
    assert sum(r.lang_pred == lang[r.doc_id] for r in out) > 0.98 * len(out)
    assert all(0 <= r.score <= 1 for r in got)
    assert sum(r.accepted for r in got) > 0.995 * len(got)
    assert kneser_ney.identify(none, common.F.lit(True)).count() == 0


def test_language_of_odd_texts(spark, docs, rows):
    got = kneser_ney.identify(docs, common.F.lit(True)).collect()
    assert Counter(r.doc_id for r in got) == Counter(r[0] for r in rows)
    by = {r.doc_id: r for r in got}
    for r in rows:
        if r[0] is not None and not any(c.isalpha() for c in r[1] or ""):
            assert (by[r[0]].lang_pred, by[r[0]].score, by[r[0]].accepted) == ("und", 0, False)
    untrained = kneser_ney.identify(docs, common.F.lit(False)).collect()
    assert {r.lang_pred for r in untrained} == {"und"}
    alien = spark.createDataFrame([(k, r[1], r[2]) for k, r in enumerate(rows) if r[2] == "en" and len(r[1] or "") > 300] + [(5000, "ьъы щшч " * 200, None)], "doc_id long, text string, lang string")
    judged = {r.doc_id: r.accepted for r in kneser_ney.identify(alien, common.F.col("doc_id") < 5000).collect()}
    assert judged.pop(5000) is False


def test_kneser_ney_is_a_distribution(spark):
    rows = spark.createDataFrame([("a", "abra cadabra abba"), ("b", "bob bab obo")], "lang string, text string")
    m = kneser_ney.train(rows, order=3)
    seen = "abrcdo z"
    for c, lang in enumerate(m.langs):
        own = set("abrcd z" if lang == "a" else "bao z")
        total = 0.0
        for x in seen:
            history = "ab" if lang == "a" else "bo"
            s = np.array([ord(y) if y != " " else 0 for y in history + x], np.uint32)
            grams = kneser_ney._grams(s, np.array([0, 3]), 3)
            start = [kneser_ney._hash(np.zeros((1, k + 1), np.uint32)) for k in range(3)]
            before = [np.concatenate([b, g[:-1]]) for b, g in zip(start, grams)]
            p = np.exp(m.logs(grams, before)[-1, c])
            total += p if x in own else 0
        assert abs(total - 1) < 1e-5


def brute_targets(sizes):
    order = sorted((k for k in sizes if k is not None)) + ([None] if None in sizes else [])
    weight = {k: (3, 1, 2)[i % 3] for i, k in enumerate(order)}
    left, live, out = 1.5 * sum(sizes.values()), set(order), {}
    while live:
        share = {k: left * weight[k] / sum(weight[x] for x in live) for k in live}
        over = {k for k in live if share[k] > 2 * sizes[k]}
        if not over:
            out |= share
            break
        for k in over:
            out[k] = 2 * sizes[k]
            left -= out[k]
        live -= over
    return out


def test_mix_targets_and_takes(docs, rows, none):
    got = hyper_mix.taken(docs).collect()
    source = defaultdict(int)
    for r in rows:
        source[r[3]] += len(SPACED.findall((r[1] or "").encode()))
    goal = brute_targets(source)
    n = {(r[0], len(SPACED.findall((r[1] or "").encode()))): r[3] for r in rows}
    taken, most = Counter(), Counter()
    for r in got:
        s = n[r.doc_id, r.size]
        assert r.source_size == source[s] and abs(r.target - goal[s]) < 1e-6 * max(1, goal[s])
        assert r.taken <= 2 * r.size and r.taken == r.size * len(r.shards)
        taken[s] += r.taken
        most[s] = max(most[s], r.size)
    for s in source:
        assert abs(taken[s] - goal[s]) <= most[s]
    assert sorted(map(tuple, got), key=str) == sorted(map(tuple, hyper_mix.taken(docs).collect()), key=str)
    assert hyper_mix.taken(none).count() == 0 and hyper_mix.mix(none).count() == 0
    mixed = Counter((r.doc_id, r.text) for r in hyper_mix.mix(docs).select("doc_id", "text").collect())
    by_id = Counter()
    for r in got:
        by_id[r.doc_id] += len(r.shards)
    again = Counter()
    for (k, _), c in mixed.items():
        again[k] += c
    assert again == Counter({k: v for k, v in by_id.items() if v})


def test_splitting_tree_is_exact():
    quotas = np.array([17, 0, 1000, 3, 250])
    parts = hyper_mix.split(quotas, 16, 1)
    assert (parts.sum(0) == quotas).all() and (parts >= 0).all()
    assert np.ptp(parts.sum(1)) <= 4
    mean = np.mean([hyper_mix.split(quotas, 16, s)[0] for s in range(300)], axis=0)
    assert np.allclose(mean, quotas / 16, rtol=0.15, atol=0.3)


def test_warc_round_trip(spark):
    page = "<html>" + "x" * 120
    rows = [(1, "http://a/\r\nb", page), (5, None, page), (3, "u", "short"), (2, "u", "short"), (9, "u", None), (8, "u", ""), (None, "u", page), (7, "u", "é" * 70_000), (4, "u", "\r\n\r\nWARC/1.1\r\n" * 20)]
    pages = common.prepare(spark).createDataFrame([(*r, "x") for r in rows], "page_id long, url string, html string, digest string").repartition(3)
    got = {r.page_id: r for r in warc_zstd.round_trip(pages).collect()}
    for k, _, h in rows:
        data = (h or "").encode()
        twin = k != 1 and h == page
        assert (got[k].payload_bytes, got[k].payload_digest) == (len(data), hashlib.sha256(data).hexdigest())
        assert (got[k].record_type, got[k].refers_to) == (("revisit", 1) if twin else ("response", None))
    assert warc_zstd.round_trip(pages.limit(0)).count() == 0


def test_warc_frames_and_dictionary(spark, tmp_path):
    import zstandard

    pages = common.table(spark, "/root/testdata/sf0.01", "pages")
    path = f"file://{tmp_path}/w"
    files = warc_zstd.write(pages, path, train_bytes=1 << 17).collect()
    assert sum(r.records for r in files) == pages.count()
    raw = (tmp_path / "w" / files[0].file).read_bytes()
    assert int.from_bytes(raw[:4], "little") == warc_zstd.DICTIONARY_MAGIC
    size = int.from_bytes(raw[4:8], "little")
    d = zstandard.ZstdCompressionDict(raw[8 : 8 + size])
    assert d.dict_id()
    one = zstandard.ZstdDecompressor(dict_data=d).decompressobj().decompress(raw[8 + size :])
    assert one.startswith(b"WARC/1.1\r\n") and one.count(b"WARC-Type: ") == 1 and one.endswith(b"\r\n\r\n")


def brute_marks(text, items, window=10):
    windows = defaultdict(set)
    for k, t in items:
        w = ALNUM.findall(lower(t))
        for i in range(max(1, len(w) - window + 1) if w else 0):
            windows[tuple(w[i : i + window])].add(k)
    w, hit, found = ALNUM.findall(lower(text)), set(), set()
    for n in {len(x) for x in windows}:
        for i in range(len(w) - n + 1):
            if k := windows.get(tuple(w[i : i + n])):
                hit |= set(range(i, i + n))
                found |= k
    return len(w), len(hit), len(found - {None}), hashlib.sha256(",".join(sorted(str(x) for x in found if x is not None)).encode()).hexdigest(), bool(hit)


def test_decontamination(spark, docs, rows, none):
    rng = random.Random(2)
    items = [(k, " ".join(rng.choice("abcd") for _ in range(rng.randrange(1, 30)))) for k in range(40)]
    items += [(100, "w5 w6 w7"), (101, "w20 w21 w22 w23 w24 w25 w26 w27 w28 w29 w30"), (102, None), (103, ""), (104, "..."), (105, "Straße, 日本"), (100, "w5 w6 w7"), (None, "sun7 ray1")]
    bench = spark.createDataFrame(items, "item_id long, text string")
    made = [(9000 + k, " ".join(rng.choice("abcde") for _ in range(rng.randrange(80))), "en", "s", 0, "l", 1, "c", "g") for k in range(60)]
    all_ = docs.union(spark.createDataFrame(made, SCHEMA))
    got = suffix_automaton.digest(suffix_automaton.mark(all_.select("doc_id", "text"), bench))
    want = Counter((r[0], *brute_marks(r[1], items)) for r in [*rows, *made])
    assert Counter((r.doc_id, r.n_words, r.n_hit, r.n_items, r.items_sha256, r.contaminated) for r in got.collect()) == want
    kept = suffix_automaton.decontaminate(all_, bench)
    assert kept.columns == all_.columns
    clean = {k[0] for k in want if not k[5]}
    left = {r.doc_id: r.text for r in kept.collect()}
    assert clean <= set(left)
    text = {r[0]: r[1] for r in [*rows, *made]}
    assert all(left[k] == text[k] for k in clean if k is not None)
    assert suffix_automaton.decontaminate(none, bench).count() == 0
    empty = spark.createDataFrame([], "item_id long, text string")
    assert suffix_automaton.decontaminate(docs, empty).count() == len(rows)
    with pytest.raises(ValueError):
        suffix_automaton.mark(docs, bench, max_words=10)


def test_line_alignment(spark, docs, rows, none):
    p = [f"passage line {k} with a good many words in it so" for k in range(4)]
    q = [f"own line {k} that no other document has in it" for k in range(20)]
    texts = [
        (1, "\n".join(q[:3] + p)),
        (2, "\n".join([q[4]] + p + [q[5]])),
        (3, "\n".join([q[6], p[2], p[3], "", q[7]])),
        (4, "\n".join([q[4]] + p + [q[5]])),
        (5, "\n".join([p[3], q[8], p[0]])),
        (6, None),
        (7, ""),
        (8, "short\nshort"),
        (9, "short\n" + q[9]),
        (None, q[0]),
    ]
    frame = common.prepare(spark).createDataFrame(texts, "doc_id long, text string")
    got = {r.doc_id: r for r in line_alignment.dedupe(frame).collect()}
    assert (got[1].n_removed, got[1].text) == (0, texts[0][1])
    assert (got[2].text, got[2].partners) == (f"{q[4]}\n{q[5]}", [1])
    assert got[3].text == f"{q[6]}\n\n{q[7]}" or got[3].text == f"{q[6]}\n{q[7]}"
    assert (got[4].text, got[4].n_removed, got[4].partners) == (None, 6, [2])
    assert got[5].n_removed == 1 and q[8] in got[5].text
    assert got[6].text is None and got[7].text == "" and got[8].n_removed == got[9].n_removed == 0
    assert got[None].n_removed == 1
    out = line_alignment.dedupe(docs)
    assert Counter(r.doc_id for r in out.collect()) == Counter(r[0] for r in rows)
    assert line_alignment.dedupe(none).count() == 0


def test_patience_blocks():
    assert line_alignment.align([1, 2, 3, 4], [9, 1, 2, 8, 3, 4]) == [(0, 1, 2), (2, 4, 2)]
    assert line_alignment.align([], [1]) == []
    rng = random.Random(1)
    for _ in range(300):
        a, b = ([rng.randrange(6) for _ in range(rng.randrange(12))] for _ in range(2))
        x = y = 0
        for i, j, n in line_alignment.align(a, b):
            assert i >= x and j >= y and n > 0 and a[i : i + n] == b[j : j + n]
            x, y = i + n, j + n


PAGES = [
    ("<title>t</title><p>a<p>b <b>c</b>\n d", "a\n\nb c d"),
    ("<body><ul><li>x<li>y<ol start=3><li>z</ol></ul>tail", "- x\n- y\n  3. z\n\ntail"),
    ("<table><tr><th>n<th>long head<tr><td>12345<td>x</table>", "n     | long head\n12345 | x"),
    ("a<script>var x='</p>';</script><style>p{}</style><!-- no -->b", "ab"),
    ('<div hidden>no</div><div style="display: none">no</div><p aria-hidden="true">no</p>yes', "yes"),
    ("<pre>\n a  b\n  c</pre>", " a  b\n  c"),
    ("x<br>y<hr>z", "x\ny\n\nz"),
    ("<details><summary>s</summary>gone</details>", "s"),
    ("<dl><dt>t<dd>d</dl>", "t\n  d"),
    ("a &amp; b &lt;c&gt; &eacute;", "a & b <c> é"),
    ("</p>a</div></span>b", "ab"),
    ("1 < 2 and <3", "1 < 2 and <3"),
    ("", ""),
]


@pytest.mark.parametrize(("page", "text"), PAGES)
def test_html(page, text):
    assert html_render.render(html_render.parse(page)) == text


def test_html_emits_all_visible_text_of_real_pages(spark):
    from html.parser import HTMLParser

    class Visible(HTMLParser):
        def __init__(self):
            super().__init__()
            self.skip, self.out = 0, []

        def handle_starttag(self, tag, attrs):
            self.skip += tag in ("script", "style", "title")

        def handle_endtag(self, tag):
            self.skip -= tag in ("script", "style", "title")

        def handle_data(self, data):
            if not self.skip:
                self.out.append(data)

    pages = common.table(spark, "/root/testdata/sf0.01", "pages")
    got = {r.page_id: r.text for r in html_render.extract(pages).collect()}
    for r in pages.collect():
        if "hidden" in r.html or "display:" in r.html.replace(" ", "") or "<noscript" in r.html:
            continue
        v = Visible()
        v.feed(r.html)
        v.close()
        want = Counter("".join("".join(v.out).replace("|", "").split()))
        have = Counter("".join(re.sub(r"(?m)^( *)(- |\d+\. )", "", got[r.page_id]).replace("|", "").split()))
        assert sum((want - have).values()) <= 0.02 * sum(want.values()), r.page_id
    odd = spark.createDataFrame([(1, None), (2, ""), (None, "<p>x"), (3, "<div>" * 20_000 + "deep")], "page_id long, html string")
    assert {r.page_id: r.text for r in html_render.extract(odd).collect()} == {1: None, 2: "", None: "x", 3: "deep"}
