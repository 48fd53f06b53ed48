"""Token files in the order of the table they were made from."""

from collections import Counter

import corpus_pipeline

from sunlattice.llm import common, hyper_mix, orc_tokens
from sunlattice.llm.queries import END_ID, tokenizer_path

SF = "/root/testdata/sf0.001"
COLUMNS = "doc_id long, text string, lang string, source string, n_chars long"


def test_files_keep_the_order_of_the_mix(spark):
    docs = common.saved(hyper_mix.mix(common.table(spark, SF, "documents")), "test-mix")
    # What the files of the mix hold, file by file.
    placed = docs.selectExpr("input_file_name() as file", "monotonically_increasing_id() as at", "doc_id").collect()
    want = [r.doc_id for r in sorted(placed, key=lambda r: (r.file, r.at))]
    got = corpus_pipeline.tokens(spark, docs, SF).collect()
    assert [r.doc_id for r in sorted(got, key=lambda r: r.start)] == want
    at = 0
    for r in sorted(got, key=lambda r: r.start):
        assert r.start == at
        at += r.n_tokens
    by_id = orc_tokens.round_trip(docs, tokenizer_path(), END_ID).collect()
    assert Counter((r.doc_id, r.n_tokens, r.ids_crc32) for r in got) == Counter((r.doc_id, r.n_tokens, r.ids_crc32) for r in by_id)
    assert [r.doc_id for r in sorted(by_id, key=lambda r: r.start)] == sorted(want)


def test_bloom_filters_and_row_indexes_are_written(spark, tmp_path):
    from pyarrow import orc

    path = f"file://{tmp_path}/tokens"
    orc_tokens.write(common.table(spark, "/root/testdata/sf0.01", "documents"), path, tokenizer_path(), END_ID, stripe_bytes=1 << 16)
    sizes = []
    for f in (tmp_path / "tokens").glob("*.orc"):
        data = orc.ORCFile(f)
        assert data.row_index_stride == 1000
        # Stripes hold index data besides their rows: row indexes and the filters of doc_id.
        sizes.append((data.nstripes, data.content_length, data.nrows))
        assert b"doc_id" in f.read_bytes()
    assert sum(n for _, _, n in sizes) == 1000


def test_stages_on_odd_and_empty_tables(spark):
    rows = [(1, None, None, None, None), (2, "", "en", "a", 0), (3, "word " * 30_000, "en", "a", None), (4, "one two", "de", None, 7), (4, "one two", "de", None, 7), (None, "no id", None, "b", 1), (5, "x", "en", "b", 1)]
    docs = common.prepare(spark).createDataFrame(rows, COLUMNS)
    for name, stage in corpus_pipeline.STAGES:
        empty = stage(spark, docs.limit(0), SF)
        assert empty.count() == 0
        out = stage(spark, docs, SF)
        if name != "token_output":
            assert out.columns == empty.columns == docs.columns
        ids = Counter(r.doc_id for r in out.select("doc_id").collect())
        if name == "decontamination":
            assert ids == Counter(r[0] for r in rows)
        if name == "token_output":
            assert ids == Counter(r[0] for r in rows) and out.agg(common.F.min("n_tokens")).first()[0] == 1
        assert set(ids) <= {r[0] for r in rows}


def test_pieces_have_the_ids_of_the_whole_tokenizer():
    """Every kind of character beside every other, in any case, composed or not."""
    import random

    import numpy as np
    from tokenizers import Tokenizer

    from sunlattice.llm.orc_tokens import Encoder
    from sunlattice.llm.queries import tokenizer_path

    draw = random.Random(3)
    letters = "abzABZ019 .,'’–<|>«»éÉñçßİıŸǅǈª²½­_^ \u0085\x1c\x1f\x07ΣσΑς中文é'sdtlrevm\n\t"
    rows = ["".join(draw.choices([*letters, "<|endoftext|>", "###"], k=draw.randint(0, 40))) for _ in range(4000)]
    whole = Tokenizer.from_file(tokenizer_path())
    want = [np.array(whole.encode(r, add_special_tokens=False).ids, "<u4").tobytes() for r in rows]
    # A small memory forgets words between and within calls.
    for kept in (300_000, 50):
        encoder = Encoder(tokenizer_path(), kept)
        assert [ids for i in range(0, len(rows), 100) for ids in encoder.encode([r.encode() for r in rows[i : i + 100]])] == want


def test_pieces_of_many_texts_are_found_at_once_and_learnt_once():
    """As a pattern finds them text by text: marks beside the ends of texts, other white space, special tokens, empty texts."""
    import random
    import re

    from tokenizers import Tokenizer

    from sunlattice.llm.orc_tokens import Encoder

    tail = re.compile(rb"(?<=[a-z0-9])([!-/:-@\[-`{-~]+)(?=[\x20\x09-\x0D]|\Z)")
    draw = random.Random(8)
    texts = ["".join(draw.choices("aZ9.,!<|>'é\x1c\x7f \t\n\x0b", k=draw.randint(0, 12))).encode() for _ in range(5000)]
    texts += [b"", b"ab.", b".", b"ab<|endoftext|>C.", b"x" * 70 + b"!"]
    encoder, learnt = Encoder(tokenizer_path()), []
    want = [t.split() if b"<|" in t else tail.sub(rb" \1", t.lower()).split() for t in texts]
    assert encoder.pieces(texts) == want
    learn = encoder.known.learn
    encoder.known.learn = lambda piece: learnt.append(piece) or learn(piece)
    got = encoder.encode(texts)
    assert encoder.encode(texts) == got and encoder.encode([]) == []
    assert len(learnt) == len(set(learnt)) and set(learnt) <= {p for w in want for p in w}
    whole = Tokenizer.from_file(tokenizer_path())
    assert [len(ids) // 4 for ids in got] == [len(whole.encode(t.decode(), add_special_tokens=False).ids) for t in texts]
