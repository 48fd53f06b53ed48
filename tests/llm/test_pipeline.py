"""Stages of the pipeline on a small table: what they keep and their columns."""

import corpus_pipeline
from test_operators import brute_components

from sunlattice.llm import common

SF = "/root/testdata/sf0.001"


def test_one_document_of_each_group_stays(spark):
    docs = common.table(spark, SF, "documents")
    rows = [tuple(r) for r in docs.select("doc_id", "text").collect()]
    kept = corpus_pipeline.near_duplicates(spark, docs, SF)
    assert kept.columns == docs.columns
    assert sorted(r.doc_id for r in kept.select("doc_id").collect()) == sorted(d for d, _, c in brute_components(rows) if d == c)


def test_language_stage_keeps_columns_and_clean_documents(spark):
    docs = common.table(spark, SF, "documents")
    kept = corpus_pipeline.language(spark, docs, SF)
    assert kept.columns == docs.columns
    assert 0.95 * docs.count() <= kept.count() <= docs.count()


def test_different_texts_with_one_id(spark):
    a, b = (" ".join(f"{x}{k}" for k in range(60)) for x in "ab")
    rows = [(3, a, "en"), (5, a + " more", "en"), (5, b, "en"), (5, b, "en"), (7, b, None), (None, a, "en"), (8, None, "en"), (8, "", "en"), (9, "two words", "x"), (9, "other words", "x")]
    docs = common.prepare(spark).createDataFrame(rows, "doc_id long, text string, row_number string").repartition(4)
    kept = corpus_pipeline.near_copies(spark, docs, SF)
    assert kept.columns == docs.columns
    want = [(None, a), (5, b), (8, None), (8, ""), (9, "two words"), (9, "other words")]
    assert sorted(((r.doc_id, r.text) for r in kept.collect()), key=repr) == sorted(want, key=repr)
    assert corpus_pipeline.near_copies(spark, docs.limit(0), SF).count() == 0
