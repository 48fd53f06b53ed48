"""The queries of the training-data operators, each over its whole table, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sunlattice.llm import html_render, hyper_mix, kneser_ney, line_alignment, lpt_shards, orc_tokens, quality_sketch, ranked_search, signature_tree, subword_quality, suffix_automaton, vantage_tree, warc_zstd
from sunlattice.llm.common import table

TOKENIZER = "word_bpe_49k.json"
END_ID = 2


def tokenizer_path() -> str:
    import public_tokenizers

    return str(public_tokenizers.path(TOKENIZER))


def op1_line_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_alignment.digest(line_alignment.dedupe(table(spark, sf_dir, "documents"), moved=True))


def op2_html_render(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_render.digest(html_render.extract(table(spark, sf_dir, "pages"), painted=True))


def op3_quality_sketch(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = quality_sketch.judge(table(spark, sf_dir, "documents"))
    return judged.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def op4_orc_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    return orc_tokens.round_trip(table(spark, sf_dir, "documents"), tokenizer_path(), END_ID)


def op5_signature_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    joined = signature_tree.jaccard_components(table(spark, sf_dir, "documents").select("doc_id", "text"), 90)
    return joined.select("doc_id", "n_shingles", "component_id", "n_links")


def op6_lpt_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lpt_shards.shard(table(spark, sf_dir, "documents"), 16)


def held_out():
    return F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(4)) == 2


def op7_kneser_ney(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    found = kneser_ney.identify(docs, F.coalesce(~held_out(), F.lit(False)))
    return found.select("doc_id", F.coalesce(held_out(), F.lit(False)).alias("held_out"), "lang_pred", "score", "accepted")


def op8_hyper_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed = hyper_mix.taken(table(spark, sf_dir, "documents"))
    return mixed.select("doc_id", "size", "source_size", "target", "taken", "shards")


def op9_warc_zstd(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc_zstd.round_trip(table(spark, sf_dir, "pages"))


def op10_suffix_automaton(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return suffix_automaton.digest(suffix_automaton.mark(docs, table(spark, sf_dir, "benchmark"), 10))


def op11_ranked_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ranked_search.search(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), 10)


def op12_vantage_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    moved = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    vectors = table(spark, sf_dir, "embeddings").select("vec_id", moved.alias("label"), "embedding")
    return vantage_tree.mine(vectors, F.col("vec_id") % 100 == 0, 5, 5, (80, 100), 256)


def op13_subword_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = subword_quality.judge(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"), F.coalesce(~held_out(), F.lit(False)), "quality", 0.7)
    return judged.select("doc_id", F.coalesce(held_out(), F.lit(False)).alias("held_out"), "score", "predicted")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    named = [op1_line_alignment, op2_html_render, op3_quality_sketch, op4_orc_tokens, op5_signature_tree, op6_lpt_shards, op7_kneser_ney, op8_hyper_mix, op9_warc_zstd, op10_suffix_automaton, op11_ranked_search, op12_vantage_tree, op13_subword_quality]
    return {f.__name__: f for f in named}


def oracle_sql() -> dict[str, str]:
    return {"op9_warc_zstd": WARC_SQL, "op11_ranked_search": SEARCH_SQL, "op12_vantage_tree": NEGATIVES_SQL}


WARC_SQL = """
WITH p AS (
  SELECT page_id, coalesce(html, '') AS html FROM pages
), d AS (
  SELECT page_id, CAST(strlen(html) AS BIGINT) AS payload_bytes, sha256(html) AS payload_digest FROM p
), f AS (
  SELECT *, min(page_id) OVER (PARTITION BY payload_digest) AS first FROM d
)
SELECT page_id, payload_bytes, payload_digest,
  CASE WHEN payload_bytes >= 100 AND page_id <> first THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN payload_bytes >= 100 AND page_id <> first THEN first END AS refers_to
FROM f
"""

_TERMS = r"regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')"

SEARCH_SQL = f"""
WITH d AS (
  SELECT row_number() OVER () AS r, doc_id, {_TERMS} AS words FROM documents WHERE text IS NOT NULL
), size AS (
  SELECT r, doc_id, CAST(len(words) AS BIGINT) AS n FROM d WHERE len(words) > 0
), total AS (
  SELECT CAST(count(*) AS BIGINT) AS docs, CAST(sum(n) AS BIGINT) AS length FROM size
), item AS (
  SELECT DISTINCT item_id, term FROM (SELECT item_id, unnest({_TERMS}) AS term FROM benchmark)
), held AS (
  SELECT r, term, CAST(count(*) AS BIGINT) AS tf FROM (SELECT r, unnest(words) AS term FROM d) WHERE term IN (SELECT term FROM item) GROUP BY r, term
), weight AS (
  SELECT term, CAST(floor(1000 * ln((2 * any_value(docs) + 2)::DOUBLE / (2 * count(*) + 1)::DOUBLE)) AS BIGINT) AS w FROM held, total GROUP BY term
), score AS (
  SELECT item_id, doc_id, r, CAST(sum(w * ((1000000000 * tf) // (1000 * tf + 8 * (10 + (90 * n * docs) // length)))) AS BIGINT) AS score
  FROM item JOIN held USING (term) JOIN weight USING (term) JOIN size USING (r), total GROUP BY item_id, doc_id, r
), ranked AS (
  SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id NULLS LAST) AS rank FROM score WHERE score > 0
)
SELECT item_id, CAST(rank AS INTEGER) AS rank, doc_id, score FROM ranked WHERE rank <= 10
"""

NEGATIVES_SQL = """
WITH v AS (
  SELECT row_number() OVER () AS r, vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS x FROM embeddings
  WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), pair AS (
  SELECT a.r AS anchor, a.vec_id AS anchor_id, b.r AS other, b.vec_id AS other_id, a.label = b.label AS same, CAST(list_inner_product(a.x, b.x) AS BIGINT) AS score
  FROM v a, v b WHERE a.vec_id % 100 = 0 AND a.r <> b.r
), positive AS (
  SELECT *, row_number() OVER (PARTITION BY anchor ORDER BY score DESC, other_id) AS place FROM pair WHERE same
), negative AS (
  SELECT p.anchor_id, p.other_id AS positive_id, n.other_id AS negative_id, p.score AS positive_score, n.score AS negative_score,
    row_number() OVER (PARTITION BY p.anchor, p.other ORDER BY n.score DESC, n.other_id) AS rank
  FROM positive p JOIN pair n ON n.anchor = p.anchor AND NOT n.same AND 80 * p.score <= 100 * n.score AND n.score <= p.score WHERE p.place <= 5
)
SELECT anchor_id, positive_id, CAST(rank AS INTEGER) AS rank, negative_id, positive_score, negative_score FROM negative WHERE rank <= 5
"""
