"""A corpus pipeline of five stages over the table documents.

Each stage reads what the one before it kept; run() writes each result as
Parquet in the shared folder and reads it again. All stages but the last return
the columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sunlattice.llm import hyper_mix, kneser_ney, orc_tokens, signature_tree, suffix_automaton
from sunlattice.llm.common import discard, doc_key, free_name, prepare, saved, table
from sunlattice.llm.queries import END_ID, tokenizer_path

#: Mixing, language scoring and the rest can't be told in SQL: the tests hold each stage against brute force.
ORACLE_SQL = None


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is known, `lang` being the one that was identified.

    Null texts and texts without a letter go, as their language is not known. Rows
    without a lang train nothing and stay if their language is accepted; repeated
    rows each stay or go; an empty table gives an empty one.
    """
    prepare(spark)
    return kneser_ney.keep_known(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str, percent: int = 90, width: int = 3) -> DataFrame:
    """One document of each group of linked ones: the one with the least id.

    Linked are documents whose sets of shingles of `width` words have a Jaccard similarity of `percent` / 100 or more.
    Documents without words are no group. Rows that repeat id and text are one document.
    Different texts with one id are documents of their own, in the order of their hashes;
    a null id comes before all others. Very long texts are compared whole, and an empty table gives an empty one.
    """
    prepare(spark)
    twice = docs.groupBy("doc_id").count().filter("count > 1")
    if twice.limit(1).count():
        return _first_of_each(docs, percent, width)
    found = signature_tree.jaccard_components(docs.select("doc_id", "text"), percent, width, all_links=False)
    return signature_tree.without(docs, found.filter(doc_key() != doc_key("component_id")))


def _first_of_each(docs: DataFrame, percent: int, width: int) -> DataFrame:
    """The same where ids repeat: on numbers of the different rows of id and text, which follow the order of both."""
    number, digest = free_name(docs.columns, "row_number"), free_name(docs.columns, "text_digest")
    one = docs.dropDuplicates(["doc_id", "text"]).withColumn(digest, F.sha2("text", 256))
    one = saved(one.repartitionByRange("doc_id", digest).sortWithinPartitions("doc_id", digest).withColumn(number, F.monotonically_increasing_id()), "pipeline-rows")
    found = signature_tree.jaccard_components(one.select(F.col(number).alias("doc_id"), "text"), percent, width, all_links=False)
    first = found.filter("doc_id = component_id").select(F.col("doc_id").alias("first_id"))
    return one.join(first, F.col(number) == F.col("first_id"), "left_semi").select(*docs.columns)


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The stage: near duplicates on five-word shingles at 0.8. The defaults above are those of op5; odd rows are as there."""
    return near_duplicates(spark, docs, sf_dir, 80, 5)


def decontaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the passages of benchmark items; those that are mostly such go.

    Null and empty texts stay as they are, and so do repeated rows, each on its own;
    an empty benchmark or table changes nothing.
    """
    return suffix_automaton.decontaminate(docs, table(spark, sf_dir, "benchmark"), 10, 0.5)


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mix: documents of each source as often as its target says, shuffled within each shard.

    A null source is one of its own, a null text has size 0, rows repeated with
    id and text are drawn together, and an empty table gives an empty mix.
    """
    prepare(spark)
    return hyper_mix.mix(docs)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 of the token files that were written, in the order of the mix.

    Documents are encoded where they are read: what was shuffled stays shuffled.
    A null or empty text is its end id alone, each repeated row is written, and an
    empty table gives no files.
    """
    return orc_tokens.round_trip(docs, tokenizer_path(), END_ID, by_id=False, words_kept=100_000)


STAGES = [("language_id", language), ("near_duplicates", near_copies), ("decontamination", decontaminated), ("mixing", mixed), ("token_output", tokens)]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, last = table(spark, sf_dir, "documents"), None
    for name, stage in STAGES[:-1]:
        docs = saved(stage(spark, docs, sf_dir), f"pipeline-{name}")
        # What a stage has read is no longer needed once its own table is written.
        if last is not None:
            discard(last)
        last = docs
    out = STAGES[-1][1](spark, docs, sf_dir)
    discard(docs)
    return out
