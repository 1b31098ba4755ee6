"""A training corpus from ``documents``: stages that each read what the one before kept."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from sitegraph.llm.common import saved, table, without
from sitegraph.llm.decontaminate import leaks
from sitegraph.llm.mixing import mixed
from sitegraph.llm.ngram_join import one_of_each
from sitegraph.llm.token_files import token_table
from sitegraph.llm.toxicity import without_toxic


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the trained model does not reject, all columns as they are.

    Null and empty texts score like a text without words. Without labels of both classes
    every score is the share of toxic labels. Repeated rows share their fate; rows without
    doc_id are scored and never trained on.
    """
    return without_toxic(docs, table(spark, sf_dir, "labels"))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group: five-word shingles, similarity 0.8 or more.

    The smallest doc_id of a group stays, null ids last, and one row of it. Texts that are
    null, empty or blank are in no group and all stay, as do unlike texts of one doc_id.
    """
    return one_of_each(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without passages of the benchmark.

    A doc_id goes with all its rows if one of them holds a passage. Rows without doc_id, and
    null or empty texts, stay; benchmark items without text meet nothing.
    """
    return without(docs, leaks(docs, table(spark, sf_dir, "benchmark")))


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix of sources takes them: not at all, once or twice.

    A null source is a source. Texts without words have nothing to take and go; rows that
    repeat a doc_id, source and size share their copies evenly.
    """
    return mixed(docs)


def token_ids(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mix as files of token ids, read back: a row per document and copy.

    Null and empty texts are the end id alone. Rows without doc_id come first; equal doc_ids
    lie side by side. An empty table gives no rows.
    """
    import public_tokenizers

    return token_table(docs, public_tokenizers.path("word_bpe_49k.json"))


STAGES = [
    ("toxicity", toxicity),
    ("near_duplicates", near_duplicates),
    ("decontamination", decontamination),
    ("mixing", mixing),
    ("token_ids", token_ids),
]

#: trained scores and alignments are not SQL
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages one after another on ``documents``, each written and read again."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = saved(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
