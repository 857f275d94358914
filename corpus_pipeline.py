"""Corpus preparation: documents pass through STAGES, each written and read again."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodeframe.llm import _shared, bpe, decontam, langid, near_join, pii
from lodeframe.shipping import ship


def in_a_known_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rejects texts of which no known language is the likely one.

    Null and empty texts, and texts without letters, go; texts of fewer than twenty n-grams
    can't be judged and stay. Null ids and repeated rows are judged by their text. The languages
    are those of at most 400 labelled texts each; ties go to the first of the alphabet and
    don't matter here. An empty table stays empty. Very long texts are read whole, all columns kept.
    """
    ship(spark)
    return langid.keep_identified(docs, langid.fit(docs))


def one_of_each_group(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the document of lowest id of each group that near copies connect.

    Texts that are null, empty or without words are in no group and stay, as do rows with a null
    id. Repeated rows of the document that stays stay both. Similarity at the threshold counts;
    an empty table stays empty; all columns are kept. Ids are integers.
    """
    ship(spark)
    return near_join.drop_near_copies(docs)


def without_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that hold a test item, as a copy or edited.

    Null and empty texts and rows with a null id stay; repeated rows go or stay together. A score
    at the threshold counts. Without documents or test items nothing goes; all columns are kept.
    """
    ship(spark)
    return decontam.drop_leaks(docs, _shared.table(spark, sf_dir, "benchmark"))


def identifiers_masked(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Replaces personal and secret identifiers by their kind; n_chars is the new length.

    All rows and columns stay. Null and empty texts stay as they are (n_chars null and 0); equal
    texts are masked alike, whatever their id; of kinds in a tie the later in the alphabet is named.
    """
    ship(spark)
    return pii.mask(docs).withColumn("n_chars", F.length("text").cast("long"))


def encoded(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of each document that is left, and whether they decode to its text.

    A row for each row: null texts have nulls, empty ones no tokens; null ids and repeated rows
    stay. Columns other than id and text end here.
    """
    ship(spark)
    return bpe.encode(docs)


STAGES = [
    ("language_id", in_a_known_language),
    ("ngram_jaccard_join", one_of_each_group),
    ("benchmark_decontamination", without_benchmark),
    ("pii_masking", identifiers_masked),
    ("bpe_encoding", encoded),
]

#: Several stages can't be put in SQL; tests hold run() against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows that the last stage returns for the documents of sf_dir."""
    docs = _shared.table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = _shared.written(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
