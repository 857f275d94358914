"""The training-data queries: each applies one operator to its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from lodeframe.llm import bpe, chat, decontam, imatch, langid, licenses, near_join, pii, repeats, warc
from lodeframe.llm import sql as O
from lodeframe.llm._shared import table
from lodeframe.shipping import ship

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE: dict[str, str] = {}


def query(oracle: str | None = None):
    def add(f: Query) -> Query:
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            ship(spark)
            return f(spark, sf_dir)

        QUERIES[f.__name__] = run
        if oracle is not None:
            ORACLE[f.__name__] = oracle
        return run

    return add


@query(O.NEAR_CLASSES)
def op2_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_join.near_classes(table(spark, sf_dir, "documents"))


@query()
def op1_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontam.leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


@query()
def op3_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return langid.identify(docs, langid.fit(docs))


@query()
def op4_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.encode(table(spark, sf_dir, "documents"))


@query(O.FINGERPRINTS)
def op5_imatch_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return imatch.fingerprints(table(spark, sf_dir, "documents"))


@query(O.CHAT)
def op6_chat_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chat.chat_windows(table(spark, sf_dir, "conversations"))


@query()
def op7_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan(table(spark, sf_dir, "documents"))


@query()
def op8_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.identifiers(table(spark, sf_dir, "documents"))


@query(O.REPEATS)
def op9_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeats.repeated_passages(table(spark, sf_dir, "documents"))


@query(O.WARC)
def op10_warc_derivatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.derivatives(warc.as_responses(table(spark, sf_dir, "pages")))
