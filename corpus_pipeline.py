"""A corpus from raw documents to token counts, in stages that each read what the one before wrote."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tracewell.llm import bpe, decontam, langid, near_dedup, secret_scan
from tracewell.llm.store import written


def identified(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in a known language, with the predicted one where lang is null; those without letters go, and those less than a third
    as like any language as documents of their length are in the median."""
    learning = docs.where(~langid.held_out(F.col("doc_id")))
    languages, profiles = langid.learn(learning)
    return langid.in_a_language(docs, languages, profiles, langid.least_scores(learning, languages, profiles))


def deduplicated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row, that with the least doc_id, of each group of near copies (five-word shingles, similarity 0.8).

    Rows are judged, not ids: of a group's rows, whether they repeat an id or have none, one stays (one with an id if there is any),
    and rows of other texts stay whatever id they share. Texts without words are in no group.
    """
    return near_dedup.one_of_each(docs)


def decontaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a ten-word window of a benchmark item (or all of a shorter item)."""
    return decontam.clean(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def redacted(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with a sign in place of each secret; n_chars follows the text."""
    return secret_scan.without_secrets(docs, secret_scan.thresholds(docs))


def encoded(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token counts and checksums of the ids and of the text decoded from them."""
    return bpe.round_trip(docs)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("language ID", identified),
    ("MinHash near-dedup", deduplicated),
    ("benchmark decontamination", decontaminated),
    ("secret scans", redacted),
    ("BPE encoding and decoding", encoded),
]

#: Language ID and tokenisation have no SQL; tests/llm holds the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
