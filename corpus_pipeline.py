"""A training corpus from raw documents: quality, language, near-duplicates, packing."""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from loomwright.llm import copies, gam, langid, packing, simhash
from loomwright.session import materialise


#: Rows of an Arrow batch, and chunks that a packing worker remembers: stages share executors whose heap is already in use.
BATCH_ROWS, KEPT_CHUNKS = 1000, 100_000


@contextmanager
def small_batches(spark: SparkSession) -> Iterator[None]:
    """Whole texts go through Python in small batches; afterwards the session is as before, so what is to be run must run inside."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(name)
    spark.conf.set(name, str(BATCH_ROWS))
    try:
        yield
    finally:
        spark.conf.set(name, before)


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier predicts to be bad go."""
    with small_batches(spark):
        return materialise(gam.keep_good(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")), "good")


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a language go."""
    with small_batches(spark):
        return materialise(langid.keep_identified(docs), "identified")


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates stays: the one with the smallest doc_id.

    Documents link at a Jaccard similarity of 0.8 of their 5-word shingles; op2's own links are 3 words and 2 bits.

    Rows that repeat id and text are one document. A document without an id goes only if its text is in a group
    with one that has an id, or with another without.
    """
    with small_batches(spark):
        return simhash.keep_one(docs, grouped=copies.near_duplicates, tags=copies.tags)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sequences of 2048 tokens, one row for each piece of a document."""
    with small_batches(spark):
        return packing.pack(docs, public_tokenizers.path("byte_bpe_50k.json"), kept=KEPT_CHUNKS)


STAGES = [("quality", quality), ("language", language), ("near_duplicates", near_duplicates), ("packing", pack)]

#: SQL can't express the classifier, the profiles or the tokenizer; tests/llm holds each stage against plain loops.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; each result is written as Parquet to the shared folder and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = stage(spark, docs, sf_dir)
        if name == "near_duplicates":  # the others have written what they return
            docs = materialise(docs, name)
    return docs
