"""Profiles of chunk tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomwright.functions.text import hard_cut, junk_attachment, related_links


def profile(chunks: DataFrame, text: str = "text", id_col: str = "id", longest: int = 2000, shortest: int = 200) -> DataFrame:
    """One row: numbers, lengths, outliers, repeated ids and hard cuts."""
    n = F.length(text)
    return chunks.agg(
        F.count("*").alias("n"), F.round(F.avg(n), 2).alias("mean_chars"), F.max(n).alias("max_chars"), F.min(n).alias("min_chars"), F.count_if(n > longest).alias("too_long"),
        F.count_if(n < shortest).alias("too_short"), (F.count(id_col) - F.countDistinct(id_col)).alias("repeated_ids"), F.count_if(hard_cut(F.col(text))).alias("hard_cuts"),
    )


def kinds(chunks: DataFrame, kind: str = "chunk_type") -> DataFrame:
    """One row: chunks of each kind, and attachment parts that have a place; lengths are in profile()."""
    count = lambda v: F.count_if(F.col(kind) == v).alias(f"{v}_chunks")
    return chunks.agg(count("body"), count("attachment"), count("summary"), F.count_if((F.col(kind) == "attachment") & (F.col("attachment_chunk_index") >= 0)).alias("placed_parts"))


def source_profile(docs: DataFrame) -> DataFrame:
    """One row over docs(text, attachments array<struct<name>>): documents, junk attachments, documents with lists of related links, and these links."""
    junk = F.size(F.filter("attachments", lambda x: junk_attachment(x["name"])))
    links = F.size(related_links(F.coalesce("text", F.lit("")))["lines"])
    return docs.agg(F.count("*").alias("n_docs"), F.coalesce(F.sum(junk), F.lit(0)).alias("junk_attachments"), F.count_if(links > 0).alias("docs_with_links"), F.coalesce(F.sum(links), F.lit(0)).alias("links"))


def repeated(rows: DataFrame, key: str, n: int = 5) -> DataFrame:
    """The n most frequent values of key that come more than once."""
    return rows.groupBy(key).agg(F.count("*").alias("n")).filter("n > 1").orderBy(F.desc("n"), key).limit(n)


def status_counts(rows: DataFrame, status: str) -> DataFrame:
    """One map of counts by status."""
    counts = rows.groupBy(status).agg(F.count("*").alias("n")).filter(F.col(status).isNotNull())
    return counts.agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct(status, "n")))).alias("counts"))
