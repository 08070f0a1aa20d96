"""Prompts from retrieved chunks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from loomwright.functions.text import trim_space
from loomwright.operators.retrieval import INTENT, mentions

MOST_CHARS = 12_000
NOTHING, NO_TITLE, NO_URL = "Không có tài liệu tham khảo nào.", "Không rõ tiêu đề", "Không rõ URL"


def entry(place: Column, title: Column, text: Column, url: Column) -> Column:
    return F.concat(F.lit("Tài liệu ["), place.cast("string"), F.lit("] - "), title, F.lit("\n"), text, F.lit("\nNguồn: "), url, F.lit("\n"))


def context(docs: DataFrame, query: str = "", most: int = MOST_CHARS) -> DataFrame:
    """place, entry of the docs(pos, title, text, source_url, chunk_type) that fit: nothing after the first that doesn't; a first one that is too long is cut."""
    d = docs.select("pos", "chunk_type", trim_space(F.coalesce("text", F.lit(""))).alias("text"), F.coalesce("title", F.lit(NO_TITLE)).alias("title"), F.coalesce("source_url", F.lit(NO_URL)).alias("url"))
    order = [F.when(F.col("chunk_type") == "attachment", 0).otherwise(1), F.col("pos")] if mentions(query, INTENT) else [F.col("pos")]
    # an entry has 20 characters at least, so that no more can fit: only these few rows get a place
    d = d.orderBy(*order).limit(most // 20 + 2).withColumn("place", F.row_number().over(Window.orderBy(*order)))
    whole = d.withColumn("entry", entry(F.col("place"), F.col("title"), F.col("text"), F.col("url")))
    room = F.lit(most) - F.length(entry(F.col("place"), F.col("title"), F.lit(""), F.col("url")))
    cut = F.when(room > 0, entry(F.col("place"), F.col("title"), F.concat(F.substring("text", F.lit(1), room), F.lit("...")), F.col("url")))
    fits = F.sum(F.length("entry")).over(Window.orderBy("place")) <= most
    return whole.withColumn("fits", fits).withColumn("entry", F.when(F.col("fits"), F.col("entry")).when(F.col("place") == 1, cut)).filter("entry is not null").select("place", "entry")


def prompt(entries: DataFrame, query: str) -> DataFrame:
    """One row: the prompt."""
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("place", "entry"))), lambda e: e["entry"]), "\n")
    made = entries.agg(text.alias("t")).select(F.when(F.col("t") == "", NOTHING).otherwise(F.col("t")).alias("t"))
    return made.select(F.concat(F.lit("[TÀI LIỆU THAM KHẢO]\n"), "t", F.lit(f"\n---\n[CÂU HỎI CỦA SINH VIÊN]\n{query}\n")).alias("prompt"))
