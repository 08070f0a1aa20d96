"""The keyword index against plain scans."""

import math
import re

import pytest
from pyspark.sql import functions as F

from loomwright.operators.inverted import TextIndex
from loomwright.operators.retrieval import text_topk

SF = "/root/testdata/sf0.001"


def brute(texts, query, k=20, by=lambda n: 1.0, phrase=False):
    wanted = re.findall(r"[^\W_]+", query.lower())
    out = []
    for i, text in texts.items():
        w = re.findall(r"[^\W_]+", (text or "").lower())
        if wanted and set(wanted) <= set(w) and (not phrase or any(w[j : j + len(wanted)] == wanted for j in range(len(w)))):
            out.append((-sum(x in wanted for x in w) / by(len(w)), i))
    return [(i, round(-s, 9), n + 1) for n, (s, i) in enumerate(sorted(out)[:k])]


def rows(found):
    return [(r.id, round(r.score, 9), r["rank"]) for r in found.orderBy("rank").collect()]


def test_index_equals_the_scan_through_changes(spark, tmp_path):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select(F.col("doc_id").alias("id"), "text")
    texts = {r.id: r.text for r in docs.collect()}
    index = TextIndex.create(spark, f"file://{tmp_path}/i", "long", buckets=16)
    index.build(docs.union(docs.limit(20)))
    scan = text_topk(docs, "the and of", 20, "id")
    assert rows(index.search("the AND of")) == rows(scan) == brute(texts, "the and of")
    change = {3: "and the of of of the", 4: None, 900_000: "The of, and\nthe of", 900_001: "nothing", 5: "was it"}
    index.upsert(spark.createDataFrame(list(change.items()), "id long, text string"))
    gone = sorted(texts)[10:40]
    index.delete(spark.createDataFrame([(i,) for i in gone] * 2, "id long"))
    index.upsert(docs.filter(F.col("id") == gone[0]))  # comes back as it was
    now = {i: t for i, t in (texts | change).items() if i not in gone[1:]}
    for _ in range(2):
        for query, k, kind, by in (("the and of", 20, "none", lambda n: 1.0), ("of", 7, "log", lambda n: 1 + math.log(n)), ("the of", 500, "length", float), ("nothing", 5, "none", lambda n: 1.0), ("?!", 5, "none", lambda n: 1.0), ("unheard", 5, "none", lambda n: 1.0)):
            assert rows(index.search(query, k, kind)) == brute(now, query, k, by)
        assert rows(index.search("of the of", 30, phrase=True)) == brute(now, "of the of", 30, phrase=True)
        index.optimize()
        assert all(base for _, base, _ in index.table.state().files.values())
    assert rows(TextIndex(spark, index.table.root).search("of", 3)) == brute(now, "of", 3)


def test_a_query_reads_the_buckets_of_its_words_only(spark, tmp_path):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select(F.col("doc_id").alias("id"), "text")
    index = TextIndex.create(spark, f"file://{tmp_path}/i", "long", buckets=256)
    index.build(docs)
    index.delete(docs.limit(1))
    all_buckets = {b for b, _, _ in index.table.state().files.values()}
    read = {int(f.split("_bucket=")[1].split("/")[0]) for f in index.search("the").inputFiles()}
    assert len(read) <= 16 < len(all_buckets) / 4  # eight parts of the word and of the marks


def test_odd_rows(spark, tmp_path):
    index = TextIndex.create(spark, f"file://{tmp_path}/i", buckets=4)
    made = spark.createDataFrame([("a", "x y"), ("a", "x y"), (None, "x"), ("b", None), ("c", "")], "id string, text string")
    with pytest.raises(ValueError):
        index.build(made.union(spark.createDataFrame([("a", "other")], "id string, text string")))
    index.build(made)
    assert rows(index.search("x")) == [("a", 1.0, 1)]
    with pytest.raises(ValueError):
        index.build(made)
    index.upsert(made.limit(0))
    assert rows(index.search("y x")) == [("a", 2.0, 1)]


def test_postings_are_rows_of_blocks(spark, tmp_path):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select(F.col("doc_id").alias("id"), "text")
    index = TextIndex.create(spark, f"file://{tmp_path}/i", "long", buckets=4)
    index.build(docs)
    each = sum(len(set(re.findall(r"[^\W_]+", (r.text or "").lower()))) for r in docs.collect())
    assert index.table.read().count() < each / 2
