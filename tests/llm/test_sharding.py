"""The sharding operator's law, its groups and its edge cases."""

import zlib
from collections import Counter, defaultdict

import pytest

from loomwright.llm import sharding

SCHEMA = "doc_id long, text string, shard int, law string"


def rows_of(spark, texts, shards, start=0):
    df = spark.createDataFrame([(i + start, t, 99, "x") for i, t in enumerate(texts)], SCHEMA)
    return sharding.shard(df, shards).collect()


def holds(found, texts, shards):
    assert len(found) == len(texts)
    sizes = Counter(r["shard"] for r in found)
    assert all(0 <= s < shards for s in sizes)
    counts = [sizes.get(s, 0) for s in range(shards)]
    assert max(counts) - min(counts) <= 1
    slots = defaultdict(list)
    for r in found:
        slots[r["shard"]].append(r["slot"])
        t = (texts[r["doc_id"]] or "").encode()
        assert (r["size"], r["text_crc32"], r["law"], r["grown_shard"]) == (len(t) + 8, zlib.crc32(t), "rows", None)
    assert all(sorted(v) == list(range(len(v))) for v in slots.values())


def test_groups_stay_together(spark):
    texts = [f"text {i}" for i in range(300)] + [f"copy {i % 40}" for i in range(160)] + [None, None, ""]
    found = rows_of(spark, texts, 8)
    holds(found, texts, 8)
    of = defaultdict(set)
    for r in found:
        of[texts[r["doc_id"]]].add(r["shard"])
    assert all(len(v) == 1 for v in of.values())


@pytest.mark.parametrize("shards", [1, 3, 24])
def test_hot_group_is_split_evenly(spark, shards):
    texts = ["the same"] * 70 + [f"text {i}" for i in range(80)] + ["é" * 5000]
    found = rows_of(spark, texts, shards)
    holds(found, texts, shards)
    hot = Counter(r["shard"] for r in found if texts[r["doc_id"]] == "the same")
    assert len(hot) <= max(2, -(-70 // max(1, len(texts) // shards)) + shards // 3)


def test_few_rows_none_and_repeated(spark):
    holds(rows_of(spark, ["a", "a", "b"], 24), ["a", "a", "b"], 24)
    assert rows_of(spark, [], 24) == []
    df = spark.createDataFrame([(None, "a"), (None, "a"), (7, None), (7, None)], "doc_id long, text string")
    found = sharding.shard(df, 2).collect()
    assert sorted(Counter(r["shard"] for r in found).values()) == [2, 2]


def test_quotas_let_swaps_through_and_fill_room():
    assert sharding._quotas({(0, 1): 5, (1, 0): 3}, [10, 10], 10) == {(0, 1): 3, (1, 0): 3}
    assert sharding._quotas({(0, 1): 5, (2, 1): 4}, [0, 4, 0], 10) == {(0, 1): 5, (2, 1): 1}
