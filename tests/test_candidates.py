"""Trigram and JSON indexes against plain loops."""

import json
import math
import random
from decimal import Decimal

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from loomwright.operators import postings
from loomwright.operators.candidates import JsonIndex, TrigramIndex, literals, paths, variant_contains

SF = "/root/testdata/sf0.001"


def grams(text):
    text = (text or "").lower().replace("ς", "σ")
    return {text[i : i + 3] for i in range(len(text) - 2)}


def ids(found):
    return sorted(r.id for r in found.collect())


@pytest.fixture(scope="module")
def documents(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select(F.col("doc_id").alias("id"), "text")
    return docs, {r.id: r.text for r in docs.collect()}


def test_trigrams_equal_the_scan_through_changes(spark, documents, tmp_path):
    docs, texts = documents
    index = TrigramIndex.create(spark, f"file://{tmp_path}/i", "long", buckets=16)
    index.build(docs.union(docs.limit(20)))
    change = {3: "ΟΔΥΣΣΕΥΣ und 100% sicher_heit 😀😀😀 x", 4: None, 900_000: "ab", 900_001: "", 5: "Straße οδος"}
    index.upsert(spark.createDataFrame(list(change.items()), "id long, text string"))
    gone = sorted(texts)[10:40]
    index.delete(spark.createDataFrame([(i,) for i in gone] * 2, "id long"))
    index.upsert(docs.filter(F.col("id") == gone[0]))
    now = {i: t for i, t in (texts | change).items() if i not in gone[1:]}
    probe = next(t for i, t in sorted(now.items()) if t and i > 50 and len(t) > 300)
    low = lambda t: t.lower().replace("ς", "σ")
    for again in range(2):
        for part in ("😀😀😀", "ab", probe[17:200]) if again else ("The", "100%", "ΣΣ"):
            assert ids(index.contains(part)) == sorted(i for i, t in now.items() if t is not None and part in t), part
        assert ids(index.contains("THE", True)) == sorted(i for i, t in now.items() if t is not None and "the" in t.lower())
        assert ids(index.contains("οδυσσευΣ", True)) == [i for i, t in now.items() if t and low("οδυσσευΣ") in low(t)] == [3]
        assert ids(index.like(r"%100\% sicher\_h_it%")) == [3] and ids(index.like("ab")) == [900_000] and ids(index.like("%STRASSE%", True)) == []
        assert ids(index.like("%and%the%")) == ids(index.texts().filter("text like '%and%the%'"))
        for text, at_least in ((probe, 0.3),) if again else ((probe[:120], 0.05),):
            q, scores = grams(text), []
            for i, t in now.items():
                g = grams(t)
                if q and g and len(q & g) / len(q | g) >= at_least:
                    scores.append((-len(q & g) / len(q | g), i))
            found = [(r.id, r.score) for r in index.similar(text, at_least, 15).orderBy("rank").collect()]
            assert found == [(i, -s) for s, i in sorted(scores)[:15]]
        if not again:
            index.optimize()
            assert ids(TrigramIndex(spark, index.table.root).texts()) == sorted(now)


def test_patterns_of_six_characters_check_few_texts(spark, documents, tmp_path):
    docs, texts = documents
    index = TrigramIndex.create(spark, f"file://{tmp_path}/i", "long", buckets=64)
    index.build(docs)
    rng = random.Random(7)
    long = [t for t in texts.values() if len(t) > 50]
    for _ in range(3):
        text = rng.choice(long)
        at = rng.randrange(len(text) - 6)
        part = text[at : at + 6]
        low = part.lower()
        assert index.holding(part).count() == sum(low in t.lower() for t in texts.values())  # places name no text in vain
    read = {f.split("_bucket=")[1].split("/")[0] for f in index.holding("qzx").inputFiles()}
    assert len(read) <= 8


def test_postings_are_rows_of_blocks(spark, documents, tmp_path):
    docs, texts = documents
    index = TrigramIndex.create(spark, f"file://{tmp_path}/i", "long", buckets=4)
    index.build(docs)
    assert index.table.read().count() < sum(len(grams(t)) for t in texts.values()) / 5


def test_a_build_is_not_shuffled_and_places_are_packed(spark, tmp_path):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select(F.col("doc_id").alias("id"), "text")
    chars = docs.agg(F.sum(F.length("text"))).first()[0]
    store = spark.sparkContext._jsc.sc().statusStore()
    shuffled = lambda: sum(store.executorList(False).apply(i).totalShuffleWrite() for i in range(store.executorList(False).size()))
    index = TrigramIndex.create(spark, f"file://{tmp_path}/i", "long", buckets=4)
    before = shuffled()
    index.build(docs)
    assert shuffled() - before < chars / 20
    assert sum(f.stat().st_size for f in tmp_path.rglob("*.parquet")) < 2.5 * chars


def test_more_partitions_than_writing_tasks(spark, tmp_path):
    texts = {i: f"number {i} of many, abc" if i % 2 else f"def, number {i}" for i in range(1, 101)}
    index = TrigramIndex.create(spark, f"file://{tmp_path}/i", "long", buckets=2)
    index.build(spark.createDataFrame(list(texts.items()), "id long, text string").repartition(100, "id"))
    assert ids(index.holding("number 7")) == sorted(i for i, t in texts.items() if "number 7" in t)
    assert ids(index.contains("c")) == sorted(i for i, t in texts.items() if "c" in t) and ids(index.holding("many, abc")) == list(range(1, 101, 2))


def test_packed_places_equal_a_plain_loop():
    rng = random.Random(5)
    many = "".join(map(chr, [*range(0x3400, 0xD7FF), *range(0x20000, 0x24000)]))  # more kinds of characters than fit a number beside the place
    drawn = ["".join(rng.choice("abc é") for _ in range(rng.randrange(9))) for _ in range(2000)]
    for texts in ([], [None], ["", "a", "b", "c"], ["ab", "abc", "", "c", "abcabc", None, "😀😀😀"], ["x" * 300 + "yyy" + "x" * 20_000 + "yyy"], [many, many[::-1]], drawn):
        expected, at = {}, 0
        for t in (t or "" for t in texts):
            for i in range(len(t) - 2):
                expected.setdefault(t[i : i + 3], []).append(at + i)
            at += len(t)
        entries, starts, places, size = postings.of_trigrams(pa.array(texts, pa.string()))
        found = dict(zip(entries.to_pylist(), (postings.unpack(b).tolist() for b in postings.pack(starts, places).to_pylist())))
        assert found == expected and size.tolist() == [len(t or "") for t in texts]


def test_matches_lie_within_one_text(spark, tmp_path):
    index = TrigramIndex.create(spark, f"file://{tmp_path}/i", "long", buckets=2)
    index.build(spark.createDataFrame([(1, "xabc"), (2, "defx"), (3, ""), (4, None), (5, "ab"), (6, "cdef"), (7, "abcdef")], "id long, text string").coalesce(1))
    assert ids(index.holding("abcdef")) == [7] and ids(index.holding("abc", "def")) == [7] and ids(index.holding("cde")) == [6, 7] and ids(index.holding("zzz")) == []


def test_odd_rows(spark, tmp_path):
    index = TrigramIndex.create(spark, f"file://{tmp_path}/i", buckets=4)
    made = spark.createDataFrame([("a", "x yz"), ("a", "x yz"), (None, "x yz"), ("b", None), ("c", "")], "id string, text string")
    with pytest.raises(ValueError):
        index.build(made.union(spark.createDataFrame([("a", "other")], "id string, text string")))
    index.build(made)
    with pytest.raises(ValueError):
        index.build(made)
    index.upsert(made.limit(0))
    assert ids(index.contains("yz")) == ["a"] and ids(index.contains(" yz")) == ["a"] and ids(index.contains("")) == ["a", "c"]
    assert literals(r"a%b\_c__%\\") == ["a", "b_c", "\\"]
    for bad in ("a\\", r"\a"):
        with pytest.raises(ValueError):
            literals(bad)
    with pytest.raises(ValueError):
        index.similar("abc", 0.0)


def contains(a, b, top=True):
    if isinstance(b, dict):
        return isinstance(a, dict) and all(k in a and contains(a[k], x, False) for k, x in b.items())
    if isinstance(b, list):
        return isinstance(a, list) and all(any(contains(y, x, False) for y in a) for x in b)
    if top and isinstance(a, list):
        return any(contains(y, b, False) for y in a)
    return not isinstance(a, (dict, list)) and isinstance(a, bool) == isinstance(b, bool) and (a is None) == (b is None) and a == b


HELD = [
    '{"a": 1, "b": {"c": [1, 2, {"d": null}], "e": "x"}}', '{"a": 1.0}', '{"a": "1"}', '{"a": null}', "{}", "[]", "[1, 2, 2]", '[[1, 2], [3]]', '["x", null, true]', "5", "null", '"x"', "true", '{"a": true}',
    '{"it\'s": {"b c": 0.1}, "say \\"x\\"": 7}', '{"a": [{"k": 1, "m": 2}, {"k": 2}]}', '{"a": 9007199254740993}', '{"a": 9007199254740992}', '{"a": 1e2, "b": -0.0}', '{"a": 123456789012345678901234567890}', '{"a": {}}', '{"a": []}', '{"ä": "é😀"}',
]
WANTED = [
    {}, [], {"a": 1}, {"a": 1.0}, {"a": "1"}, {"a": None}, None, 5, "x", True, [1], [2, 1, 2], [[1]], [[]], [1, 3], {"b": {"c": [{"d": None}]}}, {"b": {"c": [2, 1], "e": "x"}}, {"it's": {"b c": 0.1}}, {"it's": {"b c": Decimal("0.1")}}, {'say "x"': 7},
    {"a": [{"k": 1}, {"k": 2}]}, {"a": [{"k": 1, "m": 2}]}, {"a": [{"k": 2, "m": 2}]}, {"a": 9007199254740993}, {"a": 9007199254740992}, {"a": 100}, {"b": 0}, {"a": {}}, {"a": []}, {"ä": "é😀"}, {"z": 1}, {"a": True}, 0, 1, [None, "x"],
]


def test_containment_equals_a_plain_loop(spark, tmp_path):
    held = {i: json.loads(t, parse_float=Decimal) for i, t in enumerate(HELD)}
    bad = {100: "{", 101: None, 102: "", 103: '{"a": 1, "a": 1}'}
    index = JsonIndex.create(spark, f"file://{tmp_path}/i", "long", buckets=4)
    rows = spark.createDataFrame([*enumerate(HELD), *bad.items()], "id long, text string")
    index.build(rows)
    expected = [sorted(i for i, a in held.items() if contains(a, w if not isinstance(w, float) else Decimal(str(w)))) for w in map(lambda w: json.loads(json.dumps(w, default=float), parse_float=Decimal), WANTED)]
    flags = rows.select("id", *(variant_contains(F.try_parse_json("text"), w).alias(f"w{n}") for n, w in enumerate(WANTED))).collect()
    for n, w in enumerate(WANTED):
        assert sorted(r.id for r in flags if r[f"w{n}"]) == expected[n], w
        assert all(r[f"w{n}"] is not None for r in flags)
    for n in range(0, len(WANTED), 4):  # and through the index
        assert ids(index.contains(WANTED[n])) == expected[n], WANTED[n]
    for w, e in zip(WANTED, expected):
        for i in e:
            assert set(paths(w)) <= set(paths(held[i])), (w, held[i])
    index.upsert(spark.createDataFrame([(0, '{"a": 2}'), (100, '{"a": 1}')], "id long, text string"))
    index.delete(spark.createDataFrame([(1,)], "id long"))
    assert ids(index.contains({"a": 1})) == [100]
    with pytest.raises(ValueError):
        index.contains({"'\"": 1})
    assert ids(index.contains({"a": {}}, lambda v: F.lit(None).cast("boolean"))) == []
    assert math.isclose(len(paths({"a": [1, 1.0, 2]})), 4)
