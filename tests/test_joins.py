"""Range joins and many patterns against plain loops."""

import random

import pytest
from pyspark.sql import functions as F

from loomwright.functions.patterns import with_first_match
from loomwright.operators import retrieval

CHUNK = "chunk_id string, doc_id string, chunk_index int, chunk_type string, attachment_name string, attachment_index int, attachment_chunk_index int, text string"


@pytest.mark.parametrize("width", [0, 1, 4])
def test_neighbours_equal_a_loop(spark, width):
    rng = random.Random(width)
    chunks = [(f"{d}-{i}", d, i, rng.choice(["body", "summary"])) for d in ("a", "b", None) for i in [*range(-3, 60), None, 7]]
    hits = [(rng.choice(["a", "b", "c", None]), rng.choice([*range(-5, 70), None]), n, 1.0) for n in range(80)]
    found = retrieval.neighbours(spark.createDataFrame(hits, "doc_id string, chunk_index int, hit_rank int, score double"), spark.createDataFrame(chunks, "chunk_id string, doc_id string, chunk_index int, chunk_type string"), width)
    got = sorted((r.hit_rank, r.chunk_id) for r in found.collect())
    assert got == sorted((n, c) for d, at, n, _ in hits for c, e, i, kind in chunks if d is not None and d == e and None not in (at, i) and abs(at - i) <= width and kind != "summary")


def test_a_document_of_many_chunks_and_hits_never_meets_as_a_whole(spark):
    chunks = spark.range(200_000).select(F.lit("d").alias("doc_id"), F.col("id").cast("int").alias("chunk_index"), F.lit("body").alias("chunk_type"))
    hits = spark.range(2000).select(F.lit("d").alias("doc_id"), (F.col("id") * 97 + 3).cast("int").alias("chunk_index"), F.col("id").alias("hit_rank"), F.lit(1.0).alias("score"))
    found = retrieval.neighbours(hits, chunks, 2)
    assert found.count() == 2000 * 5
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    join = next(line for line in plan.split("\n") if "Join Inner" in line)
    assert "_own" in join and "chunk_index" in join  # the bin is a key and the range a condition of the join itself


def test_expansion_equals_loops(spark):
    rng = random.Random(5)
    rows = []
    for d in range(6):
        names = [None] + [f"file {d}{j}" for j in range(3)]
        for i in range(40):
            name = rng.choice(names)
            kind = rng.choice(["body", "body", "summary"]) if name is None else rng.choice(["attachment"] * 4 + ["summary"])
            rows.append((f"{d}-{i}", f"doc{d}", None if i == 39 else i, kind, name, None if name is None else names.index(name), rng.randrange(8) if kind == "attachment" else -1, f"t{i}"))
    picked = rng.sample(rows, 25)
    hits = [(r[0], 1.0 - n / 100, n + 1) for n, r in enumerate(picked)]
    by_id = {r[0]: r for r in rows}
    for query, width in (("mẫu", 1), ("x", 2)):
        best = {}

        def add(chunk, rank, phase, score):
            if chunk not in best or (rank, phase) < best[chunk][:2]:
                best[chunk] = (rank, phase, score)

        for c, score, rank in hits:
            _, doc, at, kind, name, _, part, _ = by_id[c]
            add(c, rank, 0, score)
            near = [r for r in rows if r[1] == doc]
            attached = [r for r in near if r[3] == "attachment"]
            own = [r for r in attached if r[4] == name and name is not None]
            if kind == "body":
                for r in near:
                    if None not in (r[2], at) and abs(r[2] - at) <= width and r[3] != "summary":
                        add(r[0], rank, 1, score * 0.8)
                if query == "mẫu":
                    for r in sorted(attached, key=lambda r: (r[5], r[6], -1 if r[2] is None else r[2], r[0]))[:3]:
                        add(r[0], rank, 2, score * 0.7)
            elif kind == "attachment":
                for r in own:
                    if len(own) <= 5 or abs(r[6] - part) <= width:
                        add(r[0], rank, 1, score * 0.8)
            elif name is not None:
                for r in own:
                    add(r[0], rank, 1, score * 0.9)
            else:
                for r in sorted((r for r in near if r[3] in ("body", "attachment")), key=lambda r: (-1 if r[2] is None else r[2], r[0]))[:10]:
                    add(r[0], rank, 1, score * 0.9)
        found = retrieval.expand(spark.createDataFrame(hits, "chunk_id string, score double, rank int"), spark.createDataFrame(rows, CHUNK), query, width).collect()
        assert {r.chunk_id: (r.hit_rank, r.phase, round(r.score, 9)) for r in found} == {c: (a, b, round(s, 9)) for c, (a, b, s) in best.items()}


@pytest.mark.parametrize("most", [100_000, 700])
def test_first_of_many_patterns(spark, most):
    rng = random.Random(9)
    word = lambda n: "".join(rng.choice("abé/.") for _ in range(n))
    patterns = [(n, word(rng.randrange(2, 9))) for n in range(5000)] + [(6000, "a" * 30), (6001, None), (None, "b"), (4, "aaaa"), (-1, "aaaaa")]
    texts = [word(rng.randrange(0, 40)) for _ in range(300)] + [None, "", "a" * 40, "zzz"]
    rows = spark.createDataFrame(list(enumerate(texts)), "id int, text string").repartition(3)
    signs = spark.createDataFrame(patterns, "place int, pattern string")
    if most < 5000:
        patterns, signs = patterns[-1400:], spark.createDataFrame(patterns[-1400:], "place int, pattern string")
    found = with_first_match(rows, F.col("text"), signs, "pos", most)
    assert "NestedLoop" not in found._jdf.queryExecution().executedPlan().toString()
    want = {i: min((p for p, x in patterns if p is not None and x is not None and t is not None and x in t), default=None) for i, t in enumerate(texts)}
    assert {r.id: r.pos for r in found.collect()} == want
    empty = with_first_match(rows, F.col("text"), spark.createDataFrame([(3, ""), (1, "a")], "place int, pattern string"), "pos")
    assert {r.id: r.pos for r in empty.collect()} == {i: None if t is None else 1 if "a" in t else 3 for i, t in enumerate(texts)}
    assert with_first_match(rows, F.col("text"), signs.limit(0), "pos").filter("pos is not null").count() == 0
