"""Near copies against brute force."""

import random

import pytest

import corpus_pipeline
from loomwright.llm import copies, simhash

DOCS = "doc_id long, text string, clash string"


def brute_groups(texts):
    sets = []
    for t in texts:
        w = (t or "").lower().split()
        sets.append({" ".join(w[i : i + 5]) for i in range(max(1, len(w) - 4))})
    comp = list(range(len(texts)))

    def find(x):
        while comp[x] != x:
            x = comp[x]
        return x

    for i in range(len(texts)):
        for j in range(i):
            if len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j]):
                a, b = find(i), find(j)
                comp[max(a, b)] = min(a, b)
    return [find(i) for i in range(len(texts))]


def corpus():
    rng = random.Random(5)
    words = [f"w{i}" for i in range(900)]
    texts = []
    for _ in range(25):
        base = rng.choices(words, k=rng.randrange(40, 300))
        for edits in (0, 0, 1, 2, 3, 5, 8):
            w = list(base)
            for _ in range(edits):
                w[rng.randrange(len(w))] = "edited"
            texts.append(" ".join(w))
    short = rng.choices(words, k=60)
    for _ in range(90):  # one-word edits of a short text: only edits near each other, or the text itself, are within 0.8
        w = list(short)
        w[rng.randrange(60)] = f"x{rng.randrange(50)}"
        texts.append(" ".join(w))
    texts += [None, "", " \t", "one", "One", "five words are one run", "six words are of two runs"]
    rng.shuffle(texts)
    return texts


def chain():
    """A large group of near copies of near copies, most of which are like none of its centre, and texts that share a long passage only."""
    rng = random.Random(9)
    words = [f"v{i}" for i in range(900)]
    base = rng.choices(words, k=150)
    texts = [list(base)]
    for _ in range(170):
        w = list(rng.choice(texts[-40:]))
        for _ in range(rng.randrange(1, 4)):
            w[rng.randrange(len(w))] = rng.choice(words)
        texts.append(w)
    passage = rng.choices(words, k=120)
    texts += [[*rng.choices(words, k=rng.randrange(10, 90)), *passage, *rng.choices(words, k=5)] for _ in range(90)]
    return [" ".join(w) for w in texts]


@pytest.mark.parametrize("made,cap,block", [("corpus", 32, 512), ("corpus", 2, 16), ("chain", 32, 512), ("chain", 4, 16)])
def test_groups_are_those_of_brute_force(spark, monkeypatch, made, cap, block):
    monkeypatch.setattr(copies, "BLOCK", block)
    monkeypatch.setattr(copies.links, "__defaults__", (cap, block))
    texts = {"corpus": corpus, "chain": chain}[made]()
    df = spark.createDataFrame([(i, t, "") for i, t in enumerate(texts)], DOCS)
    found = {r.doc_id: r.component_id for r in copies.near_duplicates(df, bucket_cap=cap).collect()}
    assert [found[i] for i in range(len(texts))] == brute_groups(texts)


def test_the_stage_drops_copies_with_edited_words(spark):
    base = [f"w{i * i % 997}" for i in range(200)]
    edited = [*base[:100], "edited", *base[101:]]
    rows = [(1, " ".join(base), ""), (2, " ".join(edited), ""), (3, " ".join(reversed(base)), ""), (None, " ".join(base), ""), (None, "nameless text", ""), (None, "nameless text", "")]
    df = spark.createDataFrame(rows, DOCS)
    assert len({simhash.fingerprint(t.encode()) for _, t, _ in rows[:2]}) == 2
    out = corpus_pipeline.near_duplicates(spark, df, "").collect()
    assert sorted((str(r.doc_id), r.text[:8]) for r in out) == sorted([("1", rows[0][1][:8]), ("3", rows[2][1][:8]), ("None", "nameless")])


def test_simhash_gives_candidates_by_multi_index_hashing(spark, monkeypatch):
    """Each group of fingerprints within 2 bits of each other is checked from its first set, and these links need no band."""
    asked = []
    monkeypatch.setattr(simhash, "links", lambda fps, *a, plain=simhash.links: asked.append(fps.count()) or plain(fps, *a))
    base = [f"w{i * i % 997}" for i in range(3000)]
    texts = [" ".join(base), " ".join([*base[:-1], "other"]), " ".join(f"v{i * 7 % 991}" for i in range(300)), " ".join(base[:4])]
    prints = [simhash.fingerprint(t.encode(), copies.SHINGLE) for t in texts]
    assert (int.from_bytes(prints[0]) ^ int.from_bytes(prints[1])).bit_count() <= 2
    df = spark.createDataFrame([(i, t, "") for i, t in enumerate(texts)], DOCS)
    assert [r.component_id for r in copies.near_duplicates(df).orderBy("doc_id").collect()] == [0, 0, 2, 3]
    assert asked == [len(set(prints))]
    rows = [(copies.name(x), int.from_bytes(simhash.majority(x.astype(">u8").view("u1").reshape(-1, 8)), signed=True)) for x in (copies.shingles(t.encode()) for t in texts)]
    assert [{r.a, r.b} for r in copies.seeds(spark.createDataFrame(rows, "fp long, print long")).collect()] == [{rows[0][0], rows[1][0]}]
