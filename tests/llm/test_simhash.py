"""Fingerprints and groups against brute force."""

import random
import re

import pytest
import xxhash

from loomwright.llm import simhash

DOCS = "doc_id long, text string, fp string, component_id int"


def brute_fp(text):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    words = re.findall(r"[^\x20\x09-\x0D]+", low)
    if not words:
        return 0
    runs = [" ".join(words)] if len(words) < 3 else [" ".join(words[i : i + 3]) for i in range(len(words) - 2)]
    votes = [0] * 64
    for r in runs:
        h = xxhash.xxh64_intdigest(r.encode(), 42)
        for b in range(64):
            votes[b] += h >> b & 1
    return sum(1 << b for b in range(64) if 2 * votes[b] > len(runs))


def brute_groups(rows, radius=2):
    fps = [brute_fp(t) for _, t in rows]
    comp = {i: i for i in range(len(rows))}

    def find(x):
        while comp[x] != x:
            x = comp[x]
        return x

    for i in range(len(rows)):
        for j in range(i):
            if (fps[i] ^ fps[j]).bit_count() <= radius:
                a, b = find(i), find(j)
                comp[max(a, b)] = min(a, b)
    named = {}
    for i, (d, _) in enumerate(rows):
        if d is not None:
            named[find(i)] = min(d, named.get(find(i), d))
    return fps, [named.get(find(i)) for i in range(len(rows))]


def corpus(seed=1):
    rng = random.Random(seed)
    words = [f"w{i}é" for i in range(60)]
    base = [" ".join(rng.choices(words, k=rng.randrange(1, 90))) for _ in range(40)]
    texts = base + [b.upper().replace("É", "é") for b in base[:10]] + [base[0]] * 30
    long = " ".join(rng.choices(words, k=900))
    for _ in range(60):  # near copies of a long text
        w = long.split()
        for _ in range(rng.randrange(3)):
            w[rng.randrange(len(w))] = "x"
        texts.append(" ".join(w))
    texts += [None, "", " \t\n", "one", "One", "two words", "a\x0bb\x0cc\xa0d", "Ä ä", "x " * 20_000]
    rng.shuffle(texts)
    return list(enumerate(texts, 100))


@pytest.mark.parametrize("cap", [512, 3])
def test_groups_are_those_of_brute_force(spark, cap):
    rows = corpus() + [(None, "one"), (None, "nobody else has this text"), (100, "a repeated id")]
    df = spark.createDataFrame([(d, t, "clash", 1) for d, t in rows], DOCS)
    fps, groups = brute_groups(rows)
    found = simhash.near_duplicates(df, bucket_cap=cap).collect()
    want = sorted((str(d), f"{f:016x}", str(g)) for (d, _), f, g in zip(rows, fps, groups))
    assert sorted((str(r.doc_id), r.fingerprint, str(r.component_id)) for r in found) == want


def test_one_of_each_group_stays(spark):
    rows = corpus(2) + [(None, "alone and nameless here"), (None, "alone and nameless here"), (None, "one"), (300, "twice here"), (300, "twice here")]
    df = spark.createDataFrame([(d, t, "clash", 1) for d, t in rows], DOCS)
    kept = simhash.keep_one(df)
    assert kept.columns == df.columns
    _, groups = brute_groups(rows)
    named = sorted({g for g in groups if g is not None})
    found = kept.collect()
    assert sorted(r.doc_id for r in found if r.doc_id is not None) == named
    assert [r.text for r in found if r.doc_id is None] == ["alone and nameless here"]


def test_empty_table(spark):
    df = spark.createDataFrame([], DOCS)
    assert simhash.near_duplicates(df).count() == 0 and simhash.keep_one(df).count() == 0
