"""Language profiles, sharding and the additive model against plain loops and exhaustive search."""

import itertools
import random
import zlib
from collections import Counter, defaultdict

import numpy as np

from loomwright.llm import gam, langid, sharding


def letter(c):
    """The letter's number, by the rule: a to z are 1 to 26, other letters share the rest, 0 is no letter."""
    if not c.isalpha():
        return 0
    return ord(c) - 96 if "a" <= c <= "z" else 27 + (ord(c) * 2_654_435_761 >> 7) % (langid.LETTERS - 27)


def plain_bundle(text):
    """The sum of the bound vectors of all trigrams, one by one."""
    third = langid._letter_vectors()[2].astype(int)
    found = [0]
    for c in (text or "").lower():
        if (k := letter(c)) or found[-1]:
            found.append(k)
    if found[-1]:
        found.append(0)
    total = np.zeros(langid.DIM, int)
    for a, b, c in zip(found, found[1:], found[2:]):
        if b:
            total += np.roll(third[a], 2) * np.roll(third[b], 1) * third[c]
    return total


def test_language_profiles_by_plain_loops(spark):
    rng = random.Random(3)
    words = {"aa": ["mar", "sol", "rio", "luz"], "bb": ["ström", "gård", "hus"], "cc": ["река", "мост"]}
    rows = [(i, " ".join(rng.choices(words[lang], k=rng.randrange(1, 30))) + rng.choice(["", "!", " 7"]), lang) for i, lang in enumerate(rng.choices(list(words), k=90))]
    rows += [(200, None, "aa"), (201, "123", "bb"), (202, "mar sol", None), (None, "gård", "bb"), (203, "İ ŉ ß", "aa"), (5, rows[5][1], rows[5][2])]
    for _, text, _ in rows:
        made = langid.bundle(text)
        assert np.array_equal(plain_bundle(text), np.zeros(langid.DIM) if made is None else made), text
    held = [i is not None and zlib.crc32(str(i).encode()) % 5 == 0 for i, _, _ in rows]
    sums = defaultdict(lambda: np.zeros(langid.DIM))
    for (i, text, lang), h in zip(rows, held):
        if i is not None and not h and lang is not None:
            sums[lang] += plain_bundle(text)
    want = []
    for (i, text, lang), h in zip(rows, held):
        v = plain_bundle(text).astype(float)
        if not any(c.isalpha() for c in text or ""):
            want.append((i, h, "und", 0.0))
            continue
        score, name = max(((v @ s / np.linalg.norm(v) / np.linalg.norm(s), k) for k, s in sorted(sums.items())), key=lambda p: p[0])
        want.append((i, h, name, max(0.0, score)))
    found = [tuple(r) for r in langid.identify(spark.createDataFrame(rows, "doc_id long, text string, lang string")).collect()]
    key = lambda r: (str(r[0]), r[2], round(r[3], 6))
    assert len(found) == len(want)
    for a, b in zip(sorted(found, key=key), sorted(want, key=key)):
        assert a[:3] == b[:3] and abs(a[3] - b[3]) < 1e-6


def cut(groups, place):
    """Links between equal texts whose ends are in different shards."""
    return sum(place[a] != place[b] for g in groups for a, b in itertools.combinations(g, 2))


def test_no_link_is_cut_where_an_exhaustive_search_cuts_none(spark):
    rng = random.Random(8)
    for shards, sizes in ((2, (3, 2, 1, 1, 1)), (2, (2, 2, 2, 1, 1)), (3, (2, 2, 1, 1, 1, 1, 1))):
        texts = [f"t{rng.random()}-{k}" for k, n in enumerate(sizes) for _ in range(1)]
        rows = [(i, t) for i, t in enumerate(t for t, n in zip(texts, sizes) for _ in range(n))]
        groups = defaultdict(list)
        for i, t in rows:
            groups[t].append(i)
        groups = list(groups.values())
        low, high = len(rows) // shards, -(-len(rows) // shards)
        least = min(cut(groups, p) for p in itertools.product(range(shards), repeat=len(rows)) if all(low <= c <= high for c in (Counter(p)[s] for s in range(shards))))
        found = sharding.shard(spark.createDataFrame(rows, "doc_id long, text string"), shards).collect()
        place = {r.doc_id: r["shard"] for r in found}
        assert least == 0 and cut(groups, place) == least, (shards, sizes, place)


def test_fewer_links_are_cut_than_by_chance(spark):
    rng = random.Random(2)
    texts = [f"group {k}" for k in range(60) for _ in range(rng.randrange(1, 12))] + [f"single {i}" for i in range(400)]
    found = sharding.shard(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), 6).collect()
    groups = defaultdict(list)
    for r in found:
        groups[texts[r.doc_id]].append(r.doc_id)
    place = {r.doc_id: r["shard"] for r in found}
    links = sum(len(g) * (len(g) - 1) // 2 for g in groups.values())
    assert cut(list(groups.values()), place) < 0.05 * links


def plain_score(model, x):
    """The additive model's score of one row, by scanning the edges."""
    total = model.base
    where = lambda edges, v: sum(v >= e for e in edges)
    for j, (edges, table) in enumerate(zip(model.edges, model.tables)):
        total += table[where(edges, x[j])]
    for (i, j), table in zip(model.pairs, model.pair_tables):
        total += table[where(model.pair_edges[i], x[i])][where(model.pair_edges[j], x[j])]
    return 1 / (1 + np.exp(-min(40, max(-40, total))))


def gain(parts):
    return sum(g**2 / (h + gam.LEAST) for g, h in parts)


def test_cuts_are_the_best_of_all():
    rng = np.random.default_rng(4)
    for n in (1, 2, 5, 9):
        g, h = rng.normal(size=n), rng.uniform(0.1, 1, n)
        found = gam._tree(g, h)
        ends = [0, *(k for k in range(1, n) if found[k] != found[k - 1]), n]
        # the first cut of a greedy tree is the best single one
        best = max([gain([(g[:k].sum(), h[:k].sum()), (g[k:].sum(), h[k:].sum())]) for k in range(1, n)], default=0.0)
        mine = gain([(g[a:b].sum(), h[a:b].sum()) for a, b in zip(ends, ends[1:])])
        assert len(ends) <= 4 and mine >= best - 1e-9
        for a, b in zip(ends, ends[1:]):
            assert np.allclose(found[a:b], g[a:b].sum() / (h[a:b].sum() + gam.LEAST))
    g, h = rng.normal(size=(4, 5)), rng.uniform(0.1, 1, (4, 5))
    parts = lambda i, j: [(g[a, b].sum(), h[a, b].sum()) for a in (slice(None, i), slice(i, None)) for b in (slice(None, j), slice(j, None))]
    best, i, j = max((gain(parts(i, j)), i, j) for i in range(1, 4) for j in range(1, 5))
    found, table = gam._quadrants(g, h)
    assert abs(found - (best - gain([(g.sum(), h.sum())]))) < 1e-9 and abs(table[0, 0] - parts(i, j)[0][0] / (parts(i, j)[0][1] + gam.LEAST)) < 1e-9


def test_quality_scores_by_plain_loops_and_labels_that_repeat(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text")
    labels = spark.read.parquet("/root/testdata/sf0.001/labels.parquet")
    odd = spark.createDataFrame([(90_001, None), (90_002, ""), (None, "a b")], "doc_id long, text string")
    every = docs.unionByName(odd).selectExpr("*", "7 as score", "'x' as held_out", "0 as predicted", "1 as quality", "'k' as label")
    model = gam.train(every, labels)
    rows = every.collect()
    found = {(r.doc_id, round(r.score, 9)): r for r in gam.classify(every, labels).collect()}
    assert gam.classify(every, labels).count() == len(rows)
    for r in rows:
        s = plain_score(model, gam.features(None if r.text is None else r.text.encode()))
        got = found[(r.doc_id, round(s, 9))]
        assert got.predicted == (s >= 0.5) and got.held_out == (r.doc_id is not None and zlib.crc32(str(r.doc_id).encode()) % 3 == 1)
    # labels and documents that repeat count once, ids with as many labels of each kind not at all
    again = labels.union(labels).union(labels)
    odd_ids = [r.doc_id for r in labels.collect() if zlib.crc32(str(r.doc_id).encode()) % 3 != 1][:2]
    torn = again.union(spark.createDataFrame([(90_003, 1, 0), (90_003, 0, 0)], labels.schema))
    twice = every.union(every.filter(every.doc_id.isin(odd_ids))).unionByName(spark.createDataFrame([(90_003, "torn label", 7, "x", 0, 1, "k")], every.schema))
    other = gam.train(twice, torn)
    assert all(np.array_equal(a, b) for a, b in zip(model.tables + model.pair_tables, other.tables + other.pair_tables)) and model.base == other.base
