"""Phrases mined by pivots against plain counting."""

import re
from collections import Counter

import duckdb
import numpy as np
import pyarrow as pa
import pytest

from loomwright.llm import collocations, queries

SCHEMA = "doc_id long, text string, lang string, phrase string, n string, part int"


def brute(docs, least, top, inside=80):
    f, n = Counter(), Counter()
    for _, text, lang, *_ in docs:
        lang = "und" if lang is None else lang
        low = re.sub("[A-Z]", lambda m: m.group().lower(), text or "")
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", low):
            w = re.findall(r"[^\x20\x09]+", piece)
            n[lang] += len(w)
            f.update((lang, tuple(w[i : i + k])) for k in range(1, 5) for i in range(len(w) - k + 1))
    found = {g: a for g, a in f.items() if len(g[1]) > 1 and a >= least}
    within = {}
    for (lang, p), a in found.items():
        for k in range(2, len(p)):
            for i in range(len(p) - k + 1):
                key = (lang, p[i : i + k])
                within[key] = max(within.get(key, 0), a)
    out = []
    for (lang, p), a in found.items():
        if 100 * within.get((lang, p), 0) < inside * a:
            cuts = [(2000000 * a // (f[lang, p[:k]] + f[lang, p[k:]]), k) for k in range(1, len(p))]
            score, k = min(cuts)
            out.append((lang, " ".join(p), a, f[lang, p[:k]], f[lang, p[k:]], n[lang], score))
    rows = []
    for lang in n:
        mine = sorted((r for r in out if r[0] == lang), key=lambda r: (-r[6], -r[2], r[1].encode()))
        rows += [(r[0], i + 1, *r[1:]) for i, r in enumerate(mine[:top])]
    return rows


def corpus(n=220, seed=2):
    """Few words, so that phrases repeat; a third of the documents are copies, one word is a third of all words."""
    rng = np.random.default_rng(seed)
    vocabulary = ["the", "of", "Zug", "été", "über", "a-b", "x'", "ÄÖ", "\x00z", "  ", "日本", "q", *(f"w{i}" for i in range(25))]
    docs = []
    for i in range(n):
        w = rng.choice(vocabulary, rng.integers(0, 60), p=np.array([12, 6, *([1] * (len(vocabulary) - 2))]) / (16 + len(vocabulary)))
        ends = rng.choice([" ", "  ", "\t", ". ", "\n", ",", "!?", "\x0b", "\r", "\x1c", " "], len(w), p=[0.6, 0.1, 0.1, 0.05, 0.05, 0.02, 0.02, 0.02, 0.02, 0.01, 0.01])
        docs.append((i, "".join(a + b for a, b in zip(w, ends)), ["en", "de", None, "und", ""][i % 5 if i % 7 else 0], "x", "y", 1))
    docs += [(1000 + i, docs[3][1] + docs[8][1], "en", None, None, None) for i in range(n // 3)]
    return docs + [(5000, None, "en", "x", "y", 1), (5001, "", None, "x", "y", 1), (5002, "the " * 3000, "fr", "x", "y", 1), (5003, " \t\n.,", "xx", "x", "y", 1), (None, "the of the of", "en", "x", "y", 1)]


@pytest.mark.parametrize("settings", [{}, {"TABLE": 6, "BUCKETS": 7, "PART": 20, "SLICE": 300, "FRAGMENTS": 50, "SPREAD": 3}, {"TABLE": 1, "BUCKETS": 3, "PART": 1 << 18, "SLICE": 2000}])
def test_phrases_equal_plain_counting(spark, monkeypatch, settings):
    for name, value in settings.items():
        monkeypatch.setattr(collocations, name, value)
    docs = corpus()
    df = spark.createDataFrame(docs, SCHEMA).repartition(3)
    found = collocations.collocations(df, least=4, top=60)
    want = brute(docs, 4, 60)
    assert sorted(tuple(r) for r in found.collect()) == sorted(want) and len(want) > 150
    assert {t for _, t in found.dtypes} == {"string", "bigint"} and collocations.collocations(df.limit(0)).collect() == []


def test_routed_fragments_go_to_the_rarest_word():
    codes, known = collocations.words([b"The of ZUG the. of Zug"])
    assert known.to_pylist() == [b"the", b"of", b"zug"] and codes.tolist() == [0, 1, 2, 0, -1, 1, 2, -1]
    rows, n, _ = collocations.fragments(codes, known, np.array([0, 1, 2]))
    got = {(tuple(r), c) for r, c in zip(rows.tolist(), n.tolist())}
    assert got == {((-1, 0, 1, 2, 0, -1, -1), 1), ((-1, -1, 1, 2, -1, -1, -1), 1), ((-1, -1, 0, 1, -1, -1, -1), 1)}
    # a word too rare for any phrase ends all fragments
    rows, _, _ = collocations.fragments(codes, known, np.array([0, 1, collocations.NONE]))
    assert rows.tolist() == [[-1, -1, 0, 1, -1, -1, -1]]


def test_equal_words_in_a_phrase_are_counted_once():
    codes, known = collocations.words([b"a a a a a"])
    rows, n, _ = collocations.fragments(codes, known, np.array([0]))
    assert int(n.sum()) == 4 and (rows[:, :3] == -1).all()
    assert pa.types.is_binary(known.type)


def test_query_equals_its_sql(spark):
    folder = "/root/testdata/sf0.01"
    got = queries.queries()["op11_collocations"](spark, folder).toPandas()
    con = duckdb.connect()
    con.sql(f"CREATE VIEW documents AS SELECT * FROM '{folder}/documents.parquet'")
    want = con.sql(queries.oracle_sql()["op11_collocations"]).df()[list(got.columns)]
    order = ["lang", "rank"]
    assert len(got) and got.sort_values(order).values.tolist() == want.sort_values(order).values.tolist()
