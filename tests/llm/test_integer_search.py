"""Exact top-k and hard negatives against brute force with Python's integers."""

import math

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from loomwright.llm import exact_topk, hard_negatives, queries

SCHEMA = "vec_id long, embedding array<double>, label int, score string, s long, found string"
NAN = float("nan")


def made(n=260, d=6, seed=3):
    """Vectors of unlike lengths, a third of them one vector, some repeated rows, and rows that take no part."""
    rng = np.random.default_rng(seed)
    x = rng.normal(size=(n, d)) * rng.uniform(0.1, 3, (n, 1))
    x[n // 3 : 2 * n // 3] = x[0]
    x[5] = 0
    rows = [(int(i) - 20, v.tolist(), None if i == 9 else int(0 if i % 3 else i % 11), "x", 1, "y") for i, v in enumerate(x)]
    odd = [None, [NAN] * d, [1.0] * (d - 1) + [None], [1e308] * d]
    return rows + rows[40:60] + [(7000 + i, v, 1, "x", 1, "y") for i, v in enumerate(odd)] + [(None, [1.0] * d, 1, "x", 1, "y")] + [(8000 + 50 * i, [1.0, float(i)], i % 2, None, None, None) for i in range(7)] + [(9000, [], 1, "x", 1, "y"), (9050, [], 1, "x", 1, "y"), (9100, [], 2, "x", 1, "y")]


def whole(v, factor):
    if v is None or any(x is None or not math.isfinite(x * factor) for x in v):
        return None
    return tuple(math.floor(x * factor) for x in v)


def dot(a, b):
    return sum(x * y for x, y in zip(a, b))


def brute_topk(rows, asked, top=10, factor=1024):
    x = {r[0]: v for r in rows if r[0] is not None and (v := whole(r[1], factor)) is not None}
    out = set()
    for q in x:
        if asked(q):
            found = sorted((-dot(x[q], v), i) for i, v in x.items() if i != q and len(v) == len(x[q]))[:top]
            out |= {(q, n + 1, i, -s) for n, (s, i) in enumerate(found)}
    return out


@pytest.mark.parametrize("head,block", [(2048, None), (12, 16), (1, 50)])
def test_topk_equals_brute_force(spark, monkeypatch, head, block):
    monkeypatch.setattr(exact_topk, "QUERIES", 20)
    monkeypatch.setattr(exact_topk, "STEP", 16)
    rows = made()
    df = spark.createDataFrame(rows, SCHEMA)
    found = exact_topk.search(df, df.filter("vec_id % 5 = 0"), head=head, block=block)
    assert {tuple(r) for r in found.collect()} == brute_topk(rows, lambda q: q % 5 == 0)
    assert found.dtypes == [("query_id", "bigint"), ("rank", "int"), ("vec_id", "bigint"), ("score", "bigint")]


def test_topk_of_few_huge_and_no_vectors(spark):
    rows = [(i, [v, 1.0], 0, "x", 1, "y") for i, v in enumerate([1e15, -1e15, 3e14, 1e-9, 1e250])]
    df = spark.createDataFrame(rows, SCHEMA)
    clip = lambda s: max(-(2**63 - 2), min(2**63 - 2, s))
    x = [whole(r[1], 1024) for r in rows]
    want = set()
    for q in range(5):
        order = sorted((-clip(dot(x[q], x[i])), i) for i in range(5) if i != q)
        want |= {(q, n + 1, i, -s) for n, (s, i) in enumerate(order)}
    assert {tuple(r) for r in exact_topk.search(df, df).collect()} == want
    none = spark.createDataFrame([], SCHEMA)
    assert exact_topk.search(none, none).collect() == [] and exact_topk.search(df, none).collect() == []


def test_most_pairs_are_left_out_where_lengths_or_directions_allow(spark):
    rng = np.random.default_rng(1)
    x = np.floor(rng.normal(size=(6000, 32)) * np.geomspace(1, 0.01, 32) * 1000)
    x[:3000] *= rng.uniform(0.01, 1, (3000, 1)).round(2)
    found = exact_topk.Search(exact_topk.Rotation(x[:2000]), np.arange(0, 6000, 100), x[::100], np.full(60, -np.inf), 10)
    found.run(np.arange(6000), x)
    assert found.scored < 0.25 * 60 * 6000
    for q, v in zip(found.ids, found.v):
        s = x @ x[q]
        assert v.tolist() == [int(i) for i in np.lexsort((np.arange(6000), -s)) if i != q][:10]


def brute_negatives(rows, anchor, positives=5, top=3, least=50, most=95, factor=256):
    x = {r[0]: (r[2], v) for r in rows if r[0] is not None and r[2] is not None and (v := whole(r[1], factor)) is not None}
    out = set()
    for a in x:
        if anchor(a):
            scored = sorted((-dot(x[a][1], v), i) for i, (_, v) in x.items() if i != a and len(v) == len(x[a][1]))
            for p, pid in [y for y in scored if x[y[1]][0] == x[a][0]][:positives]:
                fit = [(s, i) for s, i in scored if x[i][0] != x[a][0] and least * -p <= 100 * -s <= most * -p][:top]
                out |= {(a, pid, n + 1, i, -p, -s) for n, (s, i) in enumerate(fit)}
    return out


@pytest.mark.parametrize("block,anchors", [(None, 4096), (30, 7)])
def test_negatives_equal_brute_force(spark, block, anchors):
    rows = made(seed=8)
    df = spark.createDataFrame(rows, SCHEMA)
    found = hard_negatives.mine(df, F.col("vec_id") % 10 == 0, block=block, anchors=anchors)
    want = brute_negatives(rows, lambda a: a % 10 == 0)
    assert {tuple(r) for r in found.collect()} == want and len(want) > 50
    assert hard_negatives.mine(df.limit(0), F.col("vec_id") % 10 == 0).collect() == []


def test_limits_are_exact():
    for p in (0, 1, 7, -3, 10**18, 2**62 + 1):
        low, high = hard_negatives.limits(p)
        fits = lambda n: 50 * p <= 100 * n <= 95 * p
        assert (low > high and p <= 1 and not any(map(fits, range(-5, 5)))) or (fits(low) and fits(high) and not fits(low - 1) and not fits(high + 1))


@pytest.mark.parametrize("name", ["op12_hard_negatives", "op13_exact_topk"])
def test_queries_equal_their_sql(spark, name):
    folder = "/root/testdata/sf0.01"
    got = queries.queries()[name](spark, folder).toPandas()
    con = duckdb.connect()
    con.sql(f"CREATE VIEW embeddings AS SELECT * FROM '{folder}/embeddings.parquet'")
    want = con.sql(queries.oracle_sql()[name]).df()[list(got.columns)]
    order = list(got.columns)
    assert len(got) and got.sort_values(order).values.tolist() == want.sort_values(order).values.tolist()
