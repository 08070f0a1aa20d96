"""Embedding operators against brute force."""

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
import pytest

from loomwright.llm import ann, embedding_dedup

SCHEMA = "vec_id long, embedding array<float>, label int, score string"


def cloud(n, seed=1, d=16):
    """Vectors of which many are near others, a third of them copies of one."""
    rng = np.random.default_rng(seed)
    x = rng.normal(size=(n, d))
    x[n // 3 : 2 * n // 3] = x[rng.integers(0, n // 3, n // 3 + (2 * n // 3 - n // 3 - n // 3))] + rng.normal(size=(2 * n // 3 - n // 3, d)) * rng.uniform(0.02, 0.15, (2 * n // 3 - n // 3, 1))
    x[2 * n // 3 :] = x[0]
    x[2 * n // 3 + n // 6 :] += rng.normal(size=x[2 * n // 3 + n // 6 :].shape) * 0.05
    return x.astype(np.float32)


ODD = [(9001, None, 1, "x"), (9002, [0.0] * 16, 1, "x"), (9003, [float("nan")] * 16, 1, "x"), (9004, [1.0] * 15 + [None], 1, "x"), (9005, [], 1, "x"), (9006, [1.0] * 16, None, "x"), (9007, [1.0, 2.0], 1, "x")]


def brute_links(rows, threshold=0.93):
    ids = [r[0] for r in rows]
    good = [r[1] is not None and len(r[1]) == 16 and all(v is not None and np.isfinite(v) for v in r[1]) and any(r[1]) and r[2] is not None for r in rows]
    unit = np.array([np.array(r[1], float) / np.linalg.norm(r[1]) if g else np.zeros(16) for r, g in zip(rows, good)])
    label = np.array([-1 if r[2] is None else r[2] for r in rows])
    near = (unit @ unit.T >= threshold) & (label[:, None] == label)
    np.fill_diagonal(near, False)
    comp = np.array(ids)
    while True:
        new = np.array([min([comp[i], *comp[near[i]]]) for i in range(len(ids))])
        if (new == comp).all():
            return {i: (int(n), int(c)) for i, n, c in zip(ids, near.sum(1), comp)}
        comp = new


@pytest.mark.parametrize("cell,block", [(512, 2048), (8, 16)])
def test_links_are_those_of_brute_force(spark, cell, block):
    x = cloud(300)
    rows = [(i, v.tolist(), i % 2, "x") for i, v in enumerate(x)] + ODD
    found = embedding_dedup.near_duplicates(spark.createDataFrame(rows, SCHEMA), cell=cell, block=block).collect()
    want = brute_links(rows)
    assert {r.vec_id: (r.n_links, r.component_id) for r in found} == want
    assert len(found) == len(rows) and all(r.kept == (r.vec_id == r.component_id) for r in found)


@pytest.mark.parametrize("block", [16, 8192])
def test_a_hot_label_among_many_rare_ones(spark, block, monkeypatch):
    """Also links in a direction that the sample hardly has: none is missed by default."""
    monkeypatch.setattr(embedding_dedup, "SAMPLE", 100)
    x = cloud(900, seed=4)
    drift = np.zeros(16)
    drift[3] = 4
    x[::3] += drift.astype(np.float32)
    x[1::9] = x[::9] + drift.astype(np.float32) * 0.3
    rows = [(i, v.tolist(), 0 if i % 10 else 1 + i % 300, "x") for i, v in enumerate(x)]
    grids, made = [], embedding_dedup.Grid.__init__
    monkeypatch.setattr(embedding_dedup.Grid, "__init__", lambda self, *a: (made(self, *a), grids.append(self))[0])
    found = embedding_dedup.near_duplicates(spark.createDataFrame(rows, SCHEMA), block=block).collect()
    assert {r.vec_id: (r.n_links, r.component_id) for r in found} == brute_links(rows)
    assert len(grids) == (2 if block == 16 else 1) and grids[0].k > 5


def flat(n, rank, d=64, seed=0):
    """Vectors whose halves lie in `rank` directions each, many of them near the threshold."""
    rng = np.random.default_rng(seed)
    x = rng.normal(size=(n, 2 * rank))
    x[n // 2 :] = x[: n - n // 2] + rng.normal(size=(n - n // 2, 2 * rank)) * 0.3
    axes = [np.linalg.qr(rng.normal(size=(d // 2, rank)))[0].T for _ in range(2)]
    return np.hstack([x[:, :rank] @ axes[0], x[:, rank:] @ axes[1]]).astype(np.float32)


def numpy_links(x, label, threshold=0.93):
    """(number of links, component) of each row, label by label."""
    unit = x.astype(np.float64) / np.linalg.norm(x.astype(np.float64), axis=1)[:, None]
    n, comp = np.zeros(len(x), np.int64), np.arange(len(x))
    for one in np.unique(label):
        rows = np.nonzero(label == one)[0]
        near = unit[rows] @ unit[rows].T >= threshold
        np.fill_diagonal(near, False)
        n[rows], c = near.sum(1), rows
        while True:
            new = np.minimum(c, np.where(near, c[None, :], 1 << 40).min(1))
            if (new == c).all():
                break
            c = new
        comp[rows] = c
    return n, comp


@pytest.mark.parametrize("rank,recall", [(1, 1.0), (2, 1.0), (4, 1.0), (32, 1.0), (32, 1 - 1e-6)])
def test_no_link_is_lost_on_fifty_thousand_vectors(spark, rank, recall, monkeypatch):
    """With 18 codes a half and more, whatever the number of directions; where there are many directions, most cells aren't visited if the limit is told from the sample."""
    grids, made = [], embedding_dedup.Grid.__init__
    monkeypatch.setattr(embedding_dedup.Grid, "__init__", lambda self, *a: (made(self, *a), grids.append(self))[0])
    n = 51_200
    x, label = flat(n, rank), np.arange(n) % 10
    if rank == 32:
        x[n // 2 :] = x[: n - n // 2] + np.random.default_rng(1).normal(size=(n // 2, 64)).astype(np.float32) * np.random.default_rng(2).uniform(0.05, 0.4, (n // 2, 1)).astype(np.float32)
    label[n // 2 :] = label[: n // 2]
    kind = pa.list_(pa.float32())
    df = spark.createDataFrame(pa.table({"vec_id": np.arange(n), "embedding": pa.array(list(x), kind), "label": label}))
    found = embedding_dedup.near_duplicates(df, target_recall=recall).toPandas().sort_values("vec_id")
    links, comp = numpy_links(x, label)
    assert grids[0].k >= 18 and links.sum() > n // 4
    assert (found.n_links.to_numpy() == links).all() and (found.component_id.to_numpy() == comp).all()
    if recall < 1:
        unit = embedding_dedup._unit(x[:1000].astype(np.float64))
        assert grids[0].visits(unit).mean() < 0.45


def test_full_recall_limit_misses_nothing(spark):
    rows = [(i, v.tolist(), 0, "x") for i, v in enumerate(cloud(200, 3))]
    found = embedding_dedup.near_duplicates(spark.createDataFrame(rows, SCHEMA), target_recall=1.0, cell=8).collect()
    assert {r.vec_id: (r.n_links, r.component_id) for r in found} == brute_links(rows)


def test_links_of_no_rows_and_of_repeated_rows(spark):
    assert embedding_dedup.near_duplicates(spark.createDataFrame([], SCHEMA)).count() == 0
    assert [tuple(r) for r in embedding_dedup.near_duplicates(spark.createDataFrame(ODD[:3], SCHEMA)).orderBy("vec_id").collect()] == [(9001, 0, 9001, True), (9002, 0, 9002, True), (9003, 0, 9003, True)]
    twice = [(5, [1.0, 2.0], 1, "x"), (5, [1.0, 2.0], 1, "x"), (None, [1.0, 2.0], 1, "x")]
    found = embedding_dedup.near_duplicates(spark.createDataFrame(twice, SCHEMA)).collect()
    assert sorted((r.vec_id or -1, r.n_links, r.component_id, r.kept) for r in found) == [(-1, 2, 5, False), (5, 2, 5, True), (5, 2, 5, True)]
    nameless = spark.createDataFrame([(None, [1.0, 2.0], 1, "x"), (None, None, 1, "x"), (7, [0.0], 1, "x")], SCHEMA)
    assert sorted((r.vec_id or -1, r.n_links, r.component_id, r.kept) for r in embedding_dedup.near_duplicates(nameless).collect()) == [(-1, 0, None, False), (-1, 0, None, False), (7, 0, 7, True)]


def test_vectors_of_each_length_are_compared_among_themselves(spark):
    rows = [(1, [1.0, 0.0], 1, "x"), (2, [1.0, 0.1], 1, "x"), (3, [1.0, 0.0, 0.0], 1, "x"), (4, [2.0, 0.0, 0.1], 1, "x"), (5, [1.0], 1, "x"), (6, [1e200, 1e199], 1, "x"), (7, [1e-30, 0.0], 1, "x")]
    df = spark.createDataFrame(rows, SCHEMA.replace("float", "double"))
    found = embedding_dedup.near_duplicates(df).collect()
    assert sorted((r.vec_id, r.n_links, r.component_id) for r in found) == [(1, 3, 1), (2, 3, 1), (3, 1, 3), (4, 1, 3), (5, 0, 5), (6, 3, 1), (7, 3, 1)]


def brute_nearest(rows, queries, top):
    good = [r for r in rows if r[1] is not None and len(r[1]) == 16 and all(v is not None and np.isfinite(v) for v in r[1]) and any(r[1])]
    x, ids = np.array([r[1] for r in good], dtype=np.float64), np.array([r[0] for r in good])
    out = {}
    for i, q in zip(ids, x):
        if i in queries:
            s = (x * q).sum(1)
            order = [o for o in np.lexsort((ids, -s)) if ids[o] != i][:top]
            out[int(i)] = [(int(ids[o]), float(s[o])) for o in order]
    return out


def test_nearest_reach_the_recall(spark):
    x = cloud(900, 7) * np.random.default_rng(2).uniform(0.5, 2, (900, 1)).astype(np.float32)
    rows = [(i, v.tolist(), 0, "x") for i, v in enumerate(x)] + ODD
    df = spark.createDataFrame(rows, SCHEMA)
    found = ann.nearest(df, df.filter("vec_id % 20 = 0"), top=10, list_size=60, block=128).collect()
    want = brute_nearest(rows, {i for i in range(900) if i % 20 == 0}, 10)
    got = {}
    for r in sorted(found, key=lambda r: r["rank"]):
        got.setdefault(r.query_id, []).append((r.vec_id, r.score))
    assert set(got) == set(want) and all(len(v) == 10 for v in got.values())
    hits = sum(len({i for i, _ in got[q]} & {i for i, _ in want[q]}) for q in want)
    assert hits >= 0.95 * 10 * len(want)
    for q, v in got.items():
        assert v == sorted(v, key=lambda p: (-p[1], p[0])) and len({i for i, _ in v}) == len(v)
        true = {i: float((x[i].astype(float) * x[q].astype(float)).sum()) for i, _ in v if i < 900}
        assert all(abs(true[i] - s) < 1e-12 for i, s in v if i in true)


def test_nearest_with_one_list_is_exact_and_few_rows_give_all(spark):
    rows = [(i, v.tolist(), 0, "x") for i, v in enumerate(cloud(30, 5))]
    df = spark.createDataFrame(rows, SCHEMA)
    got = {}
    for r in sorted(ann.nearest(df, df.filter("vec_id % 20 = 0"), top=50).collect(), key=lambda r: r["rank"]):
        got.setdefault(r.query_id, []).append(r.vec_id)
    assert got == {q: [i for i, _ in v] for q, v in brute_nearest(rows, {0, 20}, 50).items()}
    assert ann.nearest(df.limit(0), df.limit(0)).count() == 0


def test_graph_search_finds_the_nearest_centroids():
    x = np.random.default_rng(4).normal(size=(2000, 8))
    points = ann.balanced_centroids(x, 100)
    graph = ann.CentroidGraph(points, 8)
    assert len(points) == 100
    for width, wide in ((20, 1), (20, 4), (100, 32), (500, 3)):
        ids, d = graph.search(x[:50], width, wide)
        assert ids.shape == (50, min(width, 100)) and (np.diff(d, axis=1) >= 0).all()
        true = np.argsort(((points - x[:50, None]) ** 2).sum(2), axis=1)[:, :5]
        assert sum(len({*a} & {*b[:5]}) for a, b in zip(true.tolist(), ids.tolist())) >= 0.95 * 250
    assert ann.CentroidGraph(points[:1]).search(x[:3], 5)[0].tolist() == [[0]] * 3


def test_vectors_are_filed_more_than_once_only_near_borders():
    x = np.random.default_rng(6).normal(size=(4000, 16))
    index = ann.Index(x[:2000], float(np.linalg.norm(x, axis=1).max()), 100, 0.95, 10, 4000)
    row, at = index.filing(x)
    d = np.sqrt(((ann.lifted(x, index.longest)[:, None] - index.graph.points) ** 2).sum(2))
    n = np.bincount(row, minlength=4000)
    assert n.min() == 1 and n.max() <= ann.COPIES and n.mean() < 2
    assert (d[row, at] <= (ann.BORDER + 1e-4) * d.min(1)[row]).all()
    clear = np.sort(d, axis=1)
    assert (n[clear[:, 1] > 1.05 * clear[:, 0]] == 1).all()


def test_recall_and_candidates_on_fifty_thousand_vectors(spark, monkeypatch, tmp_path):
    """The sample is smaller than the table; a search looks at half of the rows, which have no structure."""
    made, indexes = ann.Index.__init__, []
    monkeypatch.setattr(ann.Index, "__init__", lambda self, *a: (made(self, *a), indexes.append(self))[0])
    made_of = np.random.default_rng(42).normal(size=(51_282, 64))
    made_of[41_000:] = made_of[np.repeat(np.arange(0, 41_000, 8), 3)[: 51_282 - 41_000]] + 0.2 * made_of[41_000:]  # small groups
    x, ids = (made_of / np.linalg.norm(made_of, axis=1, keepdims=True)).astype(np.float32), np.arange(51_282)
    file = tmp_path / "vectors.parquet"
    pq.write_table(pa.table({"vec_id": ids, "embedding": pa.FixedSizeListArray.from_arrays(pa.array(x.ravel()), 64).cast(pa.list_(pa.float32()))}), file)
    table, x = spark.read.parquet(f"file://{file}"), x.astype(np.float64)
    queries = np.nonzero(ids % 100 == 0)[0]
    found = ann.nearest(table, table.filter("vec_id % 100 = 0")).toPandas()
    got = found.groupby("query_id").vec_id.agg(set)
    hits = 0
    for q in queries:
        s = x @ x[q]
        s[q] = -np.inf
        hits += len({*ids[np.argsort(-s)[:20]].tolist()} & got[ids[q]])
    assert (found.groupby("query_id").size() == 20).all() and hits / (20 * len(queries)) > 0.95
    index, power = indexes[0], 0
    sizes = np.bincount(np.concatenate([index.filing(np.ldexp(x[i : i + 1024], power))[1] for i in range(0, len(x), 1024)]), minlength=index.lists)
    searched = np.concatenate([index.searching(x[queries[i : i + 256]]) for i in range(0, len(queries), 256)])
    print("copies", sizes.sum() / len(x), "candidates", (searched @ sizes).mean() / len(x), "recall", hits / (20 * len(queries)))
    assert len(x) > 20_000 and sizes.sum() < 2 * len(x) and (searched @ sizes).mean() < 0.55 * len(x)


def test_very_large_and_very_small_components(spark):
    rows = [(i, [a, b]) for i, (a, b) in enumerate([(1e200, 0.0), (1e200, 1e199), (-1e200, 0.0), (0.0, 1e180), (1e-200, 0.0), (1e-310, 1e-310)])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = {}
    for r in sorted(ann.nearest(df, df, top=5).collect(), key=lambda r: r["rank"]):
        got.setdefault(r.query_id, []).append((r.vec_id, r.score))
    assert set(got) == set(range(6)) and all(len(v) == 5 for v in got.values())
    x = np.array([v for _, v in rows])
    with np.errstate(over="ignore", under="ignore"):
        for q, v in got.items():
            s = (x * x[q]).sum(1)
            assert v == [(int(i), float(s[i])) for i in np.lexsort((np.arange(6), -s)) if i != q]


def test_vectors_of_each_length_are_searched_among_themselves(spark):
    rows = [(1, [1.0, 0.0]), (2, [1.0, 0.5]), (3, [1.0, 0.0, 1.0]), (4, [3.0]), (None, [1.0, 0.0]), (2, [2.0, 0.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    found = ann.nearest(df, df.filter("vec_id <> 2")).collect()
    assert sorted(tuple(r) for r in found) == [(1, 1, 2, 2.0)]


def test_a_repeated_id_counts_once_with_its_best_score(spark):
    rows = [(1, [float(i + 1), 0.0], 0, "x") for i in range(60)] + [(2, [0.5, 0.0], 0, "x"), (3, [0.5, 0.0], 0, "x"), (0, [1.0, 0.0], 0, "x")]
    df = spark.createDataFrame(rows, SCHEMA)
    found = ann.nearest(df, df.filter("vec_id = 0"), top=3).orderBy("rank").collect()
    assert [(r["rank"], r.vec_id, r.score) for r in found] == [(1, 1, 60.0), (2, 2, 0.5), (3, 3, 0.5)]
