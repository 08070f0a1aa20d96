"""Approximate nearest neighbours with balanced posting lists.

A bounded sample is cut by balanced bisection into cells of equal size; their means are the centroids, one for about
`list_size` vectors. Every vector is filed in the list of its nearest centroid, and vectors near a border also in those
few lists whose centroid is hardly farther. The centroids are linked to their neighbours in a graph that each worker holds
in memory; a walk over it, for many vectors at once, finds the nearest ones. A query searches the lists whose centroid is at
most `ratio` times as far as the NTH nearest. The ratio is the smallest that reaches the target recall for queries from the sample.

The largest inner product is the nearest neighbour after each vector got one more component that makes all as long as the
longest; for this all vectors are scaled by one power of two, so that no square overflows. Neighbouring lists form blocks.
A query travels to a block once, with a bit for each of the block's lists that it searches; hot blocks are cut into parts of
vectors and of queries, so that no task gets a whole one. Every part returns its best for each query, and no candidate is
left out of a searched list.
"""

from __future__ import annotations

import math
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomwright.llm.vectors import SAMPLE, lengths, native, sample, squared, stack, usable
from loomwright.session import materialise

TOP, TARGET_RECALL = 20, 0.95
#: Vectors of a list, the most lists, and in how many lists a vector is filed whose centroids are at most BORDER times as far as the nearest.
LIST, MAX_LISTS, COPIES, BORDER = 16, 16_384, 3, 1.006
#: The ratio is that to the distance of so manyth nearest centroid: the very nearest may be one that a vector of the sample has made.
NTH = 16
#: Links of a centroid, vectors of a block and of a part of a hot block, queries of a part.
DEGREE, BLOCK, QUERIES = 24, 8192, 4096


def balanced_centroids(x: np.ndarray, k: int) -> np.ndarray:
    """k means of parts of x whose sizes differ by little: parts are halved, where two of their means are equally far, in proportion to the lists that each half will get. Neighbours in the order are near each other."""
    out, todo = [], [(np.arange(len(x)), max(1, min(k, len(x))))]
    rng = np.random.default_rng(11)
    while todo:
        rows, n = todo.pop()
        if n == 1:
            out.append(x[rows].mean(0))
            continue
        part, few = x[rows], n // 2
        at = max(1, min(len(rows) - 1, round(len(rows) * few / n)))
        a, b = part[rng.choice(len(part), 2, replace=False)]
        for _ in range(8):
            order = np.argsort(((part - a) ** 2).sum(1) - ((part - b) ** 2).sum(1), kind="stable")
            a, b = part[order[:at]].mean(0), part[order[at:]].mean(0)
        todo += [(rows[order[:at]], few), (rows[order[at:]], n - few)]
    return np.array(out)


class CentroidGraph:
    """Each centroid's nearest ones, and a chain through all, so that every one can be reached."""

    def __init__(self, centroids: np.ndarray, degree: int = DEGREE) -> None:
        self.points, n = centroids.astype(np.float32), len(centroids)
        degree = max(1, min(degree, n - 1))
        near = np.empty((n, degree + 2), dtype=np.int32)
        for at in range(0, n, 1024):
            d = squared(centroids[at : at + 1024], centroids)
            own = np.arange(at, at + len(d))
            d[own - at, own] = np.inf
            near[at : at + len(d), :degree] = np.argpartition(d, degree - 1, axis=1)[:, :degree]
        near[:, degree], near[:, degree + 1] = (np.arange(n) + 1) % n, (np.arange(n) - 1) % n
        self.near = near
        self.entry = np.unique(np.linspace(0, n - 1, min(n, 16)).astype(np.int64))
        self.length = (self.points**2).sum(1)

    def search(self, q: np.ndarray, width: int, wide: int = 1) -> tuple[np.ndarray, np.ndarray]:
        """For each row of q the `width` nearest centroids found and their distances, nearest first.

        All rows walk together: each expands, again and again, its nearest centroids not yet expanded, `wide` at a time, until
        all of its `width` nearest are.
        """
        n, lists = len(q), len(self.points)
        width, q = min(width, lists), q.astype(np.float32)
        rows, offset = np.arange(n)[:, None], (q**2).sum(1)[:, None]
        seen = np.zeros((n, lists), dtype=bool)

        def distances(at: np.ndarray, ids: np.ndarray) -> np.ndarray:
            return np.maximum(offset[at, 0] - 2 * np.einsum("ij,ij->i", q[at], self.points[ids]) + self.length[ids], 0)

        ids = np.broadcast_to(self.entry, (n, len(self.entry))).copy()
        seen[rows, ids] = True
        d = distances(np.repeat(np.arange(n), ids.shape[1]), ids.ravel()).reshape(ids.shape)
        open_ = np.ones(ids.shape, dtype=bool)
        while True:
            key = np.where(open_, d, np.inf)
            some = min(wide, key.shape[1])
            pick = np.argpartition(key, some - 1, axis=1)[:, :some] if some < key.shape[1] else np.broadcast_to(np.arange(some), key.shape)
            go = np.isfinite(np.take_along_axis(key, pick, 1))
            if not go.any():
                break
            open_[rows, pick] &= ~go
            at, which = np.nonzero(go)
            new = np.zeros((n, lists), dtype=bool)
            new[at[:, None], self.near[ids[at, pick[at, which]]]] = True
            new &= ~seen
            seen |= new
            at, new = np.nonzero(new)
            # the new ones of each row stand side by side
            many = np.bincount(at, minlength=n)
            place = np.arange(len(at)) - np.repeat(np.cumsum(many) - many, many)
            more_ids, more_d = np.zeros((n, many.max(initial=0)), np.int64), np.full((n, many.max(initial=0)), np.inf, np.float32)
            more_ids[at, place], more_d[at, place] = new, distances(at, new)
            ids, d = np.hstack([ids, more_ids]), np.hstack([d, more_d])
            open_ = np.hstack([open_, np.isfinite(more_d)])
            if ids.shape[1] > width:
                best = np.argpartition(d, width - 1, axis=1)[:, :width]
                ids, d, open_ = (np.take_along_axis(x, best, 1) for x in (ids, d, open_))
        order = np.lexsort((ids, d), axis=1)
        return np.take_along_axis(ids, order, 1), np.sqrt(np.take_along_axis(d, order, 1))


def lifted(x: np.ndarray, longest: float) -> np.ndarray:
    """x with a component more, so that all rows have the length `longest`."""
    return np.hstack([x, np.sqrt(np.maximum(longest**2 - (x**2).sum(1), 0))[:, None]])


def level(x: np.ndarray) -> np.ndarray:
    """Queries: the additional component is zero."""
    return np.hstack([x, np.zeros((len(x), 1))])


class Index:
    """The graph of centroids, and the ratio and the width with which it is searched."""

    def __init__(self, known: np.ndarray, longest: float, lists: int, target: float, top: int, total: int, probes: int = 300) -> None:
        # vectors lie nearer to centroids that they helped to make, so one half of the sample makes them and the other one tells the ratio
        fit, other = (known[::2], known[1::2]) if len(known) > 1 else (known, known)
        self.longest, self.graph = longest, CentroidGraph(balanced_centroids(lifted(fit, longest), lists))
        self.lists = len(self.graph.points)
        self.ratio, self.width = 1.0, self.lists
        self.least = min(self.lists, math.ceil(4 * top * self.lists / max(1, total)))
        if self.lists > 1:
            self._calibrate(other, target, math.ceil(top * len(other) / max(1, total)), probes)

    def filing(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(row, list) for all lists in which rows of x are filed."""
        ids, d = self.graph.search(lifted(x, self.longest), 8 * COPIES, 8)
        row, at = np.nonzero(d[:, :COPIES] <= BORDER * d[:, :1] + 1e-12)
        return row, ids[row, at]

    def searching(self, x: np.ndarray) -> np.ndarray:
        """Which lists each row of x searches: (rows, lists). Some lists are searched whatever the ratio, so that there are enough candidates."""
        ids, d = self.graph.search(level(x), self.width, max(32, self.width // 6))
        out = np.zeros((len(x), self.lists), dtype=bool)
        near = d <= self.ratio * self.reference(d) + 1e-12
        near[:, : self.least] = True
        row, at = np.nonzero(near & np.isfinite(d))
        out[row, ids[row, at]] = True
        return out

    @staticmethod
    def reference(d: np.ndarray) -> np.ndarray:
        """What the ratio is taken of, for each row of ascending distances."""
        return d[:, min(NTH, d.shape[1]) - 1, None]

    def _calibrate(self, x: np.ndarray, target: float, top: int, probes: int) -> None:
        """The smallest ratio with which queries from x find `target` of their `top` nearest in it, and a width that holds the lists it takes."""
        chosen = np.linspace(0, len(x) - 1, min(probes, len(x))).astype(int)
        scores = x[chosen] @ x.T
        scores[np.arange(len(chosen)), chosen] = -np.inf
        best = np.argsort(-scores, axis=1, kind="stable")[:, : min(top, len(x) - 1)]
        if not best.size:
            return
        wanted = np.unique(best)
        row, at = (np.concatenate(p) for p in zip(*((r + i, c) for i in range(0, len(wanted), 1024) for r, c in [self.filing(x[wanted[i : i + 1024]])])))
        d = np.sqrt(squared(level(x[chosen]), self.graph.points.astype(np.float64)))
        # the nearest of the lists that hold each wanted vector, for each query
        nearest = np.full((len(chosen), len(wanted)), np.inf)
        for r, c in zip(row.tolist(), at.tolist()):
            nearest[:, r] = np.minimum(nearest[:, r], d[:, c])
        of = np.maximum(self.reference(np.sort(d, axis=1)), 1e-12)
        need = np.take_along_axis(nearest, np.searchsorted(wanted, best), 1) / of
        self.ratio = float(np.quantile(need, target, method="higher")) + 1e-6
        self.width = int(min(self.lists, self.least + 1.2 * (d <= self.ratio * of).sum(1).max() + NTH))


_HITS = pa.list_(pa.struct([("s", pa.float64()), ("v", pa.int64())]))


def _first(pairs: Iterable[tuple[float, int]], top: int) -> list[dict]:
    """The first `top` of (negative score, id) in order, each id once with its best score."""
    out: dict[int, float] = {}
    for s, v in sorted(pairs):
        if v not in out:
            out[v] = s
            if len(out) == top:
                break
    return [{"s": s, "v": v} for v, s in out.items()]


def nearest(vectors: DataFrame, queries: DataFrame, top: int = TOP, target_recall: float = TARGET_RECALL, list_size: int = LIST, block: int = BLOCK) -> DataFrame:
    """query_id, rank, vec_id, score: for each row of queries(vec_id, embedding) the rows of vectors(vec_id, embedding) with the largest inner products found.

    A row isn't its own neighbour: candidates with the query's id are left out. Nearest first, ties to the smaller
    vec_id; a repeated id counts once, with its best score. Null, empty and zero vectors, those with null or non-finite
    components, or with a null id take no part. Vectors of each length are searched among themselves. An inner product beyond
    the range of doubles is infinite, and so nearest. Other columns are ignored; empty tables give an empty one.
    """

    def clean(df: DataFrame) -> DataFrame:
        kind = dict(df.dtypes)["embedding"]
        return df.select(F.col("vec_id").cast("long").alias("vec_id"), native(kind=kind).alias("embedding")).filter(F.col("vec_id").isNotNull() & usable())

    schema = "query_id long, rank int, vec_id long, score double"
    base, asked = clean(vectors), clean(queries)
    found = [_of_length(base.filter(F.size("embedding") == size), asked.filter(F.size("embedding") == size), total, top, target_recall, list_size, block) for size, total in lengths(base)]
    if not found:
        return vectors.sparkSession.createDataFrame([], schema)
    out = found[0]
    for more in found[1:]:
        out = out.union(more)
    return out


def _scaled(t: pa.RecordBatch, power: int) -> np.ndarray:
    return np.ldexp(stack(t["embedding"]), -power)


def _of_length(base: DataFrame, asked: DataFrame, total: int, top: int, target_recall: float, list_size: int, block: int) -> DataFrame:
    """nearest() for vectors of one length."""
    largest = F.array_max(F.transform("embedding", lambda x: F.abs(x.cast("double"))))
    power = max(-1000, math.frexp(base.agg(F.max(largest)).first()[0])[1])
    scale = F.lit(math.ldexp(1.0, -power))
    norm = F.sqrt(F.aggregate("embedding", F.lit(0.0), lambda s, x: s + (x.cast("double") * scale) * (x.cast("double") * scale)))
    longest = base.agg(F.max(norm)).first()[0]
    index = Index(np.ldexp(sample(base, 2 * SAMPLE), -power), longest, min(MAX_LISTS, max(1, round(total / list_size))), target_recall, top, total)
    held = base.sparkSession.sparkContext.broadcast(index)  # MAX_LISTS centroids and DEGREE links each at most
    blocks = max(1, min(index.lists, round(total / block)))
    per = -(-index.lists // blocks)
    bits = (per + 7) // 8

    def filed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 1024):
                t = batch.slice(at, 1024)
                row, which = held.value.filing(_scaled(t, power))
                picked = t.take(pa.array(row))
                yield pa.RecordBatch.from_arrays([pa.array(which // per, pa.int32()), pa.array(which % per, pa.int32()), picked["vec_id"], picked["embedding"]], names=["block", "list", "vec_id", "embedding"])

    def searching(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                t = batch.slice(at, 256)
                wanted = np.zeros((t.num_rows, per * blocks), dtype=bool)
                wanted[:, : index.lists] = held.value.searching(_scaled(t, power))
                wanted = wanted.reshape(t.num_rows, blocks, per)
                row, which = np.nonzero(wanted.any(2))
                marks = np.packbits(wanted[row, which], axis=1).tobytes()
                picked = t.take(pa.array(row))
                yield pa.RecordBatch.from_arrays([pa.array(which, pa.int32()), pa.array([marks[bits * r : bits * r + bits] for r in range(len(row))], pa.binary()), picked["vec_id"], picked["embedding"]], names=["block", "lists", "vec_id", "embedding"])

    vector = dict(base.dtypes)["embedding"]
    lists = materialise(base.mapInArrow(filed, f"block int, list int, vec_id long, embedding {vector}"), "lists")
    probes = materialise(asked.mapInArrow(searching, f"block int, lists binary, vec_id long, embedding {dict(asked.dtypes)['embedding']}"), "probes")
    merged = materialise(_searched(lists, probes, index.longest, power, bits, top, block), "found", small=True)
    # a query whose lists hold too few candidates, as where ids repeat, searches all lists
    enough = merged.filter(F.size("found") >= top).select(F.col("query_id").alias("vec_id"))
    short = asked.select("vec_id").distinct().join(enough, "vec_id", "left_anti")
    if not short.isEmpty():
        every = F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("block")
        again = asked.join(short, "vec_id", "left_semi").select(every, F.lit(b"\xff" * bits).alias("lists"), "vec_id", "embedding")
        merged = merged.filter(F.size("found") >= top).union(_searched(lists, again, index.longest, power, bits, top, block))
    ranked = merged.select("query_id", F.posexplode("found").alias("pos", "hit"))
    return ranked.select("query_id", (F.col("pos") + 1).cast("int").alias("rank"), F.col("hit.v").alias("vec_id"), (-F.col("hit.s")).alias("score"))


def _searched(lists: DataFrame, probes: DataFrame, longest: float, power: int, bits: int, top: int, block: int) -> DataFrame:
    """(query_id, found): the best `top` of the lists that each query searches. lists(block, list, vec_id, embedding); probes(block, lists, vec_id, embedding)."""
    n_lists = lists.groupBy("block").agg(F.ceil(F.count("*") / (4 * block)).cast("int").alias("m"))
    n_probes = probes.groupBy("block").agg(F.ceil(F.count("*") / QUERIES).cast("int").alias("v"))
    counts = n_lists.join(n_probes, "block")
    spread = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    own = lambda n: F.pmod(F.xxhash64("vec_id", "embedding"), F.col(n)).cast("int")
    left = lists.join(counts, "block").select("block", own("m").alias("mb"), spread("v").alias("vb"), "list", "vec_id", "embedding")
    right = probes.join(counts, "block").select("block", spread("m").alias("mb"), own("v").alias("vb"), "lists", "vec_id", "embedding")

    def best(of_lists: pa.Table, of_queries: pa.Table) -> pa.Table:
        out: list[dict] = []
        if of_lists.num_rows and of_queries.num_rows:
            order = np.argsort(of_lists["list"].to_numpy(), kind="stable")
            which, starts = np.unique(of_lists["list"].to_numpy()[order], return_index=True)
            stops = [*starts[1:].tolist(), len(order)]
            ids, x = of_lists["vec_id"].to_numpy()[order], stack(of_lists["embedding"])[order]
            small = np.ldexp(x, -power)
            asking, q = of_queries["vec_id"].to_numpy(), stack(of_queries["embedding"])
            marks = np.frombuffer(b"".join(of_queries["lists"].to_pylist()), np.uint8).reshape(len(q), bits)
            # so many hold `top` ids at least, however often an id is filed
            most = min(len(ids), top * int(np.unique(ids, return_counts=True)[1].max()))
            for at in range(0, len(q), 256):
                part, mark = np.ldexp(q[at : at + 256], -power), marks[at : at + 256]
                scores = np.full((len(part), len(ids)), -np.inf)
                for c, a, b in zip(which.tolist(), starts.tolist(), stops):
                    some = np.nonzero(mark[:, c // 8] & (128 >> c % 8))[0]
                    scores[some, a:b] = part[some] @ small[a:b].T
                scores[asking[at : at + 256, None] == ids] = -np.inf
                # beyond what rounding can change
                slack = 1e-12 * longest * np.linalg.norm(part, axis=1)
                cut = np.partition(scores, len(ids) - most, axis=1)[:, len(ids) - most] - slack
                for r, row in enumerate(scores):
                    some = np.nonzero((row >= cut[r]) & (row > -np.inf))[0]
                    if len(some):
                        with np.errstate(over="ignore", invalid="ignore"):
                            exact = (x[some] * q[at + r]).sum(1)  # the same sum wherever a copy is met
                        out.append({"query_id": int(asking[at + r]), "found": _first(zip((-exact).tolist(), ids[some].tolist()), top)})
        return pa.Table.from_pylist(out, schema=pa.schema([("query_id", pa.int64()), ("found", _HITS)]))

    keys = ["block", "mb", "vb"]
    found = left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInArrow(best, "query_id long, found array<struct<s:double,v:long>>")
    # a query has `top` rows at most of each part that it searched
    gathered = found.groupBy("query_id").agg(F.flatten(F.collect_list("found")).alias("found"))

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in batches:
            best_of = [_first(((p["s"], p["v"]) for p in row), top) for row in t["found"].to_pylist()]
            yield pa.RecordBatch.from_arrays([t["query_id"], pa.array(best_of, _HITS)], names=["query_id", "found"])

    return gathered.mapInArrow(merge, "query_id long, found array<struct<s:double,v:long>>")
