"""Exact top-k search by integer inner products, pruned by lengths and by partial sums.

Vectors are taken in the order of their lengths, the longest first. All are turned by the singular vectors of a bounded
sample, so that the first places of a turned vector hold most of it; the inner product of the first places plus the product
of what the others can add at most (Cauchy-Schwarz) bounds a score from above. A pair whose bound is below the query's
k-th best score so far is left out, all others are scored exactly on the integers themselves.

The longest vectors of the table, HEAD of them at most, travel to all queries and give each a k-th best score to begin with.
Then blocks of vectors of similar length meet blocks of queries. A query goes only to the blocks whose longest vector can
reach that score, and within a block it stops where the lengths can't reach it any more. Blocks of many vectors of one
length are cut into parts. Every pair is either scored or proven too low, so the result is exact whatever the sample is.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomwright.llm.vectors import best, integers, integral, lengths, native, one_row_each, paired, products, sample, tile_rows
from loomwright.session import materialise

FACTOR, TOP = 1024, 10
#: The longest vectors that all queries meet first, vectors that are looked at together, queries of a block.
HEAD, STEP, QUERIES = 2048, 1024, 4096
#: Places of turned vectors that hold these shares of their squared lengths end the partial sums.
SHARES = (0.5, 0.8)
#: Beyond what rounding can change in a bound.
SLACK = 1e-9

_HITS = pa.list_(pa.struct([("s", pa.int64()), ("v", pa.int64())]))


class Rotation:
    """An orthogonal turn after which the first places hold most, and where the partial sums end."""

    def __init__(self, known: np.ndarray) -> None:
        d = known.shape[1]
        self.axes, self.stops = np.eye(d), []
        largest = np.abs(known).max(initial=0)
        if d and largest:
            x = known / largest
            axes, strength, _ = np.linalg.svd(x.T @ x)
            self.axes, held = axes, np.cumsum(strength) / strength.sum()
            self.stops = sorted({min(d, int(np.searchsorted(held, share)) + 1) for share in SHARES} - {d})

    def tails(self, turned: np.ndarray) -> list[np.ndarray]:
        """For each stop the length of what comes after it."""
        return [np.sqrt((turned[:, s:] ** 2).sum(1)) for s in self.stops]


def norms(x: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        return np.sqrt((x**2).sum(1))


class Search:
    """The k best of vectors for queries, vectors coming in blocks of descending length."""

    def __init__(self, rotation: Rotation, ids: np.ndarray, queries: np.ndarray, least: np.ndarray, top: int) -> None:
        self.rotation, self.ids, self.q, self.least, self.top = rotation, ids, queries, least.copy(), top
        self.length, self.turned = norms(queries), queries @ rotation.axes
        self.tails = rotation.tails(self.turned)
        self.s, self.v = np.full((len(ids), top), np.iinfo(np.int64).max), np.full((len(ids), top), np.iinfo(np.int64).max)
        self.scored = 0

    def run(self, ids: np.ndarray, x: np.ndarray) -> None:
        length = norms(x)
        order = np.lexsort((ids, -length))
        ids, x, length = ids[order], x[order], length[order]
        for at in range(0, len(ids), STEP):
            with np.errstate(invalid="ignore", over="ignore"):
                live = np.nonzero(~(self.length * length[at] * (1 + SLACK) < self.least))[0]
            if not len(live):
                break
            part = slice(at, at + STEP)
            self._step(live, ids[part], x[part], length[part])

    def _step(self, live: np.ndarray, ids: np.ndarray, x: np.ndarray, length: np.ndarray) -> None:
        turned = x @ self.rotation.axes
        tails, stops = self.rotation.tails(turned), self.rotation.stops
        least, begin, sums = self.least[live], 0, None
        i, j = np.divmod(np.arange(len(live) * len(ids)), len(ids)) if not stops else (None, None)
        with np.errstate(invalid="ignore", over="ignore"):
            for n, stop in enumerate(stops):
                if sums is None:
                    grid = self.turned[live, :stop] @ turned[:, :stop].T
                    bound = grid + self.tails[n][live, None] * tails[n] + SLACK * self.length[live, None] * length
                    i, j = np.nonzero(~(bound < least[:, None]))
                    sums = grid[i, j]
                else:
                    sums = sums + np.einsum("ij,ij->i", self.turned[live[i], begin:stop], turned[j, begin:stop])
                    bound = sums + self.tails[n][live[i]] * tails[n][j] + SLACK * self.length[live[i]] * length[j]
                    stay = ~(bound < least[i])
                    i, j, sums = i[stay], j[stay], sums[stay]
                begin = stop
        other = self.ids[live[i]] != ids[j]
        i, j = live[i[other]], j[other]
        for at in range(0, len(i), 1 << 18):
            a, b = i[at : at + (1 << 18)], j[at : at + (1 << 18)]
            self._keep(a, paired(self.q[a], x[b]), ids[b])
        self.scored += len(i)

    def _keep(self, rows: np.ndarray, scores: np.ndarray, ids: np.ndarray) -> None:
        """Merge new candidates into the best of their queries."""
        some = np.unique(rows)
        row = np.concatenate([np.repeat(some, self.top), rows])
        s, v = np.concatenate([self.s[some].ravel(), -scores]), np.concatenate([self.v[some].ravel(), ids])
        order = np.lexsort((v, s, row))
        row, s, v = row[order], s[order], v[order]
        place = np.arange(len(row)) - np.searchsorted(row, row)
        first = place < self.top
        self.s[row[first], place[first]], self.v[row[first], place[first]] = s[first], v[first]
        full = self.s[some, -1] < np.iinfo(np.int64).max
        self.least[some[full]] = np.maximum(self.least[some[full]], -self.s[some[full], -1].astype(np.float64))

    def found(self) -> pa.Table:
        rows = [[{"s": int(a), "v": int(b)} for a, b in zip(s, v) if a < np.iinfo(np.int64).max] for s, v in zip(self.s, self.v)]
        kept = [n for n, r in enumerate(rows) if r]
        return pa.table({"query_id": pa.array(self.ids[kept], pa.int64()), "found": pa.array([rows[n] for n in kept], _HITS)})


def search(vectors: DataFrame, queries: DataFrame, top: int = TOP, factor: int = FACTOR, head: int = HEAD, block: int | None = None) -> DataFrame:
    """query_id, rank, vec_id, score: for each row of queries(vec_id, embedding) the rows of vectors(vec_id, embedding) with the largest inner products of floor(factor * x).

    The result is exact: highest scores first, ties to the smaller vec_id, fewer rows where there are fewer others. A query
    isn't its own candidate, told by its id. Null vectors, vectors with null or non-finite components (after the
    multiplication too) and null ids take no part; zero and empty vectors do. Vectors of each length are searched among
    themselves. An id counts once: of rows with one id the first by components. A score beyond 2**63 - 2 counts as that.
    Other columns are ignored; empty tables give an empty one.
    """

    def clean(df: DataFrame) -> DataFrame:
        rows = df.select(F.col("vec_id").cast("long").alias("vec_id"), native(kind=dict(df.dtypes)["embedding"]).alias("embedding"))
        return one_row_each(rows.filter(F.col("vec_id").isNotNull() & integral(factor)), "embedding")

    base, asked = materialise(clean(vectors), "vectors"), materialise(clean(queries), "queries")
    out = vectors.sparkSession.createDataFrame([], "query_id long, rank int, vec_id long, score long")
    for size, total in lengths(base):
        out = out.union(_of_length(base.filter(F.size("embedding") == size), asked.filter(F.size("embedding") == size), total, top, factor, head, block or tile_rows(total)))
    return out


def _of_length(base: DataFrame, asked: DataFrame, total: int, top: int, factor: int, head: int, block: int) -> DataFrame:
    """search() for vectors of one length."""
    spark = base.sparkSession
    vector = dict(base.dtypes)["embedding"]
    length = F.sqrt(F.aggregate("embedding", F.lit(0.0), lambda s, x: s + F.floor(x.cast("double") * factor).cast("double") * F.floor(x.cast("double") * factor).cast("double")))
    measured = base.withColumn("length", length)
    known = np.floor(sample(base) * factor)
    longest = measured.orderBy(F.desc("length"), "vec_id").limit(head).select("vec_id", "embedding").toArrow()
    edges = _edges(measured, total, block)
    first = spark.sparkContext.broadcast((Rotation(known), longest["vec_id"].to_numpy(), integers(longest["embedding"], factor), edges))  # `head` vectors, a turn, and an edge for each block
    dealt = materialise(base.mapInArrow(_dealer(first, factor), f"block int, length double, vec_id long, embedding {vector}"), "dealt")
    sizes = {r["block"]: (r["n"], r["longest"]) for r in dealt.groupBy("block").agg(F.count("*").alias("n"), F.max("length").alias("longest")).collect()}  # a row for each block
    parts = {b: -(-n // (2 * block)) for b, (n, _) in sizes.items()}
    halls = max(1, -(-asked.count() // QUERIES))

    def begin(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Queries go, with the k-th best score among the longest vectors, to the parts of the blocks that can reach it."""
        _, head_ids, head_x, _ = first.value
        order = sorted(sizes)
        reach = np.array([sizes[b][1] for b in order])
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                t = batch.slice(at, 512)
                q, own = integers(t["embedding"], factor), t["vec_id"].to_numpy()
                hall = (own.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(33)) % np.uint64(halls)
                least = _least(products(q, head_x), own[:, None] != head_ids, top)
                with np.errstate(invalid="ignore", over="ignore"):
                    row, which = np.nonzero(~(norms(q)[:, None] * reach * (1 + SLACK) < least[:, None]))
                many = np.array([parts[b] for b in order])[which]
                row, which = np.repeat(row, many), np.repeat(which, many)
                part = np.arange(len(row)) - np.repeat(np.cumsum(many) - many, many)
                picked = t.take(pa.array(row))
                yield pa.RecordBatch.from_arrays([pa.array(np.array(order)[which], pa.int32()), pa.array(part, pa.int32()), pa.array(hall[row], pa.int32()), pa.array(least[row]), picked["vec_id"], picked["embedding"]], names=["block", "part", "hall", "least", "vec_id", "embedding"])

    right = asked.mapInArrow(begin, f"block int, part int, hall int, least double, vec_id long, embedding {dict(asked.dtypes)['embedding']}")
    count = F.lit(1)
    for b, n in parts.items():
        count = F.when(F.col("block") == b, n).otherwise(count) if n > 1 else count
    left = dealt.select("block", F.pmod(F.xxhash64("vec_id"), count).cast("int").alias("part"), F.explode(F.sequence(F.lit(0), F.lit(halls - 1))).alias("hall"), "vec_id", "embedding")

    def meet(rows: pa.Table, queries: pa.Table) -> pa.Table:
        if not rows.num_rows or not queries.num_rows:
            return pa.table({"query_id": pa.array([], pa.int64()), "found": pa.array([], _HITS)})
        order = np.argsort(queries["vec_id"].to_numpy())
        found = Search(first.value[0], queries["vec_id"].to_numpy()[order], integers(queries["embedding"], factor)[order], queries["least"].to_numpy()[order], top)
        found.run(rows["vec_id"].to_numpy(), integers(rows["embedding"], factor))
        return found.found()

    keys = ["block", "part", "hall"]
    found = left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInArrow(meet, "query_id long, found array<struct<s:long,v:long>>")
    # a query has `top` rows at most of each block that it met
    ranked = found.groupBy("query_id").agg(best(F.collect_list("found"), top).alias("found")).select("query_id", F.posexplode("found").alias("pos", "hit"))
    return ranked.select("query_id", (F.col("pos") + 1).cast("int").alias("rank"), F.col("hit.v").alias("vec_id"), (-F.col("hit.s")).alias("score"))


def _least(scores: np.ndarray, other: np.ndarray, top: int) -> np.ndarray:
    """The k-th best score of each row among the others, minus infinity with fewer."""
    held = np.where(other, scores, np.iinfo(np.int64).min)
    if held.shape[1] < top:
        return np.full(len(held), -np.inf)
    kth = np.partition(held, held.shape[1] - top, axis=1)[:, held.shape[1] - top]
    return np.where(kth == np.iinfo(np.int64).min, -np.inf, kth.astype(np.float64))


def _edges(measured: DataFrame, total: int, block: int) -> np.ndarray:
    """Ascending lengths between blocks of about `block` vectors; fewer where many are of one length."""
    n = max(1, -(-total // block))
    if n == 1:
        return np.zeros(0)
    found = measured.agg(F.percentile_approx("length", [i / n for i in range(1, n)], 10_000)).first()[0]
    return np.unique(found)


def _dealer(first, factor: int):
    """Vectors with their block, of which 0 has the longest."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        edges = first.value[3]
        for t in batches:
            if t.num_rows:
                length = norms(integers(t["embedding"], factor))
                block = len(edges) - np.searchsorted(edges, length, side="right")
                yield pa.RecordBatch.from_arrays([pa.array(block, pa.int32()), pa.array(length), t["vec_id"], t["embedding"]], names=["block", "length", "vec_id", "embedding"])

    return run
