"""What the operators on embeddings share."""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Vectors from which codebooks and centroids are fitted: those with the smallest hash of their id.
SAMPLE = 20_000


def usable(col: str = "embedding") -> Column:
    """Whether a vector takes part: not null, not empty, no null or non-finite component, not zero."""
    v = F.col(col).cast("array<double>")
    finite = F.forall(v, lambda x: F.coalesce(~F.isnan(x) & (F.abs(x) < float("inf")), F.lit(False)))
    return F.coalesce((F.size(v) > 0) & finite & F.exists(v, lambda x: x != 0), F.lit(False))


def lengths(vectors: DataFrame) -> list[tuple[int, int]]:
    """(length, rows) of vectors(embedding), the longest first: vectors of unlike lengths are never compared."""
    return [(r[0], r[1]) for r in vectors.groupBy(F.size("embedding").alias("n")).count().orderBy(F.desc("n")).collect()]


def native(col: str = "embedding", kind: str = "array<double>") -> Column:
    """Vectors as they travel: arrays of float stay so, for a double adds nothing to them; all others become doubles."""
    return F.col(col) if kind == "array<float>" else F.col(col).cast("array<double>")


def sample(vectors: DataFrame, n: int = SAMPLE, id_col: str = "vec_id") -> np.ndarray:
    """At most n vectors of vectors(id, embedding), one in a row, in an order that doesn't depend on how they are dealt."""
    rows = vectors.select(F.col(id_col), "embedding").orderBy(F.xxhash64(id_col), id_col, "embedding").limit(n)
    return stack(rows.toArrow()["embedding"])


def stack(column: pa.Array | pa.ChunkedArray) -> np.ndarray:
    """Equally long vectors as a matrix of doubles."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    flat = np.asarray(column.flatten().to_numpy(zero_copy_only=False), dtype=np.float64)
    return flat.reshape(len(column), len(flat) // max(1, len(column)))


def squared(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Squared distances of all rows of x from all rows of y."""
    return np.maximum((x**2).sum(1)[:, None] - 2 * x @ y.T + (y**2).sum(1), 0)


def kmeans(x: np.ndarray, k: int, rounds: int = 12, seed: int = 5) -> np.ndarray:
    """At most k centroids; an empty cluster begins anew at the vector farthest from its centroid."""
    k = max(1, min(k, len(x)))
    rng = np.random.default_rng(seed)
    centres = x[np.sort(rng.choice(len(x), k, replace=False))]
    for _ in range(rounds):
        d = squared(x, centres)
        own = d.argmin(1)
        n = np.bincount(own, minlength=k)
        far = np.argsort(-d[np.arange(len(x)), own], kind="stable")
        sums = np.zeros_like(centres)
        np.add.at(sums, own, x)
        centres = np.where(n[:, None] > 0, sums / np.maximum(n, 1)[:, None], centres)
        for j, c in enumerate(np.nonzero(n == 0)[0]):
            centres[c] = x[far[j % len(far)]]
    return np.unique(centres, axis=0)


#: Integer scores beyond it, or below its negative, count as it; one less than a long holds, whose own end marks what isn't there.
LARGEST = 2**63 - 2


def integral(factor: int, col: str = "embedding") -> Column:
    """Whether all of a vector's components are finite once multiplied; null vectors aren't, empty and zero ones are."""
    return F.coalesce(F.forall(F.col(col).cast("array<double>"), lambda x: F.coalesce(~F.isnan(x) & (F.abs(x * factor) < float("inf")), F.lit(False))), F.lit(False))


def integers(column: pa.Array | pa.ChunkedArray, factor: int) -> np.ndarray:
    """floor(factor * x) of equally long vectors, as a matrix of doubles that hold integers."""
    return np.floor(stack(column) * factor)


def one_row_each(rows: DataFrame, *columns: str, id_col: str = "vec_id") -> DataFrame:
    """One row for each id: of several that differ the first by the columns, in their order."""
    return rows.groupBy(id_col).agg(F.min(F.struct(*columns)).alias("first")).select(id_col, *(F.col(f"first.{c}").alias(c) for c in columns))


def safe(x: np.ndarray, y: np.ndarray) -> bool:
    """Whether every inner product of rows of x and y, partial sums included, is exact in doubles."""
    return x.size == 0 or y.size == 0 or x.shape[1] * float(np.abs(x).max()) * float(np.abs(y).max()) <= 2.0**53


def _clipped(values: np.ndarray) -> np.ndarray:
    return np.array([max(-LARGEST, min(LARGEST, int(v))) for v in values.ravel()], dtype=np.int64).reshape(values.shape)


def _whole(x: np.ndarray) -> np.ndarray:
    out = np.empty(x.shape, dtype=object)
    out.ravel()[:] = [int(v) for v in x.ravel()]
    return out


def products(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Exact inner products of all rows of x with all rows of y, whose doubles hold integers."""
    if safe(x, y):
        return (x @ y.T).astype(np.int64)
    return _clipped(_whole(x) @ _whole(y).T)


def paired(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Exact inner products of the rows of x with the same rows of y."""
    if safe(x, y):
        return np.einsum("ij,ij->i", x, y).astype(np.int64)
    return _clipped((_whole(x) * _whole(y)).sum(1))


def tile_rows(rows: int) -> int:
    """Rows of a block, where every block of rows meets every block of queries: more rows a block where there are many, so that both travel less."""
    return int(min(65_536, max(4096, 16 * math.sqrt(rows))))


def best(found: Column, top: int) -> Column:
    """The first of an array of array<struct<s, v>>, where s is the negative score."""
    return F.slice(F.array_sort(F.flatten(found)), 1, top)
