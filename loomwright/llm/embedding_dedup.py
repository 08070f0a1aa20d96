"""Near-duplicate embeddings by an inverted multi-index.

Vectors are normalised and cut into two halves. Each half has a codebook of its own, and the pairs of codes form a grid
of cells in which all vectors are filed, apart for each label. A vector visits the cells in the order of a lower bound
of its distance from what lies in them: the bound of a cell is u[i] + v[j], where u and v are the squared distances from
the borders of the two codes' regions, so the order is the multi-sequence one, and the visit ends at the first bound
above a limit.

The limit follows from the target recall. A pair at exactly the threshold differs by a vector of squared length
L = 2 - 2 * threshold. If at most a share s of that lies in any one direction on average, its part across two borders exceeds
-2 ln(1 - recall) * s * L with chance 1 - recall; nearer pairs are missed less often. The share is measured on the sample: that
of the first principal direction of the differences of linked pairs, or of all vectors where the sample has few such pairs;
and the limit is never below what the sample's own linked pairs need, with a margin of MARGIN. L is the worst case: with it nothing can be
missed, whatever the directions. Vectors of few directions get it by this rule, and a target of 1 always does. Then cosines in
double precision decide.

The cells of a label are dealt out to tiles of the grid, as many as its vectors need. A vector travels to a tile once, with a bit
for each of the tile's cells that it visits. Tiles are cut into blocks of members and of visitors, so that no task gets a
whole hot tile, and equal vectors are one member with a weight. A block sends the number of links of each visitor and
the edges of a spanning forest.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomwright.llm.graph import connected_components
from loomwright.llm.vectors import SAMPLE, kmeans, lengths, native, squared, stack, usable
from loomwright.session import materialise, remove

#: With a recall of 1 every linked pair is found, whatever the sample is like; below it the limit is told from the sample.
THRESHOLD, TARGET_RECALL = 0.93, 1.0
#: Vectors of a label that a cell should hold, and the most codes of a half.
CELL, MAX_CODES = 5, 256
#: Members and visitors of a block, and labels of several blocks that are told to all workers.
BLOCK, LARGE_LABELS = 8192, 10_000
#: Linked vectors of the sample for each dimension from which directions are told, pairs that are looked at, and the margin over what they need.
FEW, MOST_PAIRS, MARGIN = 4, 100_000, 1.5


def border_distances(x: np.ndarray, codes: np.ndarray) -> np.ndarray:
    """Squared distance of each row of x from the region of each code: the farthest of the half-spaces that bound the region."""
    d = squared(x, codes)
    apart = np.sqrt(squared(codes, codes))
    np.fill_diagonal(apart, np.inf)
    out = np.zeros_like(d)
    for other in range(len(codes)):
        out = np.maximum(out, (d - d[:, other : other + 1]) / (2 * np.maximum(apart[:, other], 1e-12)))
    return out**2


def multi_sequence(u: np.ndarray, v: np.ndarray, limit: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, i, j) of all cells with u[row, i] + v[row, j] <= limit: for each i in ascending order the first codes j of v's order."""
    by_u, by_v = u.argsort(1, kind="stable"), v.argsort(1, kind="stable")
    su, sv = np.take_along_axis(u, by_u, 1), np.take_along_axis(v, by_v, 1)
    row, a, b = np.nonzero(su[:, :, None] + sv[:, None, :] <= limit)
    return row, by_u[row, a], by_v[row, b]


def _unit(x: np.ndarray) -> np.ndarray:
    x = x / np.maximum(np.abs(x).max(1), 1e-300)[:, None]
    return x / np.linalg.norm(x, axis=1)[:, None]


def _forest(a: np.ndarray, b: np.ndarray) -> list[tuple[int, int]]:
    """Edges of a spanning forest of the graph with edges a[k], b[k]."""
    root: dict[int, int] = {}

    def find(x: int) -> int:
        while (up := root.setdefault(x, x)) != x:
            root[x] = x = root.setdefault(up, up)
        return x

    out = []
    for x, y in zip(a.tolist(), b.tolist()):
        if (p := find(x)) != (q := find(y)):
            root[max(p, q)] = min(p, q)
            out.append((x, y))
    return out


def first_share(x: np.ndarray) -> float:
    """The share of the first principal direction in the squares of the rows of x."""
    total = float((x**2).sum())
    return float(np.linalg.eigvalsh(x.T @ x)[-1]) / total if total else 1.0


class Grid:
    """The two codebooks, and the limit up to which cells are visited."""

    def __init__(self, known: np.ndarray, labels: np.ndarray, k: int, threshold: float, target_recall: float) -> None:
        self.half = half = max(1, known.shape[1] // 2)
        self.first, self.second = kmeans(known[:, :half], k), kmeans(known[:, half:], k, seed=6)
        self.k = k
        self.limit = worst = 2 - 2 * threshold
        if target_recall < 1:
            a, b = self._linked(known, labels, threshold)
            met = len(np.unique([a, b]))
            if met >= FEW * known.shape[1]:  # so few vectors seem to prefer a direction by chance, by this factor at most
                share = first_share(known[a] - known[b]) / (1 + math.sqrt(known.shape[1] / met)) ** 2
            else:
                share = first_share(known - known.mean(0))
            u, v = self.bounds(known[a]) if len(a) else (np.zeros((0, 1)),) * 2
            i, j = self.codes(known[b]) if len(b) else (np.zeros(0, int),) * 2
            need = float((u[np.arange(len(a)), i] + v[np.arange(len(a)), j]).max(initial=0))
            self.limit = min(worst, max(MARGIN * need, -2 * math.log(1 - target_recall) * share * worst))
        self.limit += 1e-9

    @staticmethod
    def _linked(x: np.ndarray, labels: np.ndarray, threshold: float) -> tuple[np.ndarray, np.ndarray]:
        """Rows of linked pairs of the sample, MOST_PAIRS at most."""
        a, b, n = [np.empty(0, int)], [np.empty(0, int)], 0
        order = np.argsort(labels, kind="stable")
        for rows in np.split(order, np.nonzero(np.diff(labels[order]))[0] + 1):
            for at in range(0, len(rows), 512):
                r, c = np.nonzero(x[rows[at : at + 512]] @ x[rows].T >= threshold)
                keep = c > r + at
                a.append(rows[at + r[keep]])
                b.append(rows[c[keep]])
        a, b = np.concatenate(a), np.concatenate(b)
        every = max(1, -(-len(a) // MOST_PAIRS))
        return a[::every], b[::every]

    def bounds(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        return border_distances(x[:, : self.half], self.first), border_distances(x[:, self.half :], self.second)

    def codes(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        return squared(x[:, : self.half], self.first).argmin(1), squared(x[:, self.half :], self.second).argmin(1)

    def visits(self, x: np.ndarray) -> np.ndarray:
        """Which cells each row of x visits: (rows, k, k)."""
        out = np.zeros((len(x), self.k, self.k), dtype=bool)
        out[multi_sequence(*self.bounds(x), self.limit)] = True
        return out


_FOUND = "uid long, n long, a long, b long"


def near_duplicates(vectors: DataFrame, threshold: float = THRESHOLD, target_recall: float = TARGET_RECALL, cell: int = CELL, block: int = BLOCK) -> DataFrame:
    """vec_id, n_links, component_id, kept for each row of vectors(vec_id, embedding, label).

    Only rows of one label, not null, and of one length link. Null, empty and zero vectors, those with null or non-finite
    components and those without a label have no links and are their own component. Equal rows link. A null vec_id stays
    null and counts for others' n_links; it never names a component and is never kept. Other columns are ignored.
    """
    kind = dict(vectors.dtypes)["embedding"]
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), "label", native(kind=kind).alias("embedding"))
    part = F.col("label").isNotNull() & usable()
    alone = rows.filter(~part).select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"), F.col("vec_id").isNotNull().alias("kept"))
    some = rows.filter(part)
    # 128 bits stand for a vector, so that it needn't travel to find its equals
    keyed = some.select("vec_id", "label", "embedding", F.size("embedding").alias("size"), F.xxhash64("embedding").alias("h1"), F.xxhash64(F.lit(7), F.reverse("embedding")).alias("h2"))
    keys = ["label", "size", "h1", "h2"]
    reps = materialise(
        keyed.groupBy(*keys).agg(F.any_value("embedding").alias("embedding"), F.min("vec_id").alias("first_id"), F.count("*").alias("weight")).withColumn("uid", F.monotonically_increasing_id()), "distinct-vectors"
    )
    found = [_links(some, threshold, target_recall, cell, block) for size, _ in lengths(reps) for some in _classes(reps.filter(F.col("size") == size), block)]
    if not found:
        return alone
    links = found[0]
    for more in found[1:]:
        links = links.union(more)
    counts = links.filter("uid is not null").groupBy("uid").agg(F.sum("n").alias("n"))
    comps = connected_components(links.filter("a is not null").select("a", "b"))
    slim = reps.select("uid", "first_id", "weight")
    labelled = slim.join(comps, slim.uid == comps.node, "left").select("uid", "first_id", "weight", F.coalesce("component", "uid").alias("component"))
    least = labelled.groupBy("component").agg(F.min("first_id").alias("component_id"))
    of_rep = labelled.join(least, "component").join(counts, "uid", "left").select("uid", "component_id", (F.coalesce("n", F.lit(0)) + F.col("weight") - 1).alias("n_links"))
    full = reps.select(*keys, "uid").join(of_rep, "uid").drop("uid")
    kept = F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(False))
    return keyed.select("vec_id", *keys).join(full, keys).select("vec_id", "n_links", "component_id", kept.alias("kept")).union(alone)


def _classes(reps: DataFrame, block: int) -> list[DataFrame]:
    """Vectors of labels that fill several blocks, and all others: a grid fine enough for the first would scatter the others over its tiles."""
    counts = reps.groupBy("label").count()
    every, n = counts.agg(F.count("*"), F.count_if(F.col("count") > 4 * block)).first()
    if n in (0, every):
        return [reps]
    large = counts.filter(F.col("count") > 4 * block).select("label")
    large = F.broadcast(large) if n <= LARGE_LABELS else large
    return [reps.join(large, "label", "left_semi"), reps.join(large, "label", "left_anti")]


def _links(reps: DataFrame, threshold: float, target_recall: float, cell: int, block: int) -> DataFrame:
    """_FOUND: links (uid, n) of blocks and edges (a, b) of their forests, for distinct vectors of one length."""
    # rows of the label that a row of the table has on average, so that a frequent label isn't lost among many rare ones
    counts = reps.groupBy("label").count().agg(F.sum(F.col("count").cast("double") * F.col("count")) / F.sum("count")).first()[0]
    taken = reps.select("label", "uid", "embedding").orderBy(F.xxhash64("uid"), "uid").limit(SAMPLE).toArrow()
    _, of_label = np.unique(taken["label"].to_numpy(zero_copy_only=False), return_inverse=True) if taken.num_rows else (None, np.empty(0, int))
    each = counts or 0.0
    k = int(min(MAX_CODES, max(1, math.ceil(math.sqrt(each / cell)))))
    grid = Grid(_unit(stack(taken["embedding"])), of_label, k, threshold, target_recall)
    # tiles are `side` by `side` codes
    side = -(-k // max(1, min(k, math.ceil(math.sqrt(each / block)))))
    across = -(-k // side)
    bits = (side * side + 7) // 8

    def filed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in batches:
            i, j = grid.codes(_unit(stack(t["embedding"])))
            tile, at = i // side * across + j // side, i % side * side + j % side
            yield pa.RecordBatch.from_arrays([t["label"], pa.array(tile, pa.int32()), pa.array(at, pa.int32()), t["uid"], t["weight"], t["embedding"]], names=["label", "tile", "cell", "uid", "weight", "embedding"])

    def visiting(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in batches:
            for at in range(0, t.num_rows, 1024):
                s = t.slice(at, 1024)
                seen = np.zeros((s.num_rows, across * side, across * side), dtype=bool)
                seen[:, :k, :k] = grid.visits(_unit(stack(s["embedding"])))
                tiles = seen.reshape(-1, across, side, across, side).transpose(0, 1, 3, 2, 4).reshape(s.num_rows, across * across, side * side)
                row, tile = np.nonzero(tiles.any(2))
                marks = np.packbits(tiles[row, tile], axis=1).tobytes()
                picked = s.take(pa.array(row))
                yield pa.RecordBatch.from_arrays([picked["label"], pa.array(tile, pa.int32()), pa.array([marks[bits * r : bits * r + bits] for r in range(len(row))], pa.binary()), picked["uid"], picked["embedding"]], names=["label", "tile", "cells", "uid", "embedding"])

    kind, vector = dict(reps.dtypes)["label"], dict(reps.dtypes)["embedding"]
    members = reps.select("label", "uid", "weight", "embedding").mapInArrow(filed, f"label {kind}, tile int, cell int, uid long, weight long, embedding {vector}")
    visitors = reps.select("label", "uid", "embedding").mapInArrow(visiting, f"label {kind}, tile int, cells binary, uid long, embedding {vector}")
    spread = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    own = lambda n: F.pmod(F.xxhash64("uid"), F.col(n)).cast("int")
    # one row for each tile of each label
    blocks = materialise(members.groupBy("label", "tile").agg(F.ceil(F.count("*") / block).cast("int").alias("m")).join(visitors.groupBy("label", "tile").agg(F.ceil(F.count("*") / block).cast("int").alias("v")), ["label", "tile"]), "blocks", small=True)
    left = members.join(blocks, ["label", "tile"]).select("label", "tile", own("m").alias("mb"), spread("v").alias("vb"), "cell", "uid", "weight", "embedding")
    right = visitors.join(blocks, ["label", "tile"]).select("label", "tile", spread("m").alias("mb"), own("v").alias("vb"), "cells", "uid", "embedding")

    def verified(of_members: pa.Table, of_visitors: pa.Table) -> pa.Table:
        out = {"uid": [], "n": [], "a": [], "b": []}
        if of_members.num_rows and of_visitors.num_rows:
            cell_of = of_members["cell"].to_numpy()
            order = np.argsort(cell_of, kind="stable")
            cells, starts = np.unique(cell_of[order], return_index=True)
            m, w = of_members["uid"].to_numpy()[order], of_members["weight"].to_numpy()[order]
            y = _unit(stack(of_members["embedding"]))[order]
            q, x = of_visitors["uid"].to_numpy(), _unit(stack(of_visitors["embedding"]))
            marks = np.frombuffer(b"".join(of_visitors["cells"].to_pylist()), np.uint8).reshape(len(q), bits)
            n, edges_a, edges_b = np.zeros(len(q), np.int64), [np.empty(0, np.int64)], [np.empty(0, np.int64)]
            for c, a, b in zip(cells.tolist(), starts.tolist(), [*starts[1:].tolist(), len(m)]):
                some = np.nonzero(marks[:, c // 8] & (128 >> c % 8))[0]
                near = x[some] @ y[a:b].T >= threshold
                near &= q[some, None] != m[a:b]
                n[some] += near @ w[a:b]
                r, at = np.nonzero(near)
                edges_a.append(q[some[r]])
                edges_b.append(m[a + at])
            edges = _forest(np.concatenate(edges_a), np.concatenate(edges_b))
            some = np.nonzero(n)[0]
            out = {"uid": [*q[some].tolist(), *[None] * len(edges)], "n": [*n[some].tolist(), *[None] * len(edges)], "a": [*[None] * len(some), *(e[0] for e in edges)], "b": [*[None] * len(some), *(e[1] for e in edges)]}
        return pa.table({c: pa.array(x, pa.int64()) for c, x in out.items()})

    keys = ["label", "tile", "mb", "vb"]
    found = materialise(left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInArrow(verified, _FOUND), "links")
    remove(blocks)
    return found
