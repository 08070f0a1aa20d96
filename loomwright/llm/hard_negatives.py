"""Hard negatives by sorting each anchor's scores.

Scores are exact integer inner products. Blocks of anchors meet blocks of rows. First each anchor's best rows of its own
label are its positives. Then, in each block, the rows of other labels are put in order by score and id for each anchor, a
binary search finds the first that is at most `most` hundredths of a positive's score, and the next ones that reach `least`
hundredths are read from there. Each block returns `top` rows for an anchor and a positive at most, and the best of all
blocks are the result. No label, however frequent, is in one task: blocks are dealt by the hash of the id.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomwright.llm.vectors import LARGEST, best, integers, integral, lengths, native, one_row_each, products, tile_rows
from loomwright.session import materialise

FACTOR, POSITIVES, TOP = 256, 5, 3
#: A negative's score is between so many hundredths of the positive's.
LEAST, MOST = 50, 95
#: Anchors of a block, and scores that are held at a time.
ANCHORS, HELD = 4096, 1 << 21

_HITS = pa.list_(pa.struct([("s", pa.int64()), ("v", pa.int64())]))


def limits(positive: int, least: int = LEAST, most: int = MOST) -> tuple[int, int]:
    """The smallest and the largest score n with least * positive <= 100 * n <= most * positive."""
    return -(-least * positive // 100), most * positive // 100


def ordered(scores: np.ndarray, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Each row's negative scores and ids, highest score first, ties by smaller id."""
    order = np.lexsort((np.broadcast_to(ids, scores.shape), -scores), axis=1)
    return np.take_along_axis(-scores, order, 1), ids[order]


def _slices(anchors: np.ndarray, width: int) -> Iterator[np.ndarray]:
    step = max(1, HELD // max(1, width))
    for at in range(0, len(anchors), step):
        yield anchors[at : at + step]


def mine(
    vectors: DataFrame, is_anchor: Column, label: Column | None = None, positives: int = POSITIVES, top: int = TOP, least: int = LEAST, most: int = MOST, factor: int = FACTOR, block: int | None = None, anchors: int = ANCHORS
) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score for the anchors among vectors(vec_id, label, embedding).

    Scores are inner products of floor(factor * x). An anchor's positives are the first other rows of its label, its negatives
    for a positive the first rows of other labels with least * positive_score <= 100 * negative_score <= most * positive_score;
    fewer rows where there are fewer. label: an expression over the columns that replaces the label. Rows whose id, label or
    vector is null, or with a null or non-finite component (after the multiplication too), take no part; zero and empty
    vectors do. Vectors of each length meet among themselves. An id counts once: of rows with one id the first by label and
    components. A score beyond 2**63 - 2 counts as that. Other columns are ignored; an empty table gives an empty one.
    """
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), (F.col("label") if label is None else label).cast("long").alias("label"), native(kind=dict(vectors.dtypes)["embedding"]).alias("embedding"))
    base = materialise(one_row_each(rows.filter(F.col("vec_id").isNotNull() & F.col("label").isNotNull() & integral(factor)), "label", "embedding"), "rows")
    out = vectors.sparkSession.createDataFrame([], "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long")
    for size, total in lengths(base):
        out = out.union(_of_length(base.filter(F.size("embedding") == size), is_anchor, total, positives, top, least, most, factor, block or tile_rows(total), anchors))
    return out


def _met(base: DataFrame, asked: DataFrame, total: int, block: int, anchors: int, meet: Callable[[pa.Table, pa.Table], pa.Table], schema: str) -> DataFrame:
    """meet() of every block of base with every block of asked."""
    blocks, halls = max(1, -(-total // block)), max(1, -(-asked.count() // anchors))
    each = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    own = lambda n: F.pmod(F.xxhash64("vec_id"), F.lit(n)).cast("int")
    left = base.withColumn("block", own(blocks)).withColumn("hall", each(halls))
    right = asked.withColumn("hall", own(halls)).withColumn("block", each(blocks))
    return left.groupBy("block", "hall").cogroup(right.groupBy("block", "hall")).applyInArrow(meet, schema)


def _of_length(base: DataFrame, is_anchor: Column, total: int, positives: int, top: int, least: int, most: int, factor: int, block: int, anchors: int) -> DataFrame:
    """mine() for vectors of one length."""

    def table(t: pa.Table) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Ids, ascending, labels and integers."""
        order = np.argsort(t["vec_id"].to_numpy())
        return t["vec_id"].to_numpy()[order], t["label"].to_numpy()[order], integers(t["embedding"], factor)[order]

    def near(rows: pa.Table, asked: pa.Table) -> pa.Table:
        """(anchor_id, found): the best rows of the anchor's label."""
        out: list[dict] = []
        if rows.num_rows and asked.num_rows:
            (ids, labels, x), (own, kind, q) = table(rows), table(asked)
            for k in np.unique(kind):
                same = np.nonzero(labels == k)[0]
                for some in _slices(np.nonzero(kind == k)[0], len(same)) if len(same) else ():
                    s, v = ordered(products(q[some], x[same]), ids[same])
                    for a, score, vec in zip(own[some].tolist(), s[:, : positives + 1].tolist(), v[:, : positives + 1].tolist()):
                        found = [{"s": n, "v": i} for n, i in zip(score, vec) if i != a][:positives]
                        out.append({"vec_id": a, "found": found})
        return pa.Table.from_pylist(out, schema=pa.schema([("vec_id", pa.int64()), ("found", _HITS)]))

    def below(rows: pa.Table, asked: pa.Table) -> pa.Table:
        """(anchor_id, positive_id, positive_score, found): the first rows of other labels between each positive's limits."""
        out: list[dict] = []
        if rows.num_rows and asked.num_rows:
            (ids, labels, x), (own, kind, q) = table(rows), table(asked)
            wanted = asked["positives"].take(pa.array(np.argsort(asked["vec_id"].to_numpy()))).to_pylist()
            for k in np.unique(kind):
                other = np.nonzero(labels != k)[0]
                for some in _slices(np.nonzero(kind == k)[0], len(other)) if len(other) else ():
                    s, v = ordered(products(q[some], x[other]), ids[other])
                    for a, score, vec in zip(some.tolist(), s, v):
                        for p in wanted[a]:
                            low, high = limits(-p["s"], least, most)
                            if high >= -LARGEST and low <= high:
                                at = int(np.searchsorted(score, -min(high, LARGEST), side="left"))
                                found = [{"s": n, "v": i} for n, i in zip(score[at : at + top].tolist(), vec[at : at + top].tolist()) if -n >= low]
                                if found:
                                    out.append({"anchor_id": int(own[a]), "positive_id": p["v"], "positive_score": -p["s"], "found": found})
        return pa.Table.from_pylist(out, schema=pa.schema([("anchor_id", pa.int64()), ("positive_id", pa.int64()), ("positive_score", pa.int64()), ("found", _HITS)]))

    asked = base.filter(is_anchor)
    hits = "array<struct<s:long,v:long>>"
    own = _met(base, asked, total, block, anchors, near, f"vec_id long, found {hits}")
    # an anchor has `positives` rows at most of each block, then `top` rows for each positive
    own = own.groupBy("vec_id").agg(best(F.collect_list("found"), positives).alias("positives"))
    asked = materialise(asked.join(own, "vec_id"), "positives")
    found = _met(base, asked, total, block, anchors, below, f"anchor_id long, positive_id long, positive_score long, found {hits}")
    keys = ["anchor_id", "positive_id", "positive_score"]
    ranked = found.groupBy(*keys).agg(best(F.collect_list("found"), top).alias("found")).select(*keys, F.posexplode("found").alias("pos", "hit"))
    return ranked.select("anchor_id", "positive_id", (F.col("pos") + 1).cast("int").alias("rank"), F.col("hit.v").alias("negative_id"), "positive_score", (-F.col("hit.s")).alias("negative_score"))
