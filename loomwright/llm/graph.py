"""Connected components by alternating large-star and small-star joins."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomwright.session import materialise, remove


def _large_star(edges: DataFrame) -> DataFrame:
    """Every node links its larger neighbours to the smallest node that it knows."""
    both = edges.select("a", "b").union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = both.groupBy("a").agg(F.least(F.col("a"), F.min("b")).alias("m"))
    return both.join(least, "a").filter("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    """Every node links itself and its smaller neighbours to the smallest of them."""
    down = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    least = down.groupBy("a").agg(F.min("b").alias("m"))
    moved = down.join(least, "a").filter("b > m").select(F.col("b").alias("a"), F.col("m").alias("b"))
    return moved.union(least.select("a", F.col("m").alias("b"))).distinct()


def connected_components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """(node, component) for every node of edges(a, b): component is the smallest node reachable.

    Rows with a null end and loops say nothing and are left out; repeated rows count once. An empty
    table gives an empty result. Each round is written to the shared folder, so that no plan grows
    with the rounds; a hub's row in the joins is a single (node, minimum) row, and its neighbours are
    split by Spark's skew join. The number of rounds is logarithmic in the size of a component.
    """
    now = materialise(edges.select("a", "b").filter("a <> b").distinct(), "edges", small=True)
    seen = None
    for _ in range(max_rounds):
        mark = now.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if mark == seen or mark[0] == 0:
            break
        seen = mark
        before, now = now, materialise(_small_star(_large_star(now)), "edges", small=True)
        remove(before)
    else:
        raise RuntimeError(f"components have not settled after {max_rounds} rounds")
    roots = now.select(F.col("b").alias("node")).distinct()
    return now.select(F.col("a").alias("node"), F.col("b").alias("component")).union(roots.select("node", F.col("node").alias("component")))
