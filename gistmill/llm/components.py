"""Connected components of links, by alternating stars.

Each round hangs every node's larger neighbours on the smallest node that it sees, and then
its smaller ones, until nothing changes; the number of rounds grows with the logarithm of
the longest path.  Links stay on the executors; the driver sees two numbers a round.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gistmill.session import staged


def components(links: DataFrame) -> DataFrame:
    """``node, root`` for every node of ``links`` (bigint columns ``a, b``); root is the smallest reachable node.

    Repeated links, links of a node with itself and links in both directions are allowed;
    links with a null end are left out.
    """
    edges = staged(
        links.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "star-links"
    )
    before = None
    while True:
        now = edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if now == before or now[0] == 0:
            break
        before = now
        edges = staged(_small_star(_large_star(edges)), "star-links")
    roots = edges.select(F.col("a").alias("node"), F.col("b").alias("root"))
    return roots.unionByName(edges.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct())


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    # written, so that Spark can split a node with very many links when joining
    least = staged(both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("least")), "star-minima")
    return both.join(least, "a").where("b > a").select(F.col("b").alias("a"), F.col("least").alias("b")).where("a <> b").distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    least = edges.groupBy("a").agg(F.min("b").alias("least"))
    joined = edges.join(least, "a")
    below = joined.where("b <> least").select(F.col("b").alias("a"), F.col("least").alias("b"))
    return below.unionByName(least.select("a", F.col("least").alias("b"))).distinct()


def spanning(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """As few links as join the same nodes: every node with the smallest of its component."""
    if not len(a):
        return a, b
    nodes, ends = np.unique(np.concatenate([a, b]), return_inverse=True)
    x, y = ends[: len(a)], ends[len(a):]
    root = np.arange(len(nodes))
    while True:
        least = np.minimum(root[x], root[y])
        after = root.copy()
        np.minimum.at(after, root[x], least)
        np.minimum.at(after, root[y], least)
        after = after[after]
        while not np.array_equal(after, after[after]):
            after = after[after]
        if np.array_equal(after, root):
            break
        root = after
    moved = root != np.arange(len(nodes))
    return nodes[moved], nodes[root[moved]]
