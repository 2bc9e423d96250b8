"""Connected components of a large graph by contraction."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, functions as F

from brinewave.session import cut_lineage


def local_roots(a: np.ndarray, b: np.ndarray, n: int) -> np.ndarray:
    """Smallest reachable number for each of n nodes, by hooking and pointer jumping."""
    root = np.arange(n)
    while True:
        ra, rb = root[a], root[b]
        low = np.minimum(ra, rb)
        before = root.copy()
        np.minimum.at(root, ra, low)
        np.minimum.at(root, rb, low)
        while not np.array_equal(jumped := root[root], root):
            root = jumped
        if np.array_equal(root, before):
            return root


def components(links: DataFrame) -> DataFrame:
    """node, root for every node of links(a, b): root is the smallest node reachable.

    Each round hooks every node to its smallest neighbour, jumps pointers twice and
    contracts the links, so the graph that is left shrinks by half at least. Minima are
    combined before they are shuffled; links of a popular node are rows of a join, which
    adaptive execution splits.
    """
    left = cut_lineage(links.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct())
    ends = left.select(F.col("a").alias("node")).union(left.select(F.col("b").alias("node"))).distinct()
    labels = cut_lineage(ends.withColumn("root", F.col("node")))
    while left.count():
        # the larger end of a link hooks to its smallest neighbour
        hooks = cut_lineage(left.groupBy(F.col("b").alias("root")).agg(F.min("a").alias("up")))
        for _ in range(2):
            jump = hooks.select(F.col("root").alias("up"), F.col("up").alias("_next"))
            hooks = cut_lineage(hooks.join(jump, "up", "left").select("root", F.coalesce("_next", "up").alias("up")))
        labels = cut_lineage(labels.join(hooks, "root", "left").select("node", F.coalesce("up", "root").alias("root")))
        for end in ("a", "b"):
            moved = hooks.select(F.col("root").alias(end), "up")
            left = left.join(moved, end, "left").select(F.coalesce("up", end).alias(end), "b" if end == "a" else "a")
        left = cut_lineage(left.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct())
    return labels
