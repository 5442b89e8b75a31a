"""Connected components of an edge table, by alternating large-star and small-star steps."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import keep


def forest(i: np.ndarray, j: np.ndarray, root: np.ndarray) -> np.ndarray:
    """Roots after places ``i`` and ``j`` are linked pairwise; ``root`` gives the smallest known place of each place's component."""
    while True:
        low = np.minimum(root[i], root[j])
        new = root.copy()
        for end in (i, j):
            np.minimum.at(new, root[end], low)
        while (new[new] != new).any():
            new = new[new]
        if (new == root).all():
            return root
        root = new


def _state(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(20,0)"))).first())


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """Returns (node, root) for every node that has an edge; root is the smallest node of its component.

    Every step replaces edges by edges to a smaller neighbour; their number never grows, and the rounds needed grow
    with the logarithm of the longest path. Each round is written to the shared folder. Loops and repeated edges are
    ignored; no edges give no rows. A node with many edges is only ever aggregated (with partial sums) or joined;
    beyond a partition of 256 MB (Spark's default) adaptive execution splits the join on it.
    """
    links = edges.where(F.col(a) != F.col(b)).select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).distinct()
    links, before = keep(links, "links"), None
    while (now := _state(links)) != before and now[0]:
        before = now
        both = links.unionByName(links.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(low, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u != v").distinct()
        large = keep(large, "large-star")
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(low.select("u", F.col("m").alias("v")))
        links = keep(small.where("u != v").distinct(), "small-star")
    return links.groupBy("u").agg(F.min("v").alias("root")).select(F.col("u").alias("node"), "root").unionByName(
        links.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct()
    )
