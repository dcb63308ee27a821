"""Connected components of an edge list, on the cluster.

Alternating large-star and small-star rounds (Kiveris et al., 2014): each is a min-aggregation,
which combines before the shuffle, and a join on the node, which adaptive execution can split.
Edges are written to the shared folder after each round, so lineage stays short and a lost
executor costs one round at most.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import dropped, written


class Forest:
    """Union-find over 64-bit nodes, the smallest node of a tree as its root."""

    def __init__(self) -> None:
        self.parent: dict[int, int] = {}

    def find(self, x: int) -> int:
        parent = self.parent
        root = x
        while (up := parent.get(root, root)) != root:
            root = up
        while x != root:
            parent[x], x = root, parent.get(x, x)
        return root

    def link(self, x: int, y: int) -> None:
        a, b = self.find(x), self.find(y)
        if a != b:
            lo, hi = (a, b) if a < b else (b, a)
            self.parent[hi] = lo
            self.parent.setdefault(lo, lo)

    def edges(self) -> tuple[np.ndarray, np.ndarray]:
        """(node, root) for each node that isn't a root."""
        pairs = [(x, r) for x in list(self.parent) if (r := self.find(x)) != x]
        both = np.array(pairs, np.int64).reshape(-1, 2)
        return both[:, 0], both[:, 1]


def _large_star(edges: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Over (u, v), u > v: each upper end is hung onto the smallest node around its lower end.  Also the look-up table.

    Only nodes with a smaller neighbour are looked up, and the look-up table is written first: the
    join then has an exchange of its own on both sides, so the edges of a hub can be split.
    """
    both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    lows = written(both.groupBy("u").agg(F.min("v").alias("m")).filter("m < u").select(F.col("u").alias("v"), "m"), "lows")
    return edges.join(lows, "v", "left").select("u", F.coalesce("m", "v").alias("v")), lows


def _small_star(edges: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Over (u, v), u > v: the lower neighbours of each node, and it itself, are hung onto the smallest of them.  Also the look-up table."""
    lows = written(edges.groupBy("u").agg(F.min("v").alias("m")), "lows")
    hung = edges.join(lows, "u").filter("v != m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return lows.select("u", F.col("m").alias("v")).unionByName(hung), lows


def _stars(edges: DataFrame) -> bool:
    """Whether the edges (u, v), u > v, are stars already: no node hangs on two others, or on one while others hang on it."""
    ends = edges.select(F.col("u").alias("n"), F.lit(1).alias("up")).unionByName(edges.select(F.col("v").alias("n"), F.lit(None).cast("int").alias("up")))
    return ends.groupBy("n").agg(F.count("up").alias("ups"), F.count("*").alias("ends")).filter("ups > 0 AND ends > 1").isEmpty()


def components(edges: DataFrame) -> DataFrame:
    """(node, root) for each node of ``edges`` (u, v: long) but the roots; root: the component's smallest node.

    Loops and repeated edges are allowed; an empty edge list gives no row.  A round's tables are
    deleted when the next round's are written.
    """
    now = edges.filter("u != v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct()
    now = written(now, "edges")
    while not _stars(now):
        large, lows = _large_star(now)
        between = written(large.distinct(), "edges")
        small, more = _small_star(between)
        after = written(small.distinct(), "edges")
        for old in (now, lows, between, more):
            dropped(old)
        now = after
    return now.select(F.col("u").alias("node"), F.col("v").alias("root"))
