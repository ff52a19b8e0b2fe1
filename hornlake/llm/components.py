"""Connected components of an edge table by alternating large and small stars, and the union-find that tasks use."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import drop_written, written


class Forest:
    """Union-find over 0..n-1."""

    def __init__(self, n: int):
        self.up = list(range(n))

    def find(self, x: int) -> int:
        up = self.up
        while up[x] != x:
            up[x] = up[up[x]]
            x = up[x]
        return x

    def union(self, a: int, b: int) -> bool:
        """True if a and b were apart."""
        a, b = self.find(a), self.find(b)
        if a == b:
            return False
        self.up[max(a, b)] = min(a, b)
        return True


def _large_star(edges: DataFrame) -> DataFrame:
    """Each node links its larger neighbours to the smallest node around it."""
    both = edges.unionByName(edges.select(F.col("dst").alias("src"), F.col("src").alias("dst")))
    least = both.groupBy("src").agg(F.least(F.min("dst"), F.col("src")).alias("least"))
    return both.where("dst > src").join(least, "src").select(F.col("dst").alias("src"), F.col("least").alias("dst")).where("src <> dst").distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    """Each node links itself and its smaller neighbours to the smallest of them; src is the larger end."""
    least = edges.groupBy("src").agg(F.min("dst").alias("least"))
    moved = edges.join(least, "src").select(F.col("dst").alias("src"), F.col("least").alias("dst"))
    return moved.unionByName(least.select("src", F.col("least").alias("dst"))).where("src <> dst").distinct()


def _mark(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("src", "dst").cast("decimal(38,0)"))).first())


def components(edges: DataFrame) -> DataFrame:
    """(node, root) for each node of edges (src, dst, both long): root is the smallest node that it reaches.

    Loops and repeated edges are ignored; no edges, no rows. A round halves distances at least, so rounds grow with
    the logarithm of the longest path; each round is written to the shared folder.
    """
    larger, smaller = F.greatest("src", "dst").alias("src"), F.least("src", "dst").alias("dst")
    current = written(edges.where("src <> dst").select(larger, smaller).distinct(), "components")
    before = _mark(current)
    while before[0]:
        following = written(_small_star(_large_star(current)), "components")
        drop_written(current)
        current, after = following, _mark(following)
        if after == before:
            break
        before = after
    roots = current.select(F.col("dst").alias("node")).distinct()
    return current.select(F.col("src").alias("node"), F.col("dst").alias("root")).unionByName(roots.select("node", F.col("node").alias("root")))
