"""Connected components of a table of links, by alternating large-star and small-star rounds."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut


def _nearest(edges: DataFrame) -> DataFrame:
    """(u, m): the smallest of u and its neighbours. Partial sums are combined before the shuffle, so a hub costs one row a task."""
    return edges.groupBy("u").agg(F.min("v").alias("v")).select("u", F.least("u", "v").alias("m"))


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    return both.join(_nearest(both), "u").filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    down = edges.filter("u > v")
    low = _nearest(down)
    hung = down.join(low, "u").filter("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return hung.union(low.filter("u <> m").select("u", F.col("m").alias("v"))).distinct()


def connected_components(links: DataFrame, most_rounds: int = 60) -> DataFrame:
    """(node, root) for every node of the links (a, b) of type long; root is the smallest node of its component.

    Self links name a node without joining it to another. The rounds end when the set of edges no longer
    changes, after a number of rounds that grows with the logarithm of the component size;
    each round is a checkpoint, so a lost executor costs one round at most.
    """
    edges = cut(links.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct())
    alone = edges.filter("u = v").select(F.col("u").alias("node"))
    edges, before = edges.filter("u <> v"), None
    for _ in range(most_rounds):
        edges = cut(_small_star(_large_star(edges)))
        state = tuple(edges.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("u", "v"))).first())
        if state == before:
            break
        before = state
    else:
        raise RuntimeError(f"components did not settle in {most_rounds} rounds")
    stars = edges.select(F.col("u").alias("node"), F.col("v").alias("root"))
    roots = stars.select(F.col("root").alias("node")).distinct().select("node", F.col("node").alias("root"))
    found = stars.union(roots)
    return found.union(alone.join(found, "node", "left_anti").select("node", F.col("node").alias("root")))
