"""Connected components of a graph given as edges, by joins only."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tideledger.session import durable


def _both_ways(edges: DataFrame) -> DataFrame:
    return edges.select("a", "b").union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))


def _large_star(edges: DataFrame) -> DataFrame:
    """Each node's larger neighbours are tied to the least of its neighbours and itself."""
    pairs = _both_ways(edges)
    least = pairs.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("m"))
    return (pairs.where("b > a").join(least, "a")
            .select(F.col("b").alias("a"), F.col("m").alias("b")).where("a != b").distinct())


def _small_star(edges: DataFrame) -> DataFrame:
    """Each node and its smaller neighbours are tied to the least of them."""
    down = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    least = down.groupBy("a").agg(F.min("b").alias("m"))
    own = least.select("a", F.col("m").alias("b"))
    return (down.join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b"))
            .union(own).where("a != b").distinct())


def components(edges: DataFrame) -> DataFrame:
    """node, root: every node of an edge with the least node of its component.

    Alternates large and small stars until the edges stay the same; the rounds grow with the
    logarithm of the nodes. Each round is written, so a lost executor repeats one round at most.
    Joins are on a node; its own row on the other side is unique, so a hot node can be split.
    """
    edges = durable(edges.where("a != b").distinct())
    while True:
        after = durable(_small_star(_large_star(edges)))
        change = _digest(after)
        if change == _digest(edges):
            break
        edges = after
    return (after.select(F.col("a").alias("node"), F.col("b").alias("root"))
            .union(after.select(F.col("b").alias("node"), F.col("b").alias("root"))).distinct())


def _digest(edges: DataFrame) -> tuple:
    """Number and hash of the set of edges, each as larger and smaller node."""
    h = F.xxhash64(F.greatest("a", "b"), F.least("a", "b"))
    return tuple(edges.agg(F.count(F.lit(1)), F.bit_xor(h), F.sum(F.shiftright(h, 20))).first())
