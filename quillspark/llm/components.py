"""Connected components by alternating large and small stars, wholly distributed."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillspark.llm.common import Scratch, apart


#: Neighbours of a node from which on the joins by node get exchanges of their own, so that AQE can split them.
HUB = 1_000_000


def _named(least: DataFrame, hub: bool) -> DataFrame:
    return least.select((apart(F.col("a")) if hub else F.col("a")).alias("a"), "m")


def _large(edges: DataFrame, hub: bool) -> DataFrame:
    """Every larger neighbour of a node is linked to the node's smallest neighbour, or to the node if that is smaller."""
    both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
    return both.where("b > a").join(_named(least, hub), "a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").distinct()


def _small(edges: DataFrame, hub: bool) -> DataFrame:
    """A node and its smaller neighbours are linked to the smallest of them."""
    down = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
    least = down.groupBy("a").agg(F.min("b").alias("m"))
    across = down.join(_named(least, hub), "a").where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
    return across.unionByName(least.select("a", F.col("m").alias("b"))).distinct()


def _state(edges: DataFrame) -> tuple[bool, bool]:
    """Whether every node has one link at most, and none leads to a node that has one itself; and whether a node is a hub."""
    ends = edges.select("a", F.lit(1).alias("links"), F.lit(0).alias("root")).unionByName(edges.select(F.col("b").alias("a"), F.lit(0).alias("links"), F.lit(1).alias("root")))
    nodes = ends.groupBy("a").agg(F.sum("links").alias("links"), F.sum("root").alias("root"))
    unsettled = F.count_if(F.expr("links > 1 or (links > 0 and root > 0)"))
    found = nodes.agg(unsettled.alias("open"), F.max(F.col("links") + F.col("root")).alias("widest")).first()
    return found.open == 0, (found.widest or 0) >= HUB


def components(edges: DataFrame, keep: Scratch) -> DataFrame:
    """(id, component) for each node of the edges (a, b); a component is named by its smallest node.

    Each round is a table in the shared folder, deleted when the next is there; the last is left to ``keep``. Hot nodes
    are met by partial minima and by joins that AQE can split. Self links count for nothing.
    """
    own = Scratch(edges.sparkSession)
    edges = own.stored(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "edges")
    settled, hub = _state(edges)
    while not settled:
        before, own = own, Scratch(edges.sparkSession)
        edges = own.stored(_small(_large(edges, hub), hub), "edges")
        before.clear()
        settled, hub = _state(edges)
    keep.paths += own.paths
    roots = edges.select(F.col("b").alias("id"), F.col("b").alias("component")).distinct()
    return edges.select(F.col("a").alias("id"), F.col("b").alias("component")).unionByName(roots)


def local_roots(n: int, left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """For nodes 0..n-1 and links between them, the smallest node each one reaches."""
    label = np.arange(n)
    while True:
        low = np.minimum(label[left], label[right])
        new = label.copy()
        np.minimum.at(new, left, low)
        np.minimum.at(new, right, low)
        new = new[new]
        if (new == label).all():
            return label
        label = new
