"""Distributed union-find over an edge list.

Every task first unites its own edges in memory, which leaves a forest of at
most one edge per node. The forests are then merged by alternating large-star
and small-star steps (Kiveris et al., "Connected Components in MapReduce and
Beyond", 2014): each step is one shuffle of the remaining edges, and their
number of rounds grows with the logarithm of the longest path, so no task ever
holds a component.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .shared import cut, discard, release


class UnionFind:
    """Union by smallest label, with path halving."""

    def __init__(self):
        self.parent: dict = {}

    def find(self, x):
        parent = self.parent
        while (p := parent.get(x, x)) != x:
            parent[x] = g = parent.get(p, p)
            x = g
        return x

    def union(self, a, b) -> bool:
        a, b = self.find(a), self.find(b)
        if a == b:
            return False
        if b < a:
            a, b = b, a
        self.parent[b] = a
        return True

    def nodes(self):
        return list(self.parent)


def _local_forest(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    found = UnionFind()
    for batch in batches:
        for a, b in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            found.union(a, b)
    nodes = found.nodes()
    if nodes:
        yield pa.RecordBatch.from_arrays([pa.array(nodes, pa.int64()), pa.array([found.find(x) for x in nodes], pa.int64())], names=["a", "b"])


def _round(edges: DataFrame) -> DataFrame:
    """A large-star and a small-star step over edges (a, b), b < a.

    The least node in reach of a node is the least of its smaller neighbours, or
    the node itself. So a large-star step moves the end b of an edge to the least
    smaller neighbour of b: a hub, which is small and has many larger neighbours,
    is aggregated and joined, never gathered. A node has few smaller neighbours,
    one from each task's forest at most, and a small-star step gathers those.
    """
    least = edges.groupBy(F.col("a").alias("u")).agg(F.min("b").alias("m"))
    large = edges.join(least, F.col("b") == F.col("u"), "left").select("a", F.coalesce("m", "b").alias("b"))
    hung = large.select("a", "b", F.min("b").over(Window.partitionBy("a")).alias("m"))
    return hung.select(F.explode(F.array(F.struct("a", F.col("m").alias("b")), F.struct(F.col("b").alias("a"), F.col("m").alias("b")))).alias("e")).select("e.*").where("a != b").distinct()


def components(edges: DataFrame) -> DataFrame:
    """(node, root) of every node with an edge, root being the smallest node of its component.

    `edges` has two bigint columns; order, repeats and self-loops don't matter,
    rows with a null are ignored, and an empty list gives an empty result.
    A root has a row of its own.
    """
    a, b = edges.columns
    forest = edges.select(F.col(a).alias("a"), F.col(b).alias("b")).where("a is not null and b is not null and a != b")
    now = cut(forest.mapInArrow(_local_forest, "a long, b long").distinct())
    before = None
    while True:
        last, now = now, cut(_round(now))
        discard(last)
        state = now.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if state == before:
            release(edges.sparkSession)
            break
        before = state
    return now.select(F.col("a").alias("node"), F.col("b").alias("root")).union(now.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct())


def star_edges(buckets: DataFrame, key: str, node: str) -> DataFrame:
    """Distinct (a, b): each node of a bucket and the bucket's smallest node. Linear in the bucket's size.

    The smallest node is aggregated before the shuffle, so that a bucket of very
    many nodes is collected nowhere; only buckets of several nodes are joined.
    """
    several = buckets.groupBy(F.col(key).alias("k")).agg(F.min(node).alias("lo"), F.max(node).alias("hi")).where("lo != hi").select("k", "lo")
    return buckets.select(F.col(key).alias("k"), F.col(node).alias("a")).join(several, "k").where("a != lo").select("a", F.col("lo").alias("b")).distinct()


def members(starred: DataFrame) -> DataFrame:
    """(k, n) of the buckets given as (k, a, b), each other node a and the smallest node b."""
    return starred.select("k", F.col("a").alias("n")).union(starred.select("k", F.col("b").alias("n"))).distinct()


def open_pairs(buckets: DataFrame, key: str, node: str, roots: DataFrame, tried: DataFrame) -> DataFrame:
    """Pairs of one bucket that lie in different components so far and have not been tried.

    With the star pairs these are all pairs of a bucket whose outcome could
    still change a component: pairs within one component need no check.
    """
    labelled = buckets.join(roots, buckets[node] == roots["node"], "left").select(F.col(key).alias("k"), F.col(node).alias("n"), F.coalesce("root", node).alias("r"))
    mixed = labelled.groupBy("k").agg(F.min("r").alias("lo"), F.max("r").alias("hi")).where("lo != hi").select("k")
    few = labelled.join(mixed, "k")
    x, y = few.alias("x"), few.alias("y")
    pairs = x.join(y, (F.col("x.k") == F.col("y.k")) & (F.col("x.n") > F.col("y.n")) & (F.col("x.r") != F.col("y.r"))).select(F.col("x.n").alias("a"), F.col("y.n").alias("b")).distinct()
    return pairs.join(tried, ["a", "b"], "left_anti")
