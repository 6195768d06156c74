"""Connected components of an edge table, by alternating large-star and small-star rounds."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import forget, split_join, written


def _state(edges: DataFrame):
    return edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()


def _least(edges: DataFrame) -> DataFrame:
    """Of each node a: its number of edges and its least neighbour. Partial sums come before the shuffle."""
    return written(edges.groupBy("a").agg(F.count("*").alias("c"), F.min("b").alias("m")))


def connected_components(edges: DataFrame) -> DataFrame:
    """edges (a, b) long -> (node, component): the least id that links reach, for each id in an edge.

    Each round is two aggregations and two joins on the node. A node with more
    than one part in HOT of the edges is a hub: its rows meet their least
    neighbour by a broadcast of the fewer than HOT hubs and aren't shuffled to
    one task. The edge count never grows, and rounds grow with the logarithm of
    a component's size. Self links and null ends are ignored.
    """
    now = edges.where("a is not null and b is not null and a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
    now = written(now)
    state = _state(now)
    while True:
        both = now.union(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        near = _least(both)
        met = split_join(both, near, ["a"], "c", 2 * state[0])
        large = written(met.where("b > a").select(F.col("b").alias("a"), F.least("a", "m").alias("b")).distinct())
        least = _least(large)
        met = split_join(large, least, ["a"], "c", state[0])
        small = met.select(F.col("b").alias("a"), F.col("m").alias("b")).union(least.select("a", F.col("m").alias("b")))
        last, now = now, written(small.where("a <> b").distinct())
        forget(last, near, large, least)
        after = _state(now)
        if after == state:
            break
        state = after
    roots = now.select(F.col("b").alias("node")).distinct()
    return now.groupBy("a").agg(F.min("b").alias("component")).select(F.col("a").alias("node"), "component").union(roots.select("node", F.col("node").alias("component")))
