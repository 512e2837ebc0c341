"""Connected components of a link table, with alternating star operations on materialised tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, materialize


def _nearest(pairs: DataFrame) -> DataFrame:
    """The smallest neighbour ``m`` of each node, or the node itself. A table of its own, so that the join that follows
    reads two plain shuffles and a hot node's links can be split among tasks."""
    least = pairs.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    return materialize(least, "cc-min")


def components(links: DataFrame) -> DataFrame:
    """``id, component`` for every node of ``links(a, b)``: the smallest node that it is connected with.

    Each round halves the height of the trees at least; links only ever shrink towards stars whose centre is the
    smallest node. Nothing is collected but two sums a round.
    """
    edges = links.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u <> v").distinct()
    edges = materialize(edges, "cc-links")
    before = None
    while True:
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = _nearest(both)
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = materialize(large.where("u <> v").distinct(), "cc-large")
        near = _nearest(large)
        small = large.join(near, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        after = materialize(small.unionByName(near.select("u", F.col("m").alias("v"))).where("u <> v").distinct(), "cc-small")
        discard(edges, least, large, near)
        edges = after
        now = edges.agg(F.count("*").alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("h")).first()
        if before == now:
            break
        before = now
    member = edges.select(F.col("u").alias("id"), F.col("v").alias("component"))
    return member.unionByName(edges.select(F.col("v").alias("id"), F.col("v").alias("component")).distinct())
