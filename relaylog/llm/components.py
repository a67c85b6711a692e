"""Connected components of links by alternating stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from relaylog.session import materialise


def _lowest(edges: DataFrame) -> DataFrame:
    """For every ``u`` the smallest of itself and its ``v``; a partial minimum runs before the shuffle."""
    return edges.groupBy("u").agg(F.min("v").alias("v")).select("u", F.least("u", "v").alias("m"))


def components(links: DataFrame, left: str = "a", right: str = "b") -> DataFrame:
    """``node, root``: the smallest node of its component, for every node that has a link.

    Large stars hang all larger neighbours of a node on the smallest one, small stars all smaller ones, until
    every node hangs on its root. No node's links are gathered anywhere: each step is a minimum per node and a
    join. The number of rounds grows with the logarithm of the longest path. Repeated links count once, links with a
    null end or of a node with itself not at all; without links there are no rows.
    """
    edges = links.filter(F.col(left) != F.col(right)).select(
        F.greatest(left, right).alias("u"), F.least(left, right).alias("v")
    )
    mark = None
    while True:
        both = edges.select(F.explode(F.array(F.struct("u", "v"), F.struct(F.col("v").alias("u"), F.col("u").alias("v")))).alias("e"))
        both = both.select("e.u", "e.v")
        large = both.join(_lowest(both), "u").filter((F.col("v") > F.col("u")) & (F.col("v") != F.col("m")))
        large = large.select(F.col("v").alias("u"), F.col("m").alias("v"))
        small = large.join(_lowest(large), "u")
        hung = F.array(F.struct(F.col("v").alias("u"), F.col("m").alias("v")), F.struct("u", F.col("m").alias("v")))
        small = small.select(F.explode(hung).alias("e")).select("e.u", "e.v").filter("u != v").distinct()
        edges = materialise(small, "links")
        now = edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(20,0)"))).first()
        if now == mark:
            break
        mark = now
    rooted = edges.select(F.col("u").alias("node"), F.col("v").alias("root"))
    return rooted.unionByName(edges.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())
