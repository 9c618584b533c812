"""Connected components of a link table, by rounds of neighbour contraction.

Every round is a pair of joins and grouped minima on the link table (large-star, then small-star):
each node hands its neighbours the smallest node it knows. Links are kept in a reliable checkpoint
between rounds, so lost executors cost one round at most and the plan does not grow.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from minpair.session import materialise


def _star(links: DataFrame, large: bool) -> DataFrame:
    """One contraction. Large: every larger neighbour gets the smallest node of the neighbourhood.
    Small: every smaller neighbour, and the node itself, does."""
    both = links.select(F.col("a").alias("u"), F.col("b").alias("v"))
    if large:
        both = both.unionByName(links.select(F.col("b").alias("u"), F.col("a").alias("v")))
    else:
        both = links.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v"))
    low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    moved = both.join(low, "u")
    out = (moved.where(F.col("v") > F.col("u")) if large else moved).select(
        F.col("v").alias("a"), F.col("m").alias("b"))
    if not large:
        out = out.unionByName(low.select(F.col("u").alias("a"), F.col("m").alias("b")))
    return out.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()


def components(links: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """``(node, root)`` of every node that has a link to another node; ``root`` is the smallest
    node of the component. An empty link table gives an empty result; loops and repeated links
    change nothing; links with a null end are no links."""
    links = materialise(links.select(F.col(a).alias("a"), F.col(b).alias("b")).where("a <> b")
                        .select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    seen = None
    while True:
        links = materialise(_star(_star(links, large=True), large=False))
        # Done when every node hangs directly on a root: no end is both a child and a parent,
        # and no child has two parents. The fingerprint of the links tells that nothing moved.
        state = links.agg(F.count("*").alias("n"), F.bit_xor(F.xxhash64("a", "b")).alias("s")).first()
        if state["n"] == 0 or (state["n"], state["s"]) == seen:
            return links.select(F.col("a").alias("node"), F.col("b").alias("root")).unionByName(
                links.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct())
        seen = (state["n"], state["s"])
