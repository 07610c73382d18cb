"""Connected components of links, by alternating large-star and small-star steps.

Each step is an aggregate and a join; what it gives is cut from its plan by checkpoint(df), so a lost executor costs no more than a round. A hub is never gathered:
its least neighbour is an aggregate that tasks begin before the shuffle, and the join with it is one that Spark can split.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def components(links: DataFrame, checkpoint) -> DataFrame:
    """node, root for every node of links (a, b, of one type that has an order): the least node that it is connected with. Nodes without links to others do not appear."""

    def tidy(edges: DataFrame) -> DataFrame:
        return checkpoint(edges.filter("a > b").distinct())

    def state(edges: DataFrame) -> tuple:
        return tuple(edges.agg(F.count("*"), F.bit_xor(F.xxhash64("a", "b"))).first())

    edges = tidy(links.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")))
    before = state(edges)
    while before[0]:
        # large star: neighbours above a node go to the least node around it
        ways = F.array(F.struct(F.col("a").alias("a"), F.col("b").alias("b")), F.struct(F.col("b").alias("a"), F.col("a").alias("b")))
        both = edges.select(F.explode(ways).alias("w")).select("w.a", "w.b")
        least = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
        large = tidy(both.filter("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")))
        # small star: the nodes below a node go to the least of them
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(least.select("a", F.col("m").alias("b")))
        edges = tidy(small)
        after = state(edges)
        if after == before:
            break
        before = after
    return edges.select(F.col("a").alias("node"), F.col("b").alias("root")).unionByName(edges.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct())
