"""Connected components of links, by alternating large-star and small-star steps on DataFrames.

Each round is written to the shared folder, so lineage stays short and a lost executor
costs no more than a round. Only two numbers a round reach the driver. The least neighbours are
written too before they are joined to the links: both sides of the join are then plain reads, and where a node has
very many links, its side can be split.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common


def labels(links: DataFrame, name: str = "components") -> DataFrame:
    """node, root for every node of links(a, b) of longs: the least node of its component. Nodes without links do not appear."""

    def tidy(edges: DataFrame) -> DataFrame:
        return edges.filter("a != b").distinct()

    def state(edges: DataFrame) -> tuple:
        return tuple(edges.agg(F.count("*"), F.bit_xor(F.xxhash64("a", "b"))).first())

    edges = common.written(tidy(links.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))), name)
    before = state(edges)
    while True:
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = common.written(both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m")), name)
        large = both.filter("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        large = common.written(large.distinct(), name)
        least = common.written(large.groupBy("a").agg(F.min("b").alias("m")), name)
        small = large.join(least, "a").select("b", "m").filter("b != m").withColumnRenamed("b", "a").unionByName(least)
        edges = common.written(tidy(small.select(F.col("a"), F.col("m").alias("b"))), name)
        after = state(edges)
        if after == before:
            break
        before = after
    roots = edges.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct()
    return edges.select(F.col("a").alias("node"), F.col("b").alias("root")).unionByName(roots)
