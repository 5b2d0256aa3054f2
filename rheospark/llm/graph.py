"""Connected components of links, by alternating large-star and small-star steps on DataFrames."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, join_hot, written


#: Nodes of more links than this, and than one in 1000 of all, are salted.
HOT_ROWS = 1000


def _state(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())


def components(links: DataFrame) -> DataFrame:
    """links: u, v (any comparable type). Returns node, root for every node with a link to another one: root is the
    least node that can be reached. What each step holds is at most two rows for each link; nothing goes to the driver
    but counts and a sum. Rows of a node with very many links are salted where they meet its least one. Nulls link
    nothing; links of a node to itself and repeated links add nothing."""
    edges = written(links.where("u != v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "links")
    before = _state(edges)
    while before[0]:
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = written(both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"), F.count("*").alias("n")), "least")
        large = join_hot(both, least, ["u"], ["v"], least=HOT_ROWS).where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u != v").distinct()
        large = written(large, "large-star")
        lower = written(large.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("n")), "lower")
        small = join_hot(large, lower, ["u"], ["v"], least=HOT_ROWS).select(F.col("v").alias("u"), F.col("m").alias("v")).where("u != v")
        small = written(small.unionByName(lower.select("u", F.col("m").alias("v"))).distinct(), "small-star")
        discard(least)
        discard(lower)
        discard(large)
        discard(edges)
        edges, after = small, _state(small)
        if after == before:
            break
        before = after
    return edges.select(F.col("u").alias("node"), F.col("v").alias("root"))
