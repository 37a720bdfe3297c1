"""Connected components of an edge table by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plumbline.llm._common import join_unique, materialize


def _with_least(pairs: DataFrame, total: int) -> DataFrame:
    """(u, v, m): m is the least of u and its neighbours. A hash aggregation and a join, no per-key lists; a node with
    very many links, the root of a large component, is joined by broadcast, so its pairs stay where they are."""
    least = pairs.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("links")).select("u", F.least("u", "m").alias("m"), "links")
    return join_unique(pairs, least, "u", "links", total).select("u", "v", "m")


def components(edges: DataFrame) -> DataFrame:
    """(node, root) for each node of `edges` (columns u, v of one orderable type); root is the component's least node.

    Each round halves paths to the root, so the rounds grow with the logarithm of the longest path. Both steps of a
    round are written to the shared folder; only a count and a checksum reach the driver. Nulls and self-loops are ignored;
    an empty table gives an empty table.
    """
    now = materialize(edges.where("u != v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct())
    total, mark = now.count(), None
    while True:
        both = now.union(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        large = _with_least(both, 2 * total).where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        down = materialize(large.where("u != v").distinct())
        small = _with_least(down, 2 * total).where("v != m").select("v", "m")
        now = materialize(small.union(down.groupBy("u").agg(F.min("v"))).toDF("u", "v").distinct())
        new = now.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if tuple(new) == mark:
            break
        total, mark = new[0], tuple(new)
    roots = now.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct()
    return now.select(F.col("u").alias("node"), F.col("v").alias("root")).union(roots)
