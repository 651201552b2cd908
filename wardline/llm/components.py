"""Connected components of a link table, by alternating large-star and small-star passes."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from wardline.llm.common import cut_lineage


def components(links: DataFrame) -> DataFrame:
    """(node, component) of all nodes in links (a, b): the smallest node reachable, the node itself included.

    Each pass groups by node with an aggregate that Spark combines map-side, then joins the minimum back, so a
    node with very many neighbours is never gathered into one task. The number of passes grows with the
    logarithm of the longest chain. Every pass is written to the shared folder.
    """
    edges = cut_lineage(
        links.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).filter(F.col("a") != F.col("b")).distinct()
    )
    before = None
    while True:
        # Large star: every larger neighbour of a node points to the smallest one around the node.
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        edges = both.filter(F.col("b") > F.col("a")).join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        edges = cut_lineage(edges.distinct())
        # Small star: the smaller neighbours of a node point to the smallest of them, and so does the node.
        least = edges.groupBy("a").agg(F.min("b").alias("m"))
        moved = edges.join(least, "a")
        edges = moved.select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(moved.select("a", F.col("m").alias("b")))
        edges = cut_lineage(edges.filter(F.col("a") != F.col("b")).distinct())
        now = tuple(edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())
        if now == before:
            break
        before = now
    heads = edges.select(F.col("b").alias("node"), F.col("b").alias("component"))
    return edges.select(F.col("a").alias("node"), F.col("b").alias("component")).unionByName(heads.distinct())
