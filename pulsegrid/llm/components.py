"""Connected components of a link table, by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from pulsegrid.session import cut_lineage


def _nearest(edges: DataFrame) -> DataFrame:
    """Edges with the smallest neighbour of their first end; minima are combined before the shuffle."""
    low = edges.groupBy("a").agg(F.min("b").alias("low"))
    return edges.join(low.select("a", F.least("a", "low").alias("low")), "a")


def _round(edges: DataFrame) -> DataFrame:
    """``a > b`` throughout. Larger neighbours move to the smallest one known, then so do the smaller ones."""
    both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    large = _nearest(both).where("b > a").select(F.col("b").alias("a"), F.col("low").alias("b")).distinct()
    small = _nearest(large)
    return (
        small.select(F.col("b").alias("a"), F.col("low").alias("b"))
        .unionByName(small.select("a", F.col("low").alias("b")))
        .where("a <> b").distinct()
    )


def connected(links: DataFrame, left: str, right: str) -> DataFrame:
    """``(node, component)`` for every node with a link to another one; a component is named by its smallest node.

    Nothing is collected but one checksum a round. The rounds grow with the logarithm of the longest chain.
    Links with a null end and links of a node to itself are ignored; an empty table gives no rows.
    """
    a, b = F.col(left).cast("long"), F.col(right).cast("long")
    edges = cut_lineage(links.select(F.greatest(a, b).alias("a"), F.least(a, b).alias("b"), (a != b).alias("link"))
                        .where("link").select("a", "b").distinct())
    seen = None
    while True:
        now = edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b") % (1 << 31)), F.sum(F.xxhash64("b", "a") % (1 << 31))).first()
        if now == seen or not now[0]:
            break
        seen, edges = now, cut_lineage(_round(edges))
    return edges.select(F.col("a").alias("node"), F.col("b").alias("component")).unionByName(
        edges.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct())
