"""Connected components by alternating star contraction."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from pulsegrid.functions.joins import lookup_join
from pulsegrid.session import cut_lineage


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """Point neighbours at the smallest node known around each node.

    Minima are partial aggregates, and adaptive execution splits the join back, so a
    node with very many neighbours does not fill a task.
    """
    if large:
        both = edges.unionByName(edges.select(F.col("dst").alias("src"), F.col("src").alias("dst")))
    else:
        both = edges.select(F.greatest("src", "dst").alias("src"), F.least("src", "dst").alias("dst"))
    low = both.groupBy("src").agg(F.min("dst").alias("low")).withColumn("low", F.least("src", "low"))
    joined = lookup_join(both, low, "src", "inner")
    if large:
        kept = joined.filter(F.col("dst") > F.col("src")).select(F.col("dst").alias("src"), F.col("low").alias("dst"))
    else:
        kept = joined.select(F.col("dst").alias("src"), F.col("low").alias("dst")).unionByName(
            low.select("src", F.col("low").alias("dst")))
    return kept.filter("src <> dst").distinct()


def components(edges: DataFrame) -> DataFrame:
    """``(node, component)`` for nodes with an edge; a component is named by its smallest node.

    Rounds go on until nothing changes; their number grows with the logarithm of the longest chain.
    """
    now = cut_lineage(edges.select(F.greatest("src", "dst").alias("src"), F.least("src", "dst").alias("dst"))
                      .filter("src <> dst").distinct())
    mark = None
    while True:
        state = now.agg(F.count("*").alias("n"), F.sum(F.pmod(F.xxhash64("src", "dst"), F.lit(1 << 40))).alias("h")).first()
        if mark == (state["n"], state["h"]):
            break
        mark = (state["n"], state["h"])
        now = cut_lineage(_star(_star(now, True), False))
    roots = now.select(F.col("dst").alias("node"), F.col("dst").alias("component")).distinct()
    return now.select(F.col("src").alias("node"), F.col("dst").alias("component")).unionByName(roots)
