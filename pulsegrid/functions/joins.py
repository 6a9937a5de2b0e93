"""Joins of long reading tables with per-key lookup tables."""

from __future__ import annotations

from pyspark.sql import DataFrame


def spread_work(df: DataFrame, *keys: str) -> DataFrame:
    """Partition by key for compute-heavy group kernels.

    A fixed count keeps adaptive execution from merging small but slow groups into one task.
    """
    spark = df.sparkSession
    tasks = max(int(spark.conf.get("spark.sql.shuffle.partitions")), 2 * spark.sparkContext.defaultParallelism)
    return df.repartition(tasks, *keys)


def lookup_join(rows: DataFrame, lookup: DataFrame, key: str, how: str = "left") -> DataFrame:
    """Join readings with a table of few rows per ``key``.

    Only the key is added to the columns the caller uses. Adaptive execution broadcasts the lookup where its
    measured size allows, and else splits the partitions of a key that holds a large share of the readings.
    """
    return rows.join(lookup, key, how)
