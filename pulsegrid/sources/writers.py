"""Sinks for complete series and result tables."""

from __future__ import annotations

from pyspark.ml import PipelineModel
from pyspark.sql import DataFrame


def write_complete(df: DataFrame, path: str) -> None:
    """One pass over the data; each item type lands in its own partition."""
    df.write.mode("overwrite").partitionBy("ci_type").parquet(path)


def write_result(df: DataFrame, path: str, fmt: str = "parquet",
                 partition_by: list[str] | None = None) -> None:
    writer = df.write.mode("overwrite").format(fmt)
    if fmt == "csv":
        writer = writer.option("header", "true")
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    writer.save(path)


def save_model(model: PipelineModel, path: str) -> None:
    model.write().overwrite().save(path)


def write_bucketed(df: DataFrame, name: str, buckets: int, key: str = "ci_name", order: str = "event_date_time") -> None:
    """A warehouse table cut and sorted by ``key``: windows, groups and joins by it read it without a shuffle.

    Each task writes one bucket. All rows of a key share a bucket, so write rows whose number for a key is bounded, such as
    hourly ones; ``buckets`` should give files of some hundred megabytes.
    """
    df.repartition(buckets, key).write.mode("overwrite").bucketBy(buckets, key).sortBy(key, order).saveAsTable(name)
