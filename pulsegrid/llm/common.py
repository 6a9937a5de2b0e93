"""Shared small helpers of the corpus operators."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

#: Rows of one Arrow batch are cut to slices of this many, so that a task holds few texts at a time.
SLICE_ROWS = 512


#: Rows that Spark hands to Python at a time, unless the session says otherwise; texts may be very long.
BATCH_ROWS, _BATCH_SETTING = "2000", "spark.sql.execution.arrow.maxRecordsPerBatch"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    if spark.conf.get(_BATCH_SETTING, "10000") == "10000":
        spark.conf.set(_BATCH_SETTING, BATCH_ROWS)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def utf8(column: str = "text") -> Column:
    """The whole text as UTF-8 bytes; null counts as empty."""
    return F.coalesce(F.col(column).cast("string"), F.lit("")).cast("binary")


def slices(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for at in range(0, batch.num_rows, SLICE_ROWS):
            yield batch.slice(at, SLICE_ROWS)


def training_rows(labels: DataFrame, label: str) -> DataFrame:
    """Labelled rows a model may learn from: ``crc32(doc_id as text) mod 5`` is not 0; one label per document."""
    known = labels.where(F.col("doc_id").isNotNull() & F.col(label).isNotNull() & ~held_out("doc_id"))
    return known.groupBy("doc_id").agg(F.max(label).cast("int").alias("label"))


def held_out(doc_id: str = "doc_id") -> Column:
    """Whether a document is kept from training (a null id counts as the empty text)."""
    return F.crc32(F.coalesce(F.col(doc_id).cast("string"), F.lit("")).cast("binary")) % 5 == 0
