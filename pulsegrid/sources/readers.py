"""Readers for the poller table, monthly extracts and cluster assignments."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from pulsegrid.schema import ASSIGNMENTS, HOURLY, POLLER, normalise_columns


def read_poller(spark: SparkSession, source: str) -> DataFrame:
    """The metric table, by catalog name or Parquet path; absent columns are null.

    Columns are picked here, so Parquet reads only those a query uses.
    """
    df = spark.read.parquet(source) if "/" in source else spark.table(source)
    return df.select(
        *[
            F.col(f.name).cast(f.dataType) if f.name in df.columns
            else F.lit(None).cast(f.dataType).alias(f.name)
            for f in POLLER.fields
        ]
    )


def read_monthly(spark: SparkSession, path_glob: str, fmt: str = "csv",
                 schema: T.StructType | None = None) -> DataFrame:
    """Union of the monthly extracts; the month is the name after ``data_``, of the file or of the folder it is a part of.

    One multi-path scan instead of one read per month. Files named
    ``data_complete*`` are results of an earlier run and never read back.
    """
    reader = spark.read.schema(schema or HOURLY)
    if fmt == "csv":
        reader = reader.option("header", "true").option("enforceSchema", "false")
    df = reader.format(fmt).load(path_glob)
    path = F.split("_metadata.file_path", "/")
    file, folder = (F.regexp_extract(F.element_at(path, at), r"data_([A-Za-z]+)", 1) for at in (-1, -2))
    tagged = df.select("*", F.initcap(F.when(file != "", file).otherwise(folder)).alias("event_month")).filter(
        F.col("event_month") != "Complete")
    return normalise_columns(tagged, required=["ci_name", "event_value"])


def read_assignments(spark: SparkSession, path: str, fmt: str = "parquet") -> DataFrame:
    """Cluster labels under any accepted spelling of the two columns."""
    reader = spark.read.format(fmt)
    if fmt == "csv":
        reader = reader.option("header", "true")
    df = normalise_columns(reader.load(path), required=ASSIGNMENTS.names)
    return df.select(F.col("ci_name").cast("string"), F.col("cluster").cast("int"))
