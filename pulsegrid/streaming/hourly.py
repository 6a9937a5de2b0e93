"""Hourly maxima of a feed of short-interval readings, kept up to date as files arrive.

Readings come from a folder of Parquet files. Each run takes the files that are
new, holds open hours in window state, and appends an hour to the result once
the watermark has passed it. Both the files read and the rows written are in the
checkpoint's logs, so a run that is repeated after a failure neither loses nor
doubles an hour. Maxima do not change where a reading arrives twice.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T

from pulsegrid.operators.rollup import clamp
from pulsegrid.schema import POLLER

#: How late a reading may come and still count.
LATENESS = "2 hours"
_EPOCH = "TIMESTAMP_NTZ'1970-01-01 00:00:00'"


def _seconds(col: str) -> Column:
    """Seconds of a wall-clock time since 1970, by its digits alone: no session time zone skips or repeats an hour."""
    return F.expr(f"CAST(CAST(`{col}` - {_EPOCH} AS INTERVAL SECOND) AS DECIMAL(20, 6))")


def _hour(seconds: Column) -> Column:
    """The wall-clock hour that holds a number of seconds."""
    return F.expr(_EPOCH) + F.make_dt_interval(F.lit(0), F.floor(seconds / 3600).cast("int"))


def feed(spark: SparkSession, folder: str, schema: T.StructType = POLLER, files_per_batch: int = 100) -> DataFrame:
    """The readings of ``folder`` as a stream, at most ``files_per_batch`` new files at a time."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).parquet(folder)


def hourly_windows(readings: DataFrame, dims: list[str], lateness: str = LATENESS) -> DataFrame:
    """``(ci_name, dims..., event_date_time, max_event_value)`` of each hour of a stream.

    State holds one row for each item and open hour. Readings without a time have no hour and are left out.
    """
    # a watermark needs an instant
    timed = readings.withColumn("_at", F.timestamp_micros((_seconds("event_date_time") * 1000000).cast("long"))).withWatermark("_at", lateness)
    hours = timed.groupBy("ci_name", *dims, F.window("_at", "1 hour")).agg(F.max(clamp(F.col("event_value"))).alias("max_event_value"))
    return hours.select("ci_name", *dims, _hour(F.unix_seconds("window.start")).alias("event_date_time"), "max_event_value")


def run_new_files(windows: DataFrame, out: str, checkpoint: str) -> None:
    """Take all files that have come since the last run of ``checkpoint``, then end."""
    query = (windows.writeStream.format("parquet").outputMode("append").option("path", out)
             .option("checkpointLocation", checkpoint).trigger(availableNow=True).start())
    query.awaitTermination()


def closed_hours(spark: SparkSession, windows: DataFrame, out: str) -> DataFrame:
    """The hours written so far; no rows before the first one."""
    return spark.read.schema(windows.schema).parquet(out)


def hours_so_far(closed: DataFrame, readings: DataFrame, dims: list[str]) -> DataFrame:
    """Closed hours and, from the readings at rest, those after the last closed one.

    The filter on time reaches the Parquet scan, so only the feed's last files are read again.
    """
    last = closed.agg(F.max("event_date_time")).first()[0]
    ts = F.col("event_date_time")
    tail = readings if last is None else readings.where(ts >= F.lit(str(last)).cast("timestamp_ntz") + F.expr("INTERVAL 1 HOUR"))
    hour = _hour(_seconds("event_date_time")).alias("event_date_time")
    still = tail.where(ts.isNotNull()).groupBy("ci_name", *dims, hour).agg(F.max(clamp(F.col("event_value"))).alias("max_event_value"))
    return closed.unionByName(still)
