"""From the metric table or monthly extracts to complete series."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from pulsegrid.operators import quality as Q, rollup as R
from pulsegrid.schema import DIMENSIONS
from pulsegrid.sources import readers, writers


def monthly_extract(spark: SparkSession, source: str, year: int, month: int, customer: str, out: str | None = None,
                    event_type: str = "in_bandwidth_pct", device_type: str = "IP Router") -> DataFrame:
    """Hourly maxima of one month, ordered by item, day and hour when written."""
    picked = R.select_readings(readers.read_poller(spark, source), event_type, device_type, customer, year, month)
    hourly = R.hourly_max(picked, DIMENSIONS)
    if out:
        writers.write_result(hourly.repartitionByRange("ci_name", "event_day").sortWithinPartitions("ci_name", "event_day", "event_hour"), out)
    return hourly


def complete_series(spark: SparkSession, path_glob: str, at_risk: DataFrame, out: str, fmt: str = "csv",
                    months: dict[str, int] | None = None) -> DataFrame:
    """Union the months, keep at-risk items seen in every listed month, build times, write once per type."""
    years = R.STUDY_MONTH_YEARS if months is None else months
    listed = readers.read_monthly(spark, path_glob, fmt).filter(F.col("event_month").isin(*years))
    kept = R.complete_items(R.keep_listed(listed, at_risk), ["event_month"], len(years))
    writers.write_complete(R.build_event_time(kept, years), out)
    return spark.read.parquet(out)


def quality_report(df: DataFrame, out: str) -> dict[str, str]:
    """Every audit table of a complete set, written under ``out``."""
    stats, presence = Q.date_stats(df), Q.device_presence(df)
    tables = {
        "nulls": Q.null_report(df), "date_stats": stats, "date_count_summary": Q.date_count_summary(stats),
        "global_period": Q.global_period(df), "coverage": Q.coverage_summary(stats), "weekly_presence": Q.weekly_presence(df),
        "device_presence": presence, "presence_bins": Q.presence_bins(presence), "top_present": Q.top_present(presence),
        "week_correlation": Q.week_correlation(df), "alignment": Q.alignment_verdict(df), "missing_per_item": Q.missing_per_item(df),
        "missing_by_time": Q.missing_by_ts(df), "gap_runs": Q.gap_runs(df), "value_histogram": Q.histogram(df, "event_value"),
    }
    for name, table in tables.items():
        writers.write_result(table, f"{out}/{name}")
    return {name: f"{out}/{name}" for name in tables}
