"""Filters, clamp, hourly maxima, completeness and timestamp building."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame, functions as F

from pulsegrid.functions.joins import lookup_join
from pulsegrid.functions.stats import finite

SATURATION_CAP = 100.0

# Calendar year of each month of the study period.
STUDY_MONTH_YEARS = {
    "December": 2024, "January": 2025, "February": 2025, "March": 2025,
    "April": 2025, "May": 2025, "June": 2025,
}

# Number of each month name.
MONTH_NUMBERS = {
    "January": 1, "February": 2, "March": 3, "April": 4, "May": 5, "June": 6,
    "July": 7, "August": 8, "September": 9, "October": 10, "November": 11, "December": 12,
}


def clamp(value: Column, cap: float = SATURATION_CAP) -> Column:
    """Cap readings; NaN turns into null first because Spark ranks it above any cap."""
    v = finite(value)
    return F.when(value == float("inf"), F.lit(cap)).otherwise(F.when(v > cap, F.lit(cap)).otherwise(v))


def month_range(year: int, month: int) -> tuple[dt.datetime, dt.datetime]:
    start = dt.datetime(year, month, 1)
    return start, dt.datetime(year + month // 12, month % 12 + 1, 1)


def select_readings(df: DataFrame, event_type: str, device_type: str, customer: str,
                    year: int, month: int, business_hours: bool = False) -> DataFrame:
    """Equality and half-open range filters, which Parquet can use to skip data."""
    start, end = (F.lit(t.isoformat(" ")).cast("timestamp_ntz") for t in month_range(year, month))
    ts = F.col("event_date_time")
    out = df.filter(
        (F.col("event_type") == event_type)
        & (F.col("device_type_label") == device_type)
        & (F.col("customer_name") == customer)
        & (ts >= start) & (ts < end)
    )
    if business_hours:
        out = out.filter((F.hour(ts) >= 7) & (F.hour(ts) < 18))
    return out


def hourly_max(df: DataFrame, dims: list[str]) -> DataFrame:
    """Highest clamped reading per item, dimensions, day and hour of one month.

    A plain hash aggregate: partial maxima are formed before the shuffle, so an
    item that holds a large share of the readings sends one row per hour and task.
    """
    ts = F.col("event_date_time")
    return df.groupBy(
        "ci_name", *dims,
        F.dayofmonth(ts).alias("event_day"),
        F.hour(ts).alias("event_hour"),
    ).agg(F.max(clamp(F.col("event_value"))).alias("max_event_value"))


def hourly_grain(df: DataFrame) -> DataFrame:
    """One row per item and hour: bounds every later per-item group by the calendar."""
    return df.groupBy(
        "ci_name", F.date_trunc("hour", "event_date_time").cast("timestamp_ntz").alias("event_date_time")
    ).agg(F.max("event_value").alias("event_value"))


def keep_listed(df: DataFrame, items: DataFrame) -> DataFrame:
    """Keep the rows of listed items."""
    return lookup_join(df, items.select("ci_name").distinct(), "ci_name", "left_semi")


def keep_type(df: DataFrame, ci_type: str) -> DataFrame:
    return df.filter(F.col("ci_type") == ci_type)


def months_present(df: DataFrame, month_cols: list[str]) -> DataFrame:
    return df.groupBy("ci_name").agg(F.count_distinct(*month_cols).alias("months_present"))


def complete_items(df: DataFrame, month_cols: list[str], n_months: int) -> DataFrame:
    """Rows of the items seen in each of ``n_months`` months."""
    full = months_present(df, month_cols).filter(F.col("months_present") == n_months)
    return lookup_join(df, full.select("ci_name"), "ci_name", "left_semi")


def build_event_time(df: DataFrame, month_years: dict[str, int] | None = None) -> DataFrame:
    """``event_date`` and ``event_date_time`` from day, month name and hour.

    A month outside the map has no year, so both columns are null for it.
    """
    years = STUDY_MONTH_YEARS if month_years is None else month_years
    year_of = F.create_map(*[F.lit(x) for kv in years.items() for x in kv])
    number_of = F.create_map(*[F.lit(x) for kv in MONTH_NUMBERS.items() for x in kv])
    year = F.try_element_at(year_of, F.col("event_month"))
    month = F.try_element_at(number_of, F.col("event_month"))
    day, hour = F.col("event_day").cast("int"), F.col("event_hour").cast("int")
    stamp = F.make_timestamp_ntz(year, month, day, hour, F.lit(0), F.lit(0))
    return df.withColumns(
        {
            "event_day": day,
            "event_hour": hour,
            "event_date": F.make_date(year, month, day),
            "event_date_time": stamp,
        }
    )


def unknown_criticality(df: DataFrame) -> DataFrame:
    flag = F.coalesce((F.col("site_criticality") == "Unknown").cast("int"), F.lit(0))
    return df.withColumn("Criticality_unknown", flag)


def constant_columns(df: DataFrame, cols: list[str], count_null: bool = True) -> DataFrame:
    """One row per column: distinct values and whether the column is constant.

    Only "one value or more" is needed, so minimum and maximum replace a
    distinct count: one scan, no shuffle of values.
    """
    def spread(c: str) -> Column:
        lo, hi = F.min(c), F.max(c)
        has_null = F.bool_or(F.col(c).isNull())
        two_values = F.coalesce(lo != hi, F.lit(False))
        mixed = has_null & lo.isNotNull() if count_null else F.lit(False)
        return F.struct(F.lit(c).alias("column_name"), (~(two_values | mixed)).alias("is_constant"))

    return df.agg(F.array(*[spread(c) for c in cols]).alias("r")).selectExpr("inline(r)")
