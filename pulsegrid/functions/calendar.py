"""Calendar parts, bins and business-rule flags of an event time."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, functions as F

# Rank of each criticality level; any other text counts as 0.
CRITICALITY_RANK = {"low": 1, "medium": 2, "high": 3, "very high": 4}

# Right-closed presence bins in percent.
PRESENCE_BINS = [(0, 10), (10, 25), (25, 50), (50, 75), (75, 90), (90, 100)]


def week_start(ts: Column) -> Column:
    return F.date_trunc("week", ts).cast("timestamp_ntz")


def year_week_label(ts: Column) -> Column:
    """Year and Monday-based week of the year; days before the first Monday are week 0."""
    week = F.floor((F.dayofyear(ts) + 6 - F.weekday(ts)) / 7).cast("string")
    return F.concat(F.year(ts).cast("string"), F.lit("-"), F.lpad(week, 2, "0"))


def part_of_day(hour: Column) -> Column:
    return (
        F.when(hour <= 6, "Night").when(hour <= 12, "Morning")
        .when(hour <= 18, "Afternoon").otherwise("Evening")
    )


def presence_category(percent: Column) -> Column:
    out = None
    for lo, hi in PRESENCE_BINS:
        cond, label = (percent > lo) & (percent <= hi), f"{lo}-{hi}%"
        out = F.when(cond, label) if out is None else out.when(cond, label)
    return out


def calendar_columns(ts: Column) -> dict[str, Column]:
    day, dow, month = F.dayofmonth(ts), F.weekday(ts), F.month(ts)
    angle = month * (2 * math.pi) / 12
    flag = lambda c: c.cast("int")
    return {
        "Year": F.year(ts),
        "Month": month,
        "Quarter": F.quarter(ts),
        "Day_of_year": F.dayofyear(ts),
        "Week_of_year": F.weekofyear(ts),
        "Hour": F.hour(ts),
        "Is_weekend": flag(dow >= 5),
        "Month_sin": F.sin(angle),
        "Month_cos": F.cos(angle),
        "Is_month_start": flag(day <= 5),
        "Is_month_middle": flag((day > 5) & (day <= 25)),
        "Is_month_end": flag(day > 25),
        "Is_week_start": flag(dow == 0),
        "Is_week_end": flag(dow == 4),
        "Part_of_day": part_of_day(F.hour(ts)),
    }


def add_calendar(df: DataFrame, ts: str = "event_date_time") -> DataFrame:
    return df.withColumns(calendar_columns(F.col(ts)))


def business_hour_flag(hours: Column, hour: Column) -> Column:
    """1 when ``hour`` lies in ``"start-end"``, ends included; unreadable ends are -1."""
    ends = F.split(hours, "-")
    bound = lambda i: F.coalesce(F.get(ends, F.lit(i)).try_cast("double"), F.lit(-1.0))
    return ((bound(0) <= hour) & (hour <= bound(1))).cast("int")


def criticality_rank(level: Column) -> Column:
    ranks = F.create_map(*[F.lit(x) for kv in CRITICALITY_RANK.items() for x in kv])
    return F.coalesce(F.try_element_at(ranks, level), F.lit(0))


def add_interactions(df: DataFrame) -> DataFrame:
    """Products of the hour with weekend flag and criticality; needs calendar columns."""
    rank = criticality_rank(F.col("site_criticality"))
    return df.withColumns(
        {
            "Is_business_hour": business_hour_flag(F.col("site_business_hours"), F.col("Hour")),
            "Weekend_hour": F.col("Is_weekend") * F.col("Hour"),
            "criticality_numeric": rank,
            "Criticality_hour": rank * F.col("Hour"),
        }
    )
