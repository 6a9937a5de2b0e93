"""Row-frame features for forecasting: lags, rolling statistics, deviations, trends."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, WindowSpec, functions as F

from pulsegrid.functions.calendar import add_calendar, add_interactions
from pulsegrid.functions.joins import lookup_join

LAGS = (1, 3, 12, 24)
LIGHT_WINDOWS = (6, 24)
FULL_WINDOWS = (3, 6, 12, 24)
WARMUP_ROWS = 24


def _order() -> WindowSpec:
    return Window.partitionBy("ci_name").orderBy("event_date_time")


def lag_columns(value: str = "event_value") -> dict[str, Column]:
    out = {f"Lag_{k}": F.lag(value, k).over(_order()) for k in LAGS}
    out["Diff_1"] = F.col(value) - F.lag(value, 1).over(_order())
    return out


def rolling_columns(windows=LIGHT_WINDOWS, leak_free: bool = False, value: str = "event_value") -> dict[str, Column]:
    """Rolling mean and sample deviation, at least two values.

    The plain frame ends at the current row; the leak-free one ends a row earlier.
    """
    out: dict[str, Column] = {}
    for k in windows:
        frame = _order().rowsBetween(-k, -1) if leak_free else _order().rowsBetween(1 - k, 0)
        enough = F.count(value).over(frame) >= 2
        out[f"Rolling_mean_{k}"] = F.when(enough, F.avg(value).over(frame))
        out[f"Rolling_std_{k}"] = F.when(enough, F.stddev_samp(value).over(frame))
    return out


def deviation_columns(base: int = 24, value: str = "event_value") -> dict[str, Column]:
    dev = F.col(value) - F.col(f"Rolling_mean_{base}")
    return {"Deviation_from_mean": dev, "Z_score": dev / (F.col(f"Rolling_std_{base}") + 1e-6)}


def trend_columns() -> dict[str, Column]:
    a, b = F.col("Rolling_mean_6"), F.col("Rolling_mean_24")
    return {
        "Trend_up": F.coalesce((a > b).cast("int"), F.lit(0)),
        "Trend_down": F.coalesce((a < b).cast("int"), F.lit(0)),
    }


def drop_warmup(df: DataFrame, rows: int = WARMUP_ROWS) -> DataFrame:
    """Drop the first rows of every item, whose lags reach before its start."""
    return df.withColumn("_rn", F.row_number().over(_order())).filter(F.col("_rn") > rows).drop("_rn")


def forecast_features(df: DataFrame, leak_free: bool = True, windows=LIGHT_WINDOWS) -> DataFrame:
    """Calendar, lag, rolling and interaction columns; one shuffle and one sort by item and time.

    ``leak_free`` keeps the current value out of every feature: frames end a row
    earlier, and ``Diff_1``, deviation and z-score describe the previous row.
    """
    out = add_calendar(df)
    if leak_free:
        cols = lag_columns()
        cols["Diff_1"] = F.lag("event_value", 1).over(_order()) - F.lag("event_value", 2).over(_order())
        out = out.withColumns(cols).withColumns(rolling_columns(windows, leak_free=True))
        dev = F.col("Lag_1") - F.col("Rolling_mean_24")
        out = out.withColumns({"Deviation_from_mean": dev, "Z_score": dev / (F.col("Rolling_std_24") + 1e-6)})
    else:
        out = out.withColumns(lag_columns()).withColumns(rolling_columns(windows)).withColumns(deviation_columns())
    out = out.withColumns(trend_columns())
    if {"site_criticality", "site_business_hours"} <= set(df.columns):
        out = add_interactions(out)
    return out


def with_static(df: DataFrame, static: DataFrame) -> DataFrame:
    """Attach one row of static features per item."""
    return lookup_join(df, static, "ci_name", "left")
