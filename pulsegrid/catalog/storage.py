"""Queries through written layouts: feeds, monthly extracts, bucketed tables and saved models."""

from __future__ import annotations

import uuid

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.regression import LinearRegression
from pyspark.sql import DataFrame, functions as F

from pulsegrid.catalog.duck import sql
from pulsegrid.catalog.extract import DIMS, MONTH_YEARS, ORACLES as EXTRACT_SQL
from pulsegrid.catalog.features import ORACLES as FEATURE_SQL
from pulsegrid.catalog.sources import _shared_folder
from pulsegrid.catalog.util import rounded
from pulsegrid.operators import features as X, lags as L, rollup as R, split as S
from pulsegrid.schema import HOURLY, POLLER
from pulsegrid.sources import readers, views as V, writers as W
from pulsegrid.streaming import hourly as H

FEED_PARTS, BUCKETS = 3, 8


def _hourly_stream(s, d) -> DataFrame:
    """Hourly maxima of January from a feed that arrives in three parts, the stream taking up each; open hours from the files."""
    folder, out, state = (_shared_folder(s) for _ in range(3))
    ts = F.col("event_date_time")
    rows = V.poller(s, d)
    rows = rows.select(*[F.col(f.name) if f.name in rows.columns else F.lit(None).cast(f.dataType).alias(f.name) for f in POLLER.fields])
    lo, hi = rows.agg(F.min(ts), F.max(ts)).first()

    def january(df):
        return R.select_readings(df, "in_bandwidth_pct", "IP Router", "TENANT_A", 2024, 1)

    for part in range(FEED_PARTS):
        ends = [F.lit((lo + (hi - lo) * at / FEED_PARTS).isoformat(" ")).cast("timestamp_ntz") for at in (part, part + 1)]
        within = (ts >= ends[0]) & ((ts < ends[1]) | F.lit(part == FEED_PARTS - 1))
        rows.where(within).write.mode("append").parquet(folder)
        windows = H.hourly_windows(january(H.feed(s, folder, files_per_batch=10_000)), DIMS)
        H.run_new_files(windows, out, state)
    closed = H.closed_hours(s, windows, out)
    done = H.hours_so_far(closed, january(readers.read_poller(s, folder)), DIMS)
    return done.select("ci_name", *DIMS, F.dayofmonth(ts).alias("event_day"), F.hour(ts).alias("event_hour"), "max_event_value")


def _monthly(s, d) -> DataFrame:
    """Seven monthly CSV extracts, and one of an earlier run that is not read, back as one table."""
    path, ts = _shared_folder(s), F.col("event_date_time")
    daily = V.supplier_daily(s, d).select(
        "*", F.dayofmonth(ts).alias("event_day"), F.hour(ts).alias("event_hour"), F.col("event_value").alias("max_event_value"))
    have = [F.col(f.name).cast(f.dataType).alias(f.name) if f.name in daily.columns else F.lit(None).cast(f.dataType).alias(f.name) for f in HOURLY.fields]
    for month in MONTH_YEARS:
        W.write_result(daily.where(F.date_format(ts, "MMMM") == month).select(*have), f"{path}/data_{month.lower()}", "csv")
    W.write_result(daily.select(*have), f"{path}/data_complete_set", "csv")
    out = R.build_event_time(readers.read_monthly(s, f"{path}/data_*"), MONTH_YEARS)
    return out.select("ci_name", "ci_type", "event_value", "event_month", "event_day", "event_hour", "event_date_time",
                      F.col("event_date").cast("string").alias("event_date"))


def _bucketed(s, d) -> DataFrame:
    """Features of an hourly table that is cut by item once."""
    name = f"hourly_{uuid.uuid4().hex}"
    W.write_bucketed(R.hourly_grain(V.poller(s, d).where(F.col("event_type") == "in_bandwidth_pct")), name, BUCKETS)
    return rounded(X.basic(X.base(s.table(name))))


def _saved_model(s, d) -> DataFrame:
    """Mean predictions of a regression that is saved and read back."""
    path = _shared_folder(s)
    rows = V.table(s, d, "lineitem").select(
        "l_returnflag", F.col("l_quantity").cast("double").alias("x"), F.col("l_extendedprice").cast("double").alias("y"))
    model = Pipeline(stages=[VectorAssembler(inputCols=["x"], outputCol="features"), LinearRegression(labelCol="y", solver="normal")]).fit(rows)
    W.save_model(model, path)
    return PipelineModel.load(path).transform(rows).groupBy("l_returnflag").agg(
        F.round(F.avg("prediction"), 3).alias("mean_prediction"), F.count("*").alias("n_rows"))


def _static_joined(s, d) -> DataFrame:
    """Weekly readings with one row of static features of their item, where it has any."""
    static = V.supplier_daily(s, d).groupBy("ci_name").agg(F.first("ci_type").alias("ci_type"), F.count("*").alias("n_days"))
    return L.with_static(V.supplier_weekly(s, d), static)


def _tuning_sample(s, d) -> DataFrame:
    return S.hash_sample(V.supplier_weekly(s, d), 1_000, ["ci_name", "event_date_time"])


QUERIES = {
    "hourly_max_stream": _hourly_stream,
    "monthly_extracts": _monthly,
    "bucketed_features": _bucketed,
    "saved_model": _saved_model,
    "static_joined": _static_joined,
    "tuning_sample": _tuning_sample,
}

ORACLES = {
    "hourly_max_stream": EXTRACT_SQL["hourly_max"],
    "monthly_extracts": EXTRACT_SQL["event_timestamp_build"],
    "bucketed_features": FEATURE_SQL["fe_basic"],
    "saved_model": """WITH m AS (SELECT regr_slope(CAST(l_extendedprice AS DOUBLE), CAST(l_quantity AS DOUBLE)) AS a,
  regr_intercept(CAST(l_extendedprice AS DOUBLE), CAST(l_quantity AS DOUBLE)) AS b FROM lineitem)
SELECT l_returnflag, round(avg(a * CAST(l_quantity AS DOUBLE) + b), 3) AS mean_prediction, count(*) AS n_rows FROM lineitem, m GROUP BY 1""",
    "static_joined": sql("supplier_daily supplier_weekly", """SELECT w.*, t.ci_type, t.n_days FROM supplier_weekly w LEFT JOIN (
  SELECT ci_name, min(ci_type) AS ci_type, count(*) AS n_days FROM supplier_daily GROUP BY 1) t USING (ci_name)"""),
}
