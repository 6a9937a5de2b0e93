"""Series preparation, calendar, lag, split and score queries with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from pulsegrid.catalog.duck import rounded as rnd, sql
from pulsegrid.catalog.util import rounded
from pulsegrid.functions import calendar as C
from pulsegrid.operators import lags as L, series as S, split as P
from pulsegrid.sources import views as V

_CAL = ("Year Month Quarter Day_of_year Week_of_year Hour Is_weekend Month_sin Month_cos Is_month_start "
        "Is_month_middle Is_month_end Is_week_start Is_week_end").split()


def _calendar(s, d):
    return rounded(C.add_calendar(V.poller(s, d)).select("ci_name", "event_date_time", "event_value", *_CAL))


def _interactions(s, d):
    df = C.add_interactions(C.add_calendar(V.poller(s, d)))
    return df.select("ci_name", "event_date_time", "event_value", "Weekend_hour", "criticality_numeric", "Criticality_hour")


def _lagged(s, d):
    df = V.type_hourly(s, d).withColumns(L.lag_columns())
    return rounded(df)


def _rolling(leak_free):
    return lambda s, d: rounded(V.type_hourly(s, d).withColumns(
        L.rolling_columns(L.FULL_WINDOWS, leak_free)).drop("event_value"))


def _zscore(s, d):
    df = V.type_hourly(s, d).withColumns(L.rolling_columns()).withColumns(L.deviation_columns())
    return rounded(df.withColumns(L.trend_columns()).select(
        "ci_name", "event_date_time", "Deviation_from_mean", "Z_score", "Trend_up", "Trend_down"))


def clustered(s, d):
    """Readings of all series with an item's type code as its given cluster."""
    df = V.poller(s, d)
    given = df.select("ci_name", (F.substring("ci_name", 4, 9).cast("int") % 4).alias("cluster")).distinct()
    return P.join_clusters(df, given)


def _hourly_clustered(s, d):
    return V.type_hourly(s, d).withColumn("cluster", (F.length("ci_name") % 2).cast("int"))


def naive_forecast(s, d):
    """Yesterday's value at the same row as the prediction."""
    df = V.type_hourly(s, d).withColumn("y_pred", L.lag_columns()["Lag_24"])
    return df.filter("y_pred IS NOT NULL")


QUERIES = {
    "length_fence": lambda s, d: S.length_fence(V.supplier_weekly(s, d)),
    "pad_truncate": lambda s, d: rounded(S.pad_truncate(V.supplier_weekly(s, d))),
    "global_minmax": lambda s, d: rounded(S.global_minmax(S.pad_truncate(V.supplier_weekly(s, d))).select(
        "ci_name", "pos", "scaled")),
    "series_vectors": lambda s, d: S.to_vectors(S.pad_truncate(V.supplier_weekly(s, d)), "event_value").select(
        "ci_name", F.size("series").alias("length"),
        F.round(F.aggregate("series", F.lit(0.0), lambda a, x: a + x), 6).alias("total"),
        F.round(F.col("series")[0], 6).alias("first_value")),
    "series_flags": lambda s, d: S.series_flags(V.supplier_weekly(s, d)),
    "calendar_features": _calendar,
    "part_of_day": lambda s, d: V.poller(s, d).groupBy(
        C.part_of_day(F.hour("event_date_time")).alias("part")).agg(F.count("*").alias("n")),
    "business_hour_flag": lambda s, d: V.poller(s, d).groupBy(
        "site_business_hours",
        F.coalesce(C.business_hour_flag(F.col("site_business_hours"), F.hour("event_date_time")), F.lit(0)).alias("flag"),
    ).agg(F.count("*").alias("n")),
    "criticality_interactions": _interactions,
    "lag_diff": _lagged,
    "rolling_stats": _rolling(False),
    "rolling_stats_leakfree": _rolling(True),
    "zscore_trend": _zscore,
    "drop_warmup": lambda s, d: L.drop_warmup(V.type_hourly(s, d)),
    "train_test_split_21d": lambda s, d: P.mark_test(_hourly_clustered(s, d)).groupBy("cluster", "is_test").agg(
        F.count("*").alias("n"), F.min("event_date_time").alias("from_ts"), F.max("event_date_time").alias("to_ts")),
    "time_folds": lambda s, d: P.fold_bounds(V.type_hourly(s, d)),
    "forecast_metrics": lambda s, d: rounded(P.forecast_metrics(naive_forecast(s, d), by=["ci_name"])),
    "cluster_join_summary": lambda s, d: P.cluster_summary(clustered(s, d)),
    "stratified_sample": lambda s, d: P.stratified_sample(clustered(s, d)),
    "downsample_step": lambda s, d: P.downsample(V.type_hourly(s, d)),
}

_FENCE = """len AS (SELECT ci_name, count(*) AS n FROM supplier_weekly GROUP BY 1),
q AS (SELECT quantile_cont(CAST(n AS DOUBLE), 0.25) AS q1, quantile_cont(CAST(n AS DOUBLE), 0.75) AS q3,
  CAST(floor(quantile_cont(CAST(n AS DOUBLE), 0.5)) AS INT) AS target FROM len),
fence AS (SELECT ci_name, n, target FROM len, q WHERE n >= q1 - 1.5 * (q3 - q1) AND n <= q3 + 1.5 * (q3 - q1))"""
_PAD = """ranked AS (SELECT w.ci_name, row_number() OVER (PARTITION BY w.ci_name ORDER BY event_date_time) AS pos,
  event_date_time, event_value, n, target, avg(event_value) OVER (PARTITION BY w.ci_name) AS mean_value
  FROM supplier_weekly w JOIN fence f ON f.ci_name = w.ci_name),
padded AS (SELECT ci_name, CAST(pos AS INT) AS pos, event_date_time, event_value FROM ranked WHERE pos <= target
  UNION ALL SELECT ci_name, CAST(unnest(generate_series(n + 1, target)) AS INT), NULL, mean_value FROM ranked WHERE pos = 1 AND n < target)"""


def _w(k: int, leak_free: bool) -> str:
    return f"ROWS BETWEEN {k} PRECEDING AND 1 PRECEDING" if leak_free else f"ROWS BETWEEN {k - 1} PRECEDING AND CURRENT ROW"


def _roll(leak_free: bool, windows=L.FULL_WINDOWS) -> str:
    parts = []
    for k in windows:
        o = f"OVER (PARTITION BY ci_name ORDER BY event_date_time {_w(k, leak_free)})"
        parts.append(f"CASE WHEN count(event_value) {o} >= 2 THEN avg(event_value) {o} END AS Rolling_mean_{k}")
        parts.append(f"CASE WHEN count(event_value) {o} >= 2 THEN stddev_samp(event_value) {o} END AS Rolling_std_{k}")
    return ", ".join(parts)


_T = "event_date_time"
_ROLL_NAMES = [f"Rolling_{s}_{k}" for k in L.FULL_WINDOWS for s in ("mean", "std")]
_I = lambda e: f"CAST({e} AS INT)"
_OV = "OVER (PARTITION BY ci_name ORDER BY event_date_time)"

ORACLES = {
    "length_fence": sql("supplier_weekly", "SELECT * FROM fence", [_FENCE]),
    "pad_truncate": sql("supplier_weekly", "SELECT ci_name, pos, event_date_time, round(event_value, 6) AS event_value FROM padded", [_FENCE, _PAD]),
    "global_minmax": sql("supplier_weekly", """SELECT ci_name, pos, round((event_value - lo) / (hi - lo), 6) AS scaled
  FROM padded, (SELECT min(event_value) AS lo, max(event_value) AS hi FROM padded)""", [_FENCE, _PAD]),
    "series_vectors": sql("supplier_weekly", """SELECT ci_name, CAST(count(*) AS INT) AS length, round(sum(event_value), 6) AS total,
  round(max(CASE WHEN pos = 1 THEN event_value END), 6) AS first_value FROM padded GROUP BY 1""", [_FENCE, _PAD]),
    "series_flags": sql("supplier_weekly", f"""SELECT ci_name, count(*) AS n,
  {_I("max(CASE WHEN event_value IS NULL OR isnan(event_value) THEN 1 ELSE 0 END)")} AS has_missing,
  {_I("max(CASE WHEN isinf(event_value) THEN 1 ELSE 0 END)")} AS has_infinite,
  {_I("CASE WHEN min(event_value) = max(event_value) THEN 1 ELSE 0 END")} AS is_constant,
  {_I("CASE WHEN count(*) < 10 THEN 1 ELSE 0 END")} AS is_short FROM supplier_weekly GROUP BY 1"""),
    "calendar_features": sql("poller", f"""SELECT ci_name, event_date_time, round(event_value, 6) AS event_value,
  {_I(f"year({_T})")} AS Year, {_I(f"month({_T})")} AS Month, {_I(f"quarter({_T})")} AS Quarter,
  {_I(f"dayofyear({_T})")} AS Day_of_year, {_I(f"weekofyear({_T})")} AS Week_of_year, {_I(f"hour({_T})")} AS Hour,
  {_I(f"isodow({_T}) >= 6")} AS Is_weekend, round(sin(2 * pi() * month({_T}) / 12), 6) AS Month_sin,
  round(cos(2 * pi() * month({_T}) / 12), 6) AS Month_cos, {_I(f"day({_T}) <= 5")} AS Is_month_start,
  {_I(f"day({_T}) BETWEEN 6 AND 25")} AS Is_month_middle, {_I(f"day({_T}) > 25")} AS Is_month_end,
  {_I(f"isodow({_T}) = 1")} AS Is_week_start, {_I(f"isodow({_T}) = 5")} AS Is_week_end FROM poller"""),
    "part_of_day": sql("poller", """SELECT CASE WHEN hour(event_date_time) <= 6 THEN 'Night' WHEN hour(event_date_time) <= 12 THEN 'Morning'
  WHEN hour(event_date_time) <= 18 THEN 'Afternoon' ELSE 'Evening' END AS part, count(*) AS n FROM poller GROUP BY 1"""),
    "business_hour_flag": sql("poller", """SELECT site_business_hours, CAST(coalesce(try_cast(split_part(site_business_hours, '-', 1) AS DOUBLE), -1) <= hour(event_date_time)
  AND hour(event_date_time) <= coalesce(try_cast(split_part(site_business_hours, '-', 2) AS DOUBLE), -1) AS INT) AS flag, count(*) AS n
  FROM poller GROUP BY 1, 2"""),
    "criticality_interactions": sql("poller", """SELECT ci_name, event_date_time, event_value,
  CAST(CASE WHEN isodow(event_date_time) >= 6 THEN hour(event_date_time) ELSE 0 END AS INT) AS Weekend_hour,
  CAST(c AS INT) AS criticality_numeric, CAST(c * hour(event_date_time) AS INT) AS Criticality_hour
  FROM (SELECT *, CASE site_criticality WHEN 'low' THEN 1 WHEN 'medium' THEN 2 WHEN 'high' THEN 3 WHEN 'very high' THEN 4 ELSE 0 END AS c FROM poller)"""),
    "lag_diff": sql("type_hourly", f"""SELECT ci_name, event_date_time, round(event_value, 6) AS event_value,
  {", ".join(f"round(lag(event_value, {k}) {_OV}, 6) AS Lag_{k}" for k in L.LAGS)},
  round(event_value - lag(event_value) {_OV}, 6) AS Diff_1 FROM type_hourly"""),
    "rolling_stats": sql("type_hourly", f"SELECT ci_name, event_date_time, {rnd(', '.join(_ROLL_NAMES))} FROM r",
                         [f"r AS (SELECT ci_name, event_date_time, {_roll(False)} FROM type_hourly)"]),
    "rolling_stats_leakfree": sql("type_hourly", f"SELECT ci_name, event_date_time, {rnd(', '.join(_ROLL_NAMES))} FROM r",
                                  [f"r AS (SELECT ci_name, event_date_time, {_roll(True)} FROM type_hourly)"]),
    "zscore_trend": sql("type_hourly", """SELECT ci_name, event_date_time, round(event_value - Rolling_mean_24, 6) AS Deviation_from_mean,
  round((event_value - Rolling_mean_24) / (Rolling_std_24 + 1e-6), 6) AS Z_score,
  CAST(coalesce(Rolling_mean_6 > Rolling_mean_24, false) AS INT) AS Trend_up,
  CAST(coalesce(Rolling_mean_6 < Rolling_mean_24, false) AS INT) AS Trend_down FROM r""",
                        [f"r AS (SELECT *, {_roll(False, L.LIGHT_WINDOWS)} FROM type_hourly)"]),
    "drop_warmup": sql("type_hourly", f"SELECT ci_name, event_date_time, event_value FROM type_hourly QUALIFY row_number() {_OV} > 24"),
    "train_test_split_21d": sql("type_hourly", """SELECT cluster, CAST(event_date_time >= last_ts - INTERVAL 21 DAY AS INT) AS is_test, count(*) AS n,
  min(event_date_time) AS from_ts, max(event_date_time) AS to_ts
  FROM (SELECT *, max(event_date_time) OVER (PARTITION BY cluster) AS last_ts FROM
    (SELECT *, CAST(length(ci_name) % 2 AS INT) AS cluster FROM type_hourly)) GROUP BY 1, 2"""),
    "time_folds": sql("type_hourly", """SELECT CAST(f AS INT) AS fold, lo AS train_from,
  lo + to_seconds(CAST(floor(secs * f / 6) AS BIGINT)) AS valid_from, lo + to_seconds(CAST(floor(secs * (f + 1) / 6) AS BIGINT)) AS valid_to
  FROM (SELECT min(event_date_time) AS lo, date_sub('second', min(event_date_time), max(event_date_time)) AS secs FROM type_hourly),
  (SELECT unnest(generate_series(1, 5)) AS f)"""),
    "forecast_metrics": sql("type_hourly", """SELECT ci_name, count(*) AS n, round(sqrt(avg((p - y) * (p - y))), 6) AS rmse, round(avg(abs(p - y)), 6) AS mae,
  round(1 - sum((p - y) * (p - y)) / (var_pop(y) * count(*)), 6) AS r2, round(avg(CASE WHEN y <> 0 THEN abs((p - y) / y) END) * 100, 6) AS mape,
  round(avg(CASE WHEN abs(y) + abs(p) <> 0 THEN abs(p - y) / ((abs(y) + abs(p)) / 2) END) * 100, 6) AS smape
  FROM (SELECT ci_name, event_value AS y, lag(event_value, 24) OVER (PARTITION BY ci_name ORDER BY event_date_time) AS p FROM type_hourly)
  WHERE p IS NOT NULL GROUP BY 1"""),
    "cluster_join_summary": sql("poller", """SELECT CAST(substr(ci_name, 4) AS INT) % 4 AS cluster, count(DISTINCT ci_name) AS devices,
  count(*) AS n_rows FROM poller GROUP BY 1"""),
    "stratified_sample": sql("poller", """SELECT cluster, ci_name FROM (SELECT *, row_number() OVER (PARTITION BY cluster ORDER BY key, ci_name) AS rank FROM p)
  ORDER BY CAST(rank > ceil(10.0 / (SELECT count(DISTINCT cluster) FROM p)) AS INT), rank, key LIMIT 10""",
                             ["p AS (SELECT DISTINCT CAST(substr(ci_name, 4) AS INT) % 4 AS cluster, ci_name, md5(concat(ci_name, ':42')) AS key FROM poller)"]),
    "downsample_step": sql("type_hourly", """SELECT ci_name, event_date_time, event_value FROM (SELECT *, count(*) OVER (PARTITION BY ci_name) AS n,
  row_number() OVER (PARTITION BY ci_name ORDER BY event_date_time) AS rn FROM type_hourly) WHERE (rn - 1) % CAST(ceil(n / 400) AS INT) = 0"""),
}
