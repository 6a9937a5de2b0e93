"""Extraction, completeness and data-quality queries with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from pulsegrid.catalog.duck import rounded as rnd, sql
from pulsegrid.catalog.util import rounded
from pulsegrid.operators import quality as Q, rollup as R
from pulsegrid.sources import views as V

DIMS = ["ci_type", "device_role", "site_name", "site_country", "site_criticality", "site_business_hours"]


def january(spark, d, business_hours=False):
    picked = R.select_readings(V.poller(spark, d), "in_bandwidth_pct", "IP Router", "TENANT_A",
                               2024, 1, business_hours)
    return R.hourly_max(picked, DIMS)


def _month_named(spark, d):
    """Monthly rows as the extracts carry them: a month name, a day and an hour."""
    df = V.supplier_daily(spark, d)
    return df.select(
        "ci_name", "ci_type", "event_value",
        F.date_format("event_date_time", "MMMM").alias("event_month"),
        F.dayofmonth("event_date_time").alias("event_day"),
        F.hour("event_date_time").alias("event_hour"),
    )


MONTH_YEARS = {"December": 1996, "January": 1997, "February": 1997, "March": 1997, "April": 1997,
               "May": 1997, "June": 1997}


def _built_time(spark, d):
    out = R.build_event_time(_month_named(spark, d), MONTH_YEARS)
    return out.withColumn("event_date", F.col("event_date").cast("string"))


def _split(spark, d):
    df = V.supplier_daily(spark, d)
    return df.groupBy("ci_type").agg(
        F.count("*").alias("n_rows"), F.count_distinct("ci_name").alias("n_items"),
        F.max("event_value").alias("max_value"))


QUERIES = {
    "hourly_max": january,
    "hourly_max_business_hours": lambda s, d: january(s, d, True),
    "at_risk_semi": lambda s, d: R.keep_listed(january(s, d), V.at_risk(s, d)),
    "months_complete": lambda s, d: R.complete_items(V.supplier_daily(s, d), ["event_year", "event_month"], 7),
    "months_present": lambda s, d: R.months_present(V.supplier_daily(s, d), ["event_year", "event_month"]),
    "event_timestamp_build": _built_time,
    "split_by_type": _split,
    "keep_interface": lambda s, d: R.keep_type(V.supplier_daily(s, d), "Interface"),
    "unknown_criticality": lambda s, d: Q.value_counts(R.unknown_criticality(V.poller(s, d)), "Criticality_unknown"),
    "null_report": lambda s, d: rounded(Q.null_report(V.poller(s, d))),
    "describe_values": lambda s, d: rounded(Q.describe_values(V.poller(s, d), ["event_value"])),
    "distinct_dates": lambda s, d: Q.distinct_dates(V.poller(s, d)),
    "constant_columns": lambda s, d: R.constant_columns(
        V.poller(s, d).withColumn("source", F.lit("feed")),
        ["ci_name", "ci_type", "site_country", "event_value", "source"]).withColumn(
            "is_constant", F.col("is_constant").cast("int")),
    "date_stats": lambda s, d: rounded(Q.date_stats(V.poller(s, d))),
    "date_count_summary": lambda s, d: rounded(Q.date_count_summary(Q.date_stats(V.poller(s, d)))),
    "global_period": lambda s, d: Q.global_period(V.poller(s, d)),
    "coverage_summary": lambda s, d: rounded(Q.coverage_summary(Q.date_stats(V.poller(s, d)))),
    "weekly_presence": lambda s, d: Q.weekly_presence(V.supplier_daily(s, d)),
    "week_number_presence": lambda s, d: Q.week_number_presence(V.supplier_daily(s, d)),
    "device_presence": lambda s, d: Q.device_presence(V.supplier_daily(s, d)),
    "presence_bins": lambda s, d: Q.presence_bins(Q.device_presence(V.supplier_daily(s, d))),
    "mostly_present": lambda s, d: Q.mostly_present(Q.device_presence(V.supplier_daily(s, d))),
    "top_present": lambda s, d: Q.top_present(Q.device_presence(V.supplier_daily(s, d))),
    "week_correlation": lambda s, d: rounded(Q.week_correlation(V.supplier_daily(s, d))),
    "week_overlap": lambda s, d: rounded(Q.week_overlap(V.supplier_daily(s, d))),
    "missing_cells": lambda s, d: Q.missing_cells(V.type_hourly(s, d)),
    "missing_per_item": lambda s, d: rounded(Q.missing_per_item(V.type_hourly(s, d))),
    "missing_by_ts": lambda s, d: Q.missing_by_ts(V.type_hourly(s, d)),
    "gap_runs": lambda s, d: Q.gap_runs(V.type_hourly(s, d)),
    "alignment_verdict": lambda s, d: Q.alignment_verdict(V.type_hourly(s, d)),
    "histogram_counts": lambda s, d: Q.histogram(V.poller(s, d), "event_value"),
    "fill_site_mode": lambda s, d: Q.fill_from_site(V.poller(s, d), ["site_country", "site_business_hours"]),
}

_DATE_STATS = """date_stats AS (
  SELECT p.ci_name, count(*) AS unique_dates, min(ts) AS min_date, max(ts) AS max_date,
    CAST(date_sub('day', min(ts), max(ts)) + 1 AS BIGINT) AS period_days,
    count(*) / (date_sub('day', min(ts), max(ts)) + 1) * 100 AS coverage_percent,
    count(*) / (date_sub('hour', min(ts), max(ts)) + 1) * 100 AS coverage_hourly_percent,
    avg(gap) AS avg_gap_days, max(gap) AS max_gap_days,
    CAST(count(DISTINCT weekofyear(ts)) AS INT) AS unique_weeks,
    CAST(count(DISTINCT month(ts)) AS INT) AS unique_months
  FROM (SELECT ci_name, ts, date_sub('microsecond', lag(ts) OVER (PARTITION BY ci_name ORDER BY ts), ts) / 86400000000.0 AS gap
        FROM (SELECT DISTINCT ci_name, event_date_time AS ts FROM poller)) p
  GROUP BY p.ci_name)"""

_YW = "strftime(event_date_time, '%Y-%W')"
_PRESENCE = f"""weeks AS (SELECT DISTINCT ci_name, {_YW} AS year_week FROM supplier_daily),
presence AS (SELECT *, CASE WHEN presence_percentage > 90 THEN '90-100%' WHEN presence_percentage > 75 THEN '75-90%'
    WHEN presence_percentage > 50 THEN '50-75%' WHEN presence_percentage > 25 THEN '25-50%'
    WHEN presence_percentage > 10 THEN '10-25%' WHEN presence_percentage > 0 THEN '0-10%' END AS presence_category
  FROM (SELECT ci_name, count(*) AS weeks_present, (SELECT count(DISTINCT year_week) FROM weeks) AS total_weeks,
    round(count(*) / (SELECT count(DISTINCT year_week) FROM weeks) * 100, 2) AS presence_percentage
  FROM weeks GROUP BY ci_name))"""
_MATRIX = """m AS (SELECT c.ci_name, y.year_week, CASE WHEN w.ci_name IS NULL THEN 0.0 ELSE 1.0 END AS p
  FROM (SELECT DISTINCT ci_name FROM weeks) c CROSS JOIN (SELECT DISTINCT year_week FROM weeks) y
  LEFT JOIN weeks w ON w.ci_name = c.ci_name AND w.year_week = y.year_week)"""
_GRID = """grid AS (SELECT t.event_date_time, c.ci_name, v.ci_name IS NULL AS absent
  FROM (SELECT DISTINCT event_date_time FROM type_hourly) t CROSS JOIN (SELECT DISTINCT ci_name FROM type_hourly) c
  LEFT JOIN type_hourly v ON v.ci_name = c.ci_name AND v.event_date_time = t.event_date_time)"""


def _mode(col: str, src: str) -> str:
    return (f"SELECT {col} FROM (SELECT {col}, count(*) AS n FROM {src} WHERE {col} IS NOT NULL "
            f"GROUP BY 1) ORDER BY n DESC, {col} LIMIT 1")


def _fill_ctes(col: str, src: str) -> list[str]:
    return [
        f"""{col}_m AS (SELECT site_name, {col} AS v FROM (SELECT site_name, {col}, row_number() OVER (
  PARTITION BY site_name ORDER BY count(*) DESC, {col}) AS r FROM {src} WHERE {col} IS NOT NULL GROUP BY 1, 2) WHERE r = 1)""",
        f"""{col}_s AS (SELECT p.* REPLACE (coalesce(p.{col}, m.v) AS {col}) FROM {src} p LEFT JOIN {col}_m m USING (site_name))""",
        f"""{col}_f AS (SELECT * REPLACE (coalesce({col}, ({_mode(col, col + '_s')})) AS {col}) FROM {col}_s)""",
    ]


_POLLER_COLS = ("ci_name ci_type event_date_time event_type device_role event_value site_name site_country "
                "site_business_hours site_criticality device_type_label customer_name").split()

ORACLES = {
    "hourly_max": sql("hourly", "SELECT * FROM hourly"),
    "hourly_max_business_hours": sql("hourly_business", "SELECT * FROM hourly"),
    "at_risk_semi": sql("hourly at_risk", "SELECT * FROM hourly WHERE ci_name IN (SELECT ci_name FROM at_risk)"),
    "months_complete": sql("supplier_daily", """SELECT * FROM supplier_daily WHERE ci_name IN (
  SELECT ci_name FROM supplier_daily GROUP BY 1 HAVING count(DISTINCT event_year * 100 + event_month) = 7)"""),
    "months_present": sql("supplier_daily", """SELECT ci_name, count(DISTINCT event_year * 100 + event_month)
  AS months_present FROM supplier_daily GROUP BY 1"""),
    "event_timestamp_build": sql("supplier_daily", """SELECT ci_name, ci_type, event_value,
  monthname(event_date_time) AS event_month, CAST(day(event_date_time) AS INT) AS event_day,
  CAST(hour(event_date_time) AS INT) AS event_hour, strftime(event_date_time, '%Y-%m-%d') AS event_date,
  CAST(date_trunc('hour', event_date_time) AS TIMESTAMP) AS event_date_time FROM supplier_daily"""),
    "split_by_type": sql("supplier_daily", """SELECT ci_type, count(*) AS n_rows, count(DISTINCT ci_name) AS n_items,
  max(event_value) AS max_value FROM supplier_daily GROUP BY 1"""),
    "keep_interface": sql("supplier_daily", "SELECT * FROM supplier_daily WHERE ci_type = 'Interface'"),
    "unknown_criticality": sql("poller", """SELECT CASE WHEN site_criticality = 'Unknown' THEN 1 ELSE 0 END AS value,
  count(*) AS n FROM poller GROUP BY 1"""),
    "null_report": sql("poller", " UNION ALL ".join(
        f"SELECT '{c}' AS column_name, count(*) FILTER ({c} IS NULL) AS missing_values, "
        f"round(count(*) FILTER ({c} IS NULL) * 100.0 / count(*), 6) AS percentage FROM poller"
        for c in _POLLER_COLS)),
    "describe_values": sql("poller", """SELECT 'event_value' AS column_name, count(event_value) AS n,
  round(avg(event_value), 6) AS mean, round(stddev_samp(event_value), 6) AS std, round(min(event_value), 6) AS min,
  round(quantile_cont(event_value, 0.25), 6) AS p25, round(quantile_cont(event_value, 0.5), 6) AS p50,
  round(quantile_cont(event_value, 0.75), 6) AS p75, round(max(event_value), 6) AS max FROM poller"""),
    "distinct_dates": sql("poller", "SELECT ci_name, count(DISTINCT event_date_time) AS distinct_dates FROM poller GROUP BY 1"),
    "constant_columns": sql("poller", " UNION ALL ".join(
        f"SELECT '{c}' AS column_name, CASE WHEN count(DISTINCT {e}) + max(CASE WHEN {e} IS NULL THEN 1 ELSE 0 END) <= 1 "
        f"THEN 1 ELSE 0 END AS is_constant FROM poller"
        for c, e in [("ci_name", "ci_name"), ("ci_type", "ci_type"), ("site_country", "site_country"),
                     ("event_value", "event_value"), ("source", "'feed'")])),
    "date_stats": sql("poller", f"""SELECT ci_name, unique_dates, min_date, max_date, period_days, unique_weeks,
  unique_months, {rnd('coverage_percent, coverage_hourly_percent, avg_gap_days, max_gap_days')} FROM date_stats""",
                      [_DATE_STATS]),
    "date_count_summary": sql("poller", """SELECT round(avg(unique_dates), 6) AS mean_count,
  round(quantile_cont(CAST(unique_dates AS DOUBLE), 0.5), 6) AS median_count, round(stddev_samp(unique_dates), 6) AS std_count,
  min(unique_dates) AS min_count, max(unique_dates) AS max_count,
  round(quantile_cont(CAST(unique_dates AS DOUBLE), 0.25), 6) AS p25_count,
  round(quantile_cont(CAST(unique_dates AS DOUBLE), 0.75), 6) AS p75_count FROM date_stats""", [_DATE_STATS]),
    "global_period": sql("poller", """SELECT min(event_date_time) AS min_date, max(event_date_time) AS max_date,
  CAST(date_sub('day', min(event_date_time), max(event_date_time)) + 1 AS BIGINT) AS period_days,
  CAST(count(DISTINCT weekofyear(event_date_time)) AS INT) AS total_weeks,
  CAST(count(DISTINCT month(event_date_time)) AS INT) AS total_months FROM poller"""),
    "coverage_summary": sql("poller", """SELECT round(avg(coverage_percent), 6) AS mean_coverage,
  round(avg(avg_gap_days), 6) AS mean_avg_gap, round(avg(max_gap_days), 6) AS mean_max_gap,
  count(*) FILTER (coverage_percent >= 90) AS high_coverage,
  round(count(*) FILTER (coverage_percent >= 90) / count(*) * 100, 6) AS high_coverage_pct,
  count(*) FILTER (coverage_percent <= 10) AS low_coverage,
  round(count(*) FILTER (coverage_percent <= 10) / count(*) * 100, 6) AS low_coverage_pct FROM date_stats""", [_DATE_STATS]),
    "weekly_presence": sql("supplier_daily", """SELECT week_start, count(DISTINCT ci_name) AS devices_count,
  round(count(DISTINCT ci_name) / (SELECT count(DISTINCT ci_name) FROM supplier_daily) * 100, 2) AS percentage,
  strftime(week_start, '%Y-%W') AS year_week_label
  FROM (SELECT ci_name, CAST(date_trunc('week', event_date_time) AS TIMESTAMP) AS week_start FROM supplier_daily) GROUP BY 1"""),
    "week_number_presence": sql("supplier_daily", """SELECT CAST(weekofyear(event_date_time) AS INT) AS week,
  count(DISTINCT ci_name) AS devices_count,
  round(count(DISTINCT ci_name) / (SELECT count(DISTINCT ci_name) FROM supplier_daily) * 100, 2) AS percentage
  FROM supplier_daily GROUP BY 1"""),
    "device_presence": sql("supplier_daily", "SELECT * FROM presence", [_PRESENCE]),
    "presence_bins": sql("supplier_daily", """SELECT presence_category, count(*) AS devices,
  round(count(*) / (SELECT count(*) FROM presence) * 100, 2) AS pct_devices FROM presence GROUP BY 1""", [_PRESENCE]),
    "mostly_present": sql("supplier_daily", """SELECT count(*) FILTER (presence_percentage >= 50)
  AS devices_mostly_present FROM presence""", [_PRESENCE]),
    "top_present": sql("supplier_daily", "SELECT * FROM presence ORDER BY presence_percentage DESC, ci_name LIMIT 10", [_PRESENCE]),
    "week_correlation": sql("supplier_daily", """SELECT week_a, week_b, round(CASE WHEN sa > 0 AND sb > 0 THEN cov / (sa * sb) END, 6) AS correlation
  FROM (SELECT a.year_week AS week_a, b.year_week AS week_b, covar_pop(a.p, b.p) AS cov, stddev_pop(a.p) AS sa, stddev_pop(b.p) AS sb
  FROM m a JOIN m b ON a.ci_name = b.ci_name AND a.year_week < b.year_week GROUP BY 1, 2)""", [_PRESENCE, _MATRIX]),
    "week_overlap": sql("supplier_daily", """SELECT a.year_week AS week_a, b.year_week AS week_b,
  round(sum(a.p * b.p) / sum(a.p), 6) AS overlap FROM m a JOIN m b ON a.ci_name = b.ci_name GROUP BY 1, 2""", [_PRESENCE, _MATRIX]),
    "missing_cells": sql("type_hourly", "SELECT ci_name, event_date_time FROM grid WHERE absent", [_GRID]),
    "missing_per_item": sql("type_hourly", """SELECT ci_name, count(*) FILTER (absent) AS missing,
  round(count(*) FILTER (absent) / count(*) * 100, 6) AS pct_missing FROM grid GROUP BY 1""", [_GRID]),
    "missing_by_ts": sql("type_hourly", """SELECT event_date_time, count(*) FILTER (absent) AS missing_devices
  FROM grid GROUP BY 1""", [_GRID]),
    "gap_runs": sql("type_hourly", """SELECT ci_name, min(event_date_time) AS run_start, count(*) AS run_length
  FROM (SELECT *, row_number() OVER (PARTITION BY ci_name ORDER BY event_date_time)
     - row_number() OVER (PARTITION BY ci_name, absent ORDER BY event_date_time) AS g FROM grid) WHERE absent GROUP BY ci_name, g""", [_GRID]),
    "alignment_verdict": sql("type_hourly", """SELECT count(DISTINCT event_date_time) AS n_timestamps,
  count(DISTINCT ci_name) AS n_devices, count(*) AS expected_rows, (SELECT count(*) FROM type_hourly) AS n_rows,
  count(*) FILTER (absent) AS missing_cells,
  count(DISTINCT CASE WHEN absent THEN event_date_time END) AS timestamps_with_missing,
  CASE WHEN count(*) FILTER (absent) = 0 THEN 1 ELSE 0 END AS aligned FROM grid""", [_GRID]),
    "histogram_counts": sql("poller", """SELECT CAST(least(floor((event_value - lo) / (hi - lo) * 50), 49) AS INT) AS bin, count(*) AS n
  FROM poller, (SELECT min(event_value) AS lo, max(event_value) AS hi FROM poller) GROUP BY 1"""),
    "fill_site_mode": sql("poller", "SELECT * FROM site_business_hours_f",
                          _fill_ctes("site_country", "poller") + _fill_ctes("site_business_hours", "site_country_f")),
}
