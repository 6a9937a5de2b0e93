"""Reader, schema and sink queries with their SQL."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from pulsegrid import schema as SC
from pulsegrid.catalog.duck import sql
from pulsegrid.functions.stats import finite
from pulsegrid.session import ensure_checkpoint_dir
from pulsegrid.sources import readers as R, views as V, writers as W


def _shared_folder(spark) -> str:
    """A new folder beside the checkpoints, which all executors see."""
    ensure_checkpoint_dir(spark)
    return f"{spark.sparkContext._jsc.sc().getCheckpointDir().get()}/{uuid.uuid4()}"


def _metric_table(s, d):
    df = R.read_poller(s, f"{d}/events.parquet")
    return df.groupBy("event_type").agg(F.count("*").alias("n_rows"), F.count("ci_name").alias("n_named"), F.count("site_country").alias("n_countries"))


def _canonical(s, d):
    old = V.supplier_daily(s, d).withColumnsRenamed({"ci_name": "CI_NAME", "event_value": "max_event_value"})
    out = SC.normalise_columns(old.withColumn("Cluster", F.col("event_month") % 3), required=["ci_name", "event_value", "cluster"])
    return out.select("ci_name", "event_value", F.col("cluster").cast("int").alias("cluster"))


def _dates(s, d):
    text = F.when(F.col("event_id") % 7 == 0, "not a date").otherwise(F.date_format("ts", "yyyy-MM-dd HH:mm:ss"))
    return SC.parse_dates(V.table(s, d, "events").select("event_id", text.alias("event_date_time")), ["event_date_time"])


def _complete_written(s, d):
    path = _shared_folder(s)
    W.write_complete(V.supplier_daily(s, d), path)
    back = s.read.parquet(path)
    return back.groupBy("ci_type").agg(F.count("*").alias("n_rows"), F.count_distinct("ci_name").alias("n_items"), F.max("event_value").alias("max_value"))


def _assignments_written(s, d):
    path = _shared_folder(s)
    labels = V.supplier_daily(s, d).groupBy(F.col("ci_name").alias("CI_name")).agg((F.count("*") % 4).cast("string").alias("cluster_label"))
    W.write_result(labels, path, "csv")
    return R.read_assignments(s, path, "csv")


def _finite(s, d):
    v = F.when(F.col("event_id") % 5 == 0, float("nan")).when(F.col("event_id") % 5 == 1, float("inf")).when(
        F.col("event_id") % 5 == 2, float("-inf")).otherwise(F.col("value"))
    return V.table(s, d, "events").select("event_type", finite(v).alias("v")).groupBy("event_type").agg(
        F.count("v").alias("n_finite"), F.count_if(F.col("v").isNull()).alias("n_missing"), F.round(F.avg("v"), 6).alias("mean_value"))


QUERIES = {
    "read_metric_table": _metric_table,
    "canonical_columns": _canonical,
    "parsed_dates": _dates,
    "complete_written": _complete_written,
    "assignments_written": _assignments_written,
    "finite_values": _finite,
}

ORACLES = {
    "read_metric_table": "SELECT event_type, count(*) AS n_rows, CAST(0 AS BIGINT) AS n_named, CAST(0 AS BIGINT) AS n_countries FROM events GROUP BY 1",
    "canonical_columns": sql("supplier_daily", "SELECT ci_name, event_value, CAST(event_month % 3 AS INT) AS cluster FROM supplier_daily"),
    "parsed_dates": "SELECT event_id, CASE WHEN event_id % 7 = 0 THEN NULL ELSE CAST(date_trunc('second', ts) AS TIMESTAMP) END AS event_date_time FROM events",
    "complete_written": sql("supplier_daily", """SELECT ci_type, count(*) AS n_rows, count(DISTINCT ci_name) AS n_items, max(event_value) AS max_value
  FROM supplier_daily GROUP BY 1"""),
    "assignments_written": sql("supplier_daily", "SELECT ci_name, CAST(count(*) % 4 AS INT) AS cluster FROM supplier_daily GROUP BY 1"),
    "finite_values": """SELECT event_type, count(*) FILTER (event_id % 5 > 2) AS n_finite, count(*) FILTER (event_id % 5 <= 2) AS n_missing,
  round(avg(value) FILTER (event_id % 5 > 2), 6) AS mean_value FROM events GROUP BY 1""",
}
