"""The test tables reshaped into the fleet schemas."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def trunc_ntz(unit: str, col: str) -> F.Column:
    """``date_trunc`` that stays free of a time zone."""
    return F.date_trunc(unit, F.col(col)).cast("timestamp_ntz")


def poller(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Irregular readings with dimensions and nulls, derived from ``events``."""
    e = table(spark, sf_dir, "events").select("ts", "user_id", "event_type", "value")
    n = table(spark, sf_dir, "nation").select("n_nationkey", "n_name")
    u = F.col("user_id")
    return e.join(n, F.col("n_nationkey") == u % 25).select(
        F.concat(F.lit("CI-"), u).alias("ci_name"),
        F.when(u % 2 == 0, "Interface").otherwise("Logical Connection").alias("ci_type"),
        F.col("ts").alias("event_date_time"),
        F.when(F.col("event_type").isin("view", "click"), "in_bandwidth_pct")
        .otherwise("out_bandwidth_pct").alias("event_type"),
        F.when(u % 4 < 2, "CE").otherwise("PE").alias("device_role"),
        F.col("value").alias("event_value"),
        F.concat(F.lit("SITE-"), u % 25).alias("site_name"),
        F.when(u % 7 != 0, F.col("n_name")).alias("site_country"),
        F.when(u % 11 != 0, F.concat(7 + u % 3, F.lit("-"), 17 + u % 3)).alias("site_business_hours"),
        F.when(u % 5 == 0, "Unknown").when(u % 5 == 1, "low").when(u % 5 == 2, "medium")
        .when(u % 5 == 3, "high").otherwise("very high").alias("site_criticality"),
        F.when(u % 9 == 0, "Switch").otherwise("IP Router").alias("device_type_label"),
        F.when(u % 10 == 0, "TENANT_B").otherwise("TENANT_A").alias("customer_name"),
    )


def at_risk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return (
        poller(spark, sf_dir)
        .filter(F.col("site_criticality").isin("high", "very high"))
        .select("ci_name").distinct()
    )


def supplier_daily(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Seven calendar months of daily maxima with partial presence."""
    ship = F.col("l_shipdate")
    return (
        table(spark, sf_dir, "lineitem")
        .filter((F.col("l_returnflag") == "R")
                & (ship >= F.lit("1996-12-01").cast("timestamp_ntz"))
                & (ship < F.lit("1997-07-01").cast("timestamp_ntz")))
        .groupBy("l_suppkey", "l_shipdate")
        .agg(F.max(F.col("l_quantity") * 2).alias("event_value"))
        .select(
            F.concat(F.lit("CI-"), "l_suppkey").alias("ci_name"),
            F.when(F.col("l_suppkey") % 2 == 0, "Interface")
            .otherwise("Logical Connection").alias("ci_type"),
            ship.alias("event_date_time"),
            F.year(ship).alias("event_year"),
            F.month(ship).alias("event_month"),
            "event_value",
        )
    )


def type_hourly(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Five dense hourly series, one per event type."""
    v = F.col("value")
    return (
        table(spark, sf_dir, "events")
        .groupBy(F.col("event_type").alias("ci_name"), trunc_ntz("hour", "ts").alias("event_date_time"))
        .agg(F.max(F.when(v > 100, F.lit(100.0)).otherwise(v)).alias("event_value"))
    )


def supplier_weekly(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One weekly series per supplier, of unequal lengths."""
    return (
        table(spark, sf_dir, "lineitem")
        .groupBy("l_suppkey", trunc_ntz("week", "l_shipdate").alias("event_date_time"))
        .agg(F.max(F.col("l_quantity") * 2).alias("event_value"))
        .select(F.concat(F.lit("CI-"), "l_suppkey").alias("ci_name"), "event_date_time", "event_value")
    )
