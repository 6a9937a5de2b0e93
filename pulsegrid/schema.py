"""Schemas, column aliases and column checks of the fleet tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F, types as T

POLLER = T.StructType(
    [
        T.StructField("ci_name", T.StringType()),
        T.StructField("ci_type", T.StringType()),
        T.StructField("event_date_time", T.TimestampNTZType()),
        T.StructField("event_type", T.StringType()),
        T.StructField("device_role", T.StringType()),
        T.StructField("event_value", T.DoubleType()),
        T.StructField("site_longitude", T.DoubleType()),
        T.StructField("site_latitude", T.DoubleType()),
        T.StructField("service_line", T.StringType()),
        T.StructField("site_name", T.StringType()),
        T.StructField("site_city", T.StringType()),
        T.StructField("site_country", T.StringType()),
        T.StructField("site_criticality", T.StringType()),
        T.StructField("site_business_hours", T.StringType()),
        T.StructField("device_type_label", T.StringType()),
        T.StructField("customer_name", T.StringType()),
    ]
)

DIMENSIONS = [
    "ci_type", "device_role", "site_longitude", "site_latitude", "service_line",
    "site_name", "site_city", "site_country", "site_criticality", "site_business_hours",
]

HOURLY = T.StructType(
    [T.StructField("ci_name", T.StringType())]
    + [f for f in POLLER.fields if f.name in DIMENSIONS]
    + [
        T.StructField("event_day", T.IntegerType()),
        T.StructField("event_hour", T.IntegerType()),
        T.StructField("max_event_value", T.DoubleType()),
    ]
)

ASSIGNMENTS = T.StructType(
    [T.StructField("ci_name", T.StringType()), T.StructField("cluster", T.IntegerType())]
)

# Spellings accepted for the canonical columns.
ALIASES = {
    "max_event_value": "event_value",
    "CI_name": "ci_name",
    "CI_NAME": "ci_name",
    "Cluster": "cluster",
    "cluster_label": "cluster",
    "site_business_hour": "site_business_hours",
    "site_criticallity": "site_criticality",
}


def normalise_columns(df: DataFrame, aliases: dict[str, str] | None = None,
                      required: list[str] | None = None) -> DataFrame:
    """Rename known spellings and fail early when a needed column is absent.

    An alias is left alone when its canonical name is already present.
    """
    known = ALIASES if aliases is None else aliases
    renames: dict[str, str] = {}
    taken = set(df.columns)
    for old, new in known.items():
        if old in df.columns and new not in taken:
            renames[old] = new
            taken.add(new)
    out = df.withColumnsRenamed(renames)
    missing = [c for c in (required or []) if c not in out.columns]
    if missing:
        raise ValueError(f"missing required columns: {missing}")
    return out


def parse_dates(df: DataFrame, cols: list[str]) -> DataFrame:
    """Cast text or timestamp columns to ``timestamp_ntz``; unparsable text is null."""
    return df.withColumns({c: F.expr(f"try_cast(`{c}` AS TIMESTAMP_NTZ)") for c in cols})
