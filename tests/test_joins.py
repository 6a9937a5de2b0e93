"""Lookup joins read only what they need and copy nothing."""

import re

import pytest

from pulsegrid import catalog
from pulsegrid.functions.joins import lookup_join


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_semi_join_reads_two_columns(spark, small):
    events = spark.read.parquet(f"{small}/events.parquet")
    keys = events.where("value > 400").select("user_id").distinct()
    text = plan(lookup_join(events, keys, "user_id", "left_semi").select("event_id", "user_id"))
    assert sorted(re.findall(r"ReadSchema: struct<([^>]*)>", text), key=len)[-1] == "event_id:bigint,user_id:bigint"


@pytest.mark.parametrize("name", ["at_risk_semi", "months_complete", "cluster_join_summary", "train_test_split_21d"])
def test_queries_copy_no_lookup(spark, small, name):
    text = plan(catalog.all_queries()[name](spark, small))
    assert "Generate" not in text and "xxhash64" not in text
