"""End-to-end jobs on small fixtures, and rules of single steps."""

import datetime as dt
import math

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from pulsegrid import schema as SC
from pulsegrid.operators import lags as L, quality as Q, rollup as R, series as S, split as P
from pulsegrid.plans import elastic as EP, extract as X, features as FP, forecasting as FC
from pulsegrid.sources import readers, views as V


def test_clamp_handles_nan_and_infinity(spark):
    df = spark.createDataFrame([(float("nan"),), (150.0,), (None,), (float("inf"),), (7.0,)], "v double")
    assert [r[0] for r in df.select(R.clamp(F.col("v"))).collect()] == [None, 100.0, None, 100.0, 7.0]


def test_month_bounds_cross_the_year():
    assert R.month_range(2024, 12) == (dt.datetime(2024, 12, 1), dt.datetime(2025, 1, 1))


def test_aliases_and_required_columns(spark):
    df = spark.createDataFrame([("a", 1.0, 2)], "CI_NAME string, max_event_value double, Cluster int")
    out = SC.normalise_columns(df, required=["ci_name", "event_value", "cluster"])
    assert out.columns == ["ci_name", "event_value", "cluster"]
    with pytest.raises(ValueError):
        SC.normalise_columns(df, required=["nope"])


def test_bad_dates_become_null(spark):
    df = spark.createDataFrame([("2025-01-02 03:00:00",), ("bad",)], "t string")
    assert [r["t"] for r in SC.parse_dates(df, ["t"]).collect()] == [dt.datetime(2025, 1, 2, 3), None]


def _monthly(tmp_path):
    head = "ci_name,ci_type,event_day,event_hour,max_event_value\n"
    body = {"december": ["A,Interface,5,1,10", "B,Interface,5,1,11", "Z,Interface,5,1,1"], "january": ["A,Interface,6,2,20"],
            "complete": ["A,Interface,6,2,99"]}
    for month, rows in body.items():
        (tmp_path / f"data_{month}.csv").write_text(head + "\n".join(rows) + "\n")
    return str(tmp_path / "data_*.csv")


def test_complete_series(spark, tmp_path):
    src = tmp_path / "in"
    src.mkdir()
    glob = _monthly(src)
    risk = spark.createDataFrame([("A",), ("B",)], "ci_name string")
    schema = "ci_name string, ci_type string, event_day int, event_hour int, max_event_value double"
    raw = readers.read_monthly(spark, glob, schema=spark.createDataFrame([], schema).schema)
    assert {r["event_month"] for r in raw.collect()} == {"December", "January"}
    months = {"December": 2024, "January": 2025}
    kept = R.build_event_time(R.complete_items(R.keep_listed(raw, risk), ["event_month"], 2), months)
    assert sorted((r["ci_name"], r["event_date_time"]) for r in kept.collect()) == [
        ("A", dt.datetime(2024, 12, 5, 1)), ("A", dt.datetime(2025, 1, 6, 2))]


def test_extract_to_quality_report(spark, small, tmp_path):
    table = V.poller(spark, small)
    src = str(tmp_path / "poller")
    table.write.parquet(src)
    out = X.monthly_extract(spark, src, 2024, 1, "TENANT_A", str(tmp_path / "data_january"))
    assert out.count() == 322
    paths = X.quality_report(table, str(tmp_path / "report"))
    assert spark.read.parquet(paths["alignment"]).count() == 1


def test_single_reading_has_no_gap(spark):
    df = spark.createDataFrame([("A", dt.datetime(2025, 1, 1))], "ci_name string, event_date_time timestamp_ntz")
    r = Q.date_stats(df).first()
    assert r["avg_gap_days"] is None and r["max_gap_days"] is None and r["period_days"] == 1


def test_gap_runs_at_both_ends(spark):
    t = [dt.datetime(2025, 1, 1, h) for h in range(5)]
    rows = [("A", x, 1.0) for x in t] + [("B", t[2], 1.0)]
    df = spark.createDataFrame(rows, "ci_name string, event_date_time timestamp_ntz, event_value double")
    assert sorted((r["ci_name"], r["run_start"].hour, r["run_length"]) for r in Q.gap_runs(df).collect()) == [("B", 0, 2), ("B", 3, 2)]


def test_site_fill_rules(spark):
    rows = [("s1", "FR"), ("s1", "FR"), ("s1", None), ("s2", None), (None, None), ("s3", "DE"), ("s3", "BE"), ("s3", None)]
    df = spark.createDataFrame(rows, "site_name string, site_country string")
    got = sorted(((r["site_name"] or "", r["site_country"]) for r in Q.fill_from_site(df, ["site_country"]).collect()))
    assert got == sorted([("", "FR"), ("s1", "FR"), ("s1", "FR"), ("s1", "FR"), ("s2", "FR"), ("s3", "BE"), ("s3", "BE"), ("s3", "DE")])


def test_metrics_with_zeros(spark):
    df = spark.createDataFrame([(0.0, 0.0), (0.0, 2.0), (4.0, 2.0)], "event_value double, y_pred double")
    r = P.forecast_metrics(df).first()
    assert r["mape"] == pytest.approx(50) and r["smape"] == pytest.approx((2 / 1 + 2 / 3) / 2 * 100)
    assert r["rmse"] == pytest.approx(math.sqrt(8 / 3))
    zero = P.forecast_metrics(df.filter("event_value = 0 AND y_pred = 0")).first()
    assert zero["mape"] is None and zero["smape"] is None and zero["r2"] is None


def test_leak_free_features_ignore_the_current_value(spark, small):
    df = V.type_hourly(spark, small)
    last = df.agg(F.max("event_date_time")).first()[0]
    other = df.withColumn("event_value", F.when(F.col("event_date_time") == last, 999.0).otherwise(F.col("event_value")))
    a, b = (L.forecast_features(d).filter(F.col("event_date_time") == last).drop("event_value").collect() for d in (df, other))
    assert sorted(map(str, a)) == sorted(map(str, b))


def test_split_has_no_overlap(spark, small):
    df = P.mark_test(V.type_hourly(spark, small).withColumn("cluster", F.lit(1)))
    ends = {r["is_test"]: (r["lo"], r["hi"]) for r in df.groupBy("is_test").agg(
        F.min("event_date_time").alias("lo"), F.max("event_date_time").alias("hi")).collect()}
    assert ends[0][1] < ends[1][0]


def test_forecast_run_writes_everything(spark, small, tmp_path):
    df = V.type_hourly(spark, small)
    clusters = df.select("ci_name", (F.length("ci_name") % 2).cast("int").alias("cluster")).distinct()
    table = FC.run(spark, df, clusters, str(tmp_path), models=("linear", "ridge"), trials=2, folds=2, select=False).collect()
    assert {r["model"] for r in table} == {"linear", "ridge"} and sum(r["note"] == "best" for r in table) == 2
    assert FC.predictions(spark, str(tmp_path)).count() > 0
    from pyspark.ml import PipelineModel

    assert PipelineModel.load(str(tmp_path / "models" / "cluster=0")).stages


def test_elastic_plan_assigns_every_kept_series(spark, small):
    df = V.supplier_weekly(spark, small)
    got, best = EP.cluster_fleet(df, ("dtw", "lcss"), (2, 3))
    assert got.count() == S.length_fence(df).count() and best.count() == 2


def test_feature_table_is_wide_and_whole(spark, small):
    t = FP.feature_table(V.type_hourly(spark, small))
    assert t.count() == 5 and len(t.columns) > 380 and len(set(t.columns)) == len(t.columns)


def test_padding_uses_the_series_mean(spark):
    t0 = pd.Timestamp("2025-01-01")
    rows = [(f"A{i}", (t0 + pd.Timedelta(hours=h)).to_pydatetime(), float(h)) for i, n in enumerate((4, 4, 3, 5)) for h in range(n)]
    df = spark.createDataFrame(rows, "ci_name string, event_date_time timestamp_ntz, event_value double")
    out = S.pad_truncate(df)
    assert {r["ci_name"]: r["c"] for r in out.groupBy("ci_name").agg(F.count("*").alias("c")).collect()} == {f"A{i}": 4 for i in range(4)}
    assert np.isclose(out.filter("ci_name = 'A2' AND pos = 4").first()["event_value"], 1.0)


def test_all_k_are_scored_from_one_pass_over_the_distances(spark, monkeypatch):
    from pulsegrid.functions import blocks as B

    calls, meet = [], B.meet
    monkeypatch.setattr(B, "meet", lambda *a, **k: calls.append(1) or meet(*a, **k))
    rows = [(f"i{i}", [float(i % 3) * 9 + i / 100, float(i % 3 == 1) * 9]) for i in range(30)]
    score, k, labels = FP.best_kmeans(spark.createDataFrame(rows, "item string, vec array<double>"), (2, 3), 2)
    assert len(calls) == 1 and k == 3 and score > 0.9 and labels.count() == 30
