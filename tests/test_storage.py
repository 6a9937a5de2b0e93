"""Layouts on disk: plans of bucketed tables, months of extracts, repeatable samples."""

import uuid

import pytest

from pulsegrid.catalog.util import rounded
from pulsegrid.operators import features as X, split as S
from pulsegrid.sources import readers as R, views as V, writers as W


def test_bucketed_table_feeds_item_features_without_a_shuffle(spark, small):
    name = f"t_{uuid.uuid4().hex}"
    W.write_bucketed(V.type_hourly(spark, small), name, 4)
    base = X.base(spark.table(name))
    table = X.basic(base)
    for f in (X.diffs, X.profile, X.trend_acf):
        table = table.join(f(base), "ci_name", "left")
    plan = table._jdf.queryExecution().executedPlan().toString()
    assert "Exchange hashpartitioning" not in plan and "Bucketed: true" in plan
    plain = X.basic(X.base(V.type_hourly(spark, small)))
    assert sorted(map(str, rounded(X.basic(base)).collect())) == sorted(map(str, rounded(plain).collect()))


def test_months_of_files_and_folders(spark, tmp_path):
    head = ",".join(f.name for f in R.HOURLY.fields)
    line = lambda ci, v: ci + "," * (len(R.HOURLY.fields) - 1) + v
    (tmp_path / "data_may.csv").write_text(f"{head}\n{line('a', '1.5')}\n")
    (tmp_path / "data_complete_all.csv").write_text(f"{head}\n{line('z', '9')}\n")
    (tmp_path / "data_june").mkdir()
    (tmp_path / "data_june" / "part-0.csv").write_text(f"{head}\n{line('b', '2')}\n{line('b', '')}\n")
    got = R.read_monthly(spark, f"{tmp_path}/data_*")
    rows = sorted((r["ci_name"], r["event_month"], r["event_value"]) for r in got.na.fill(-1.0).collect())
    assert rows == [("a", "May", 1.5), ("b", "June", -1.0), ("b", "June", 2.0)]


@pytest.mark.parametrize("parts", [1, 7])
def test_sample_is_repeatable_and_near_its_size(spark, parts):
    df = spark.range(20_000).repartition(parts)
    got = {r["id"] for r in S.hash_sample(df, 2_000, ["id"]).collect()}
    assert got == {r["id"] for r in S.hash_sample(spark.range(20_000), 2_000, ["id"]).collect()} and 1_700 < len(got) < 2_300
    assert S.hash_sample(df, 30_000, ["id"]).count() == 20_000
