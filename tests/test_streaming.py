"""The hourly stream over two runs of one checkpoint."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from pulsegrid.schema import POLLER
from pulsegrid.streaming import hourly as H

DAY = dt.datetime(2024, 3, 31)  # clocks change on this day in some zones
DIMS = ["ci_type"]


def _write(spark, folder, rows):
    df = spark.createDataFrame([(c, DAY + dt.timedelta(minutes=m) if m is not None else None, v) for c, m, v in rows], "ci_name string, event_date_time timestamp_ntz, event_value double")
    full = df.select(*[F.col(f.name) if f.name in df.columns else F.lit("x" if f.name == "ci_type" else None).cast(f.dataType).alias(f.name) for f in POLLER.fields])
    full.coalesce(1).write.mode("append").parquet(folder)


def _hours(rows):
    out = {}
    for c, m, v in rows:
        if m is not None:
            out.setdefault((c, m // 60), []).append(v if v is None else min(v, 100.0))
    return {k: max((x for x in v if x is not None), default=None) for k, v in out.items()}


def _got(df):
    rows = [((r["ci_name"], int((r["event_date_time"] - DAY).total_seconds() // 3600)), r["max_event_value"]) for r in df.collect()]
    assert len(rows) == len(dict(rows))  # no hour twice
    return dict(rows)


@pytest.mark.parametrize("zone", ["UTC", "Europe/Paris"])
def test_two_runs_with_late_and_repeated_rows(spark, tmp_path, zone):
    before = spark.conf.get("spark.sql.session.timeZone")
    spark.conf.set("spark.sql.session.timeZone", zone)
    folder, out, state = (str(tmp_path / n) for n in ("feed", "out", "state"))
    try:
        first = [("a", m, float(m % 37)) for m in range(0, 400, 5)] + [("b", 7, 250.0), ("b", 65, None), ("b", None, 9.0), (None, 8, 1.0)]
        _write(spark, folder, first)

        def run():
            windows = H.hourly_windows(H.feed(spark, folder, files_per_batch=1), DIMS, "2 hours")
            H.run_new_files(windows, out, state)
            return H.closed_hours(spark, windows, out)

        done = _got(run())
        want = _hours(first)
        # the watermark is 395 - 120 minutes: hours 0 to 3 are over
        assert done == {k: v for k, v in want.items() if k[1] <= 3}
        assert _got(run()) == done  # nothing new
        late = [("a", 300, 99.0), ("c", 290, 5.0)]  # hours still open
        lost = [("a", 10, 100.0), ("d", 20, 3.0)]  # hours written already
        _write(spark, folder, first[40:60] + late + lost + [("a", 700, 1.0)])
        closed = run()
        want = _hours([r for r in first + late + [("a", 700, 1.0)]])
        assert _got(closed) == {k: v for k, v in want.items() if k[1] <= 8}
        readings = spark.read.schema(POLLER).parquet(folder)
        assert _got(H.hours_so_far(closed, readings, DIMS)) == want
    finally:
        spark.conf.set("spark.sql.session.timeZone", before)


def test_no_hour_is_over_yet(spark, tmp_path):
    folder, out, state = (str(tmp_path / n) for n in ("feed", "out", "state"))
    rows = [("a", 3, 1.0), ("a", 30, 2.0)]
    _write(spark, folder, rows)
    windows = H.hourly_windows(H.feed(spark, folder), DIMS)
    H.run_new_files(windows, out, state)
    closed = H.closed_hours(spark, windows, out)
    assert closed.count() == 0
    assert _got(H.hours_so_far(closed, spark.read.schema(POLLER).parquet(folder), DIMS)) == {("a", 0): 2.0}
