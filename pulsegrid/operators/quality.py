"""Coverage, gaps, presence, alignment, null and value reports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from pulsegrid.functions.calendar import presence_category, week_start, year_week_label
from pulsegrid.functions.joins import lookup_join
from pulsegrid.functions.quantiles import exact_quantiles

_DAY_MICROS = 86_400_000_000.0


def _days_between(a: Column, b: Column) -> Column:
    return F.timestamp_diff("MICROSECOND", a, b) / _DAY_MICROS


def date_stats(df: DataFrame) -> DataFrame:
    """Coverage and gaps between distinct event times of each item.

    Two levels keep a busy item out of a single task: gaps inside an hour are
    found per (item, hour), then only one row per hour is ordered per item. The
    mean gap needs no ordering: it is the span divided by the number of gaps.
    """
    ts = F.col("event_date_time")
    inner = Window.partitionBy("ci_name", "hour_start").orderBy("event_date_time")
    hours = (
        df.select("ci_name", ts, F.date_trunc("hour", ts).cast("timestamp_ntz").alias("hour_start"))
        .withColumn("prev", F.lag("event_date_time").over(inner))
        .groupBy("ci_name", "hour_start")
        .agg(
            F.min(ts).alias("first_ts"),
            F.max(ts).alias("last_ts"),
            F.count_if(F.col("prev").isNull() | (F.col("prev") < ts)).alias("n"),
            F.max(_days_between(F.col("prev"), ts)).alias("inner_gap"),
        )
    )
    across = Window.partitionBy("ci_name").orderBy("hour_start")
    gap = _days_between(F.lag("last_ts").over(across), F.col("first_ts"))
    per_item = (
        hours.withColumn("outer_gap", gap)
        .groupBy("ci_name")
        .agg(
            F.sum("n").alias("unique_dates"),
            F.min("first_ts").alias("min_date"),
            F.max("last_ts").alias("max_date"),
            F.max(F.greatest("inner_gap", "outer_gap")).alias("gap"),
            F.size(F.collect_set(F.weekofyear("hour_start"))).alias("unique_weeks"),
            F.size(F.collect_set(F.month("hour_start"))).alias("unique_months"),
        )
    )
    lo, hi, n = F.col("min_date"), F.col("max_date"), F.col("unique_dates")
    days = F.timestamp_diff("DAY", lo, hi) + 1
    grid = F.timestamp_diff("HOUR", lo, hi) + 1
    return per_item.select(
        "ci_name", "unique_dates", "min_date", "max_date",
        days.alias("period_days"),
        (n / days * 100).alias("coverage_percent"),
        (n / grid * 100).alias("coverage_hourly_percent"),
        F.when(n > 1, F.try_divide(_days_between(lo, hi), n - 1)).alias("avg_gap_days"),
        F.when(n > 1, F.col("gap")).alias("max_gap_days"),
        "unique_weeks", "unique_months",
    )


def date_count_summary(stats: DataFrame) -> DataFrame:
    """Spread of the per-item counts; counts repeat, so the exact quantile buffer stays small."""
    n = F.col("unique_dates").cast("double")
    q = F.percentile(n, [0.25, 0.5, 0.75])
    return stats.agg(
        F.avg(n).alias("mean_count"), q[1].alias("median_count"), F.stddev_samp(n).alias("std_count"),
        F.min("unique_dates").alias("min_count"), F.max("unique_dates").alias("max_count"),
        q[0].alias("p25_count"), q[2].alias("p75_count"),
    )


def global_period(df: DataFrame) -> DataFrame:
    ts = F.col("event_date_time")
    lo, hi = F.min(ts), F.max(ts)
    return df.agg(
        lo.alias("min_date"), hi.alias("max_date"),
        (F.timestamp_diff("DAY", lo, hi) + 1).alias("period_days"),
        F.size(F.collect_set(F.weekofyear(ts))).alias("total_weeks"),
        F.size(F.collect_set(F.month(ts))).alias("total_months"),
    )


def coverage_summary(stats: DataFrame) -> DataFrame:
    cov = F.col("coverage_percent")
    high, low, n = F.count_if(cov >= 90), F.count_if(cov <= 10), F.count("*")
    return stats.agg(
        F.avg(cov).alias("mean_coverage"),
        F.avg("avg_gap_days").alias("mean_avg_gap"),
        F.avg("max_gap_days").alias("mean_max_gap"),
        high.alias("high_coverage"), (high / n * 100).alias("high_coverage_pct"),
        low.alias("low_coverage"), (low / n * 100).alias("low_coverage_pct"),
    )


def _fleet_size(df: DataFrame) -> Column:
    return df.agg(F.count_distinct("ci_name")).scalar()


def weekly_presence(df: DataFrame) -> DataFrame:
    """Distinct items per calendar week and their share of the fleet."""
    weeks = df.select("ci_name", week_start(F.col("event_date_time")).alias("week_start")).distinct()
    share = F.round(F.col("devices_count") / _fleet_size(df) * 100, 2)
    return (
        weeks.groupBy("week_start").agg(F.count("*").alias("devices_count"))
        .withColumns({"percentage": share, "year_week_label": year_week_label(F.col("week_start"))})
    )


def week_number_presence(df: DataFrame) -> DataFrame:
    """The same by ISO week number alone, without its year."""
    pairs = df.select("ci_name", F.weekofyear("event_date_time").alias("week")).distinct()
    return pairs.groupBy("week").agg(F.count("*").alias("devices_count")).withColumn(
        "percentage", F.round(F.col("devices_count") / _fleet_size(df) * 100, 2)
    )


def _item_weeks(df: DataFrame) -> DataFrame:
    return df.select("ci_name", year_week_label(F.col("event_date_time")).alias("year_week")).distinct()


def device_presence(df: DataFrame) -> DataFrame:
    """Weeks seen per item as a share of all weeks in the data."""
    weeks = _item_weeks(df)
    total = weeks.agg(F.count_distinct("year_week")).scalar()
    return (
        weeks.groupBy("ci_name").agg(F.count("*").alias("weeks_present"))
        .withColumn("total_weeks", total)
        .withColumn("presence_percentage", F.round(F.col("weeks_present") / F.col("total_weeks") * 100, 2))
        .withColumn("presence_category", presence_category(F.col("presence_percentage")))
    )


def presence_bins(presence: DataFrame) -> DataFrame:
    total = presence.agg(F.count("*")).scalar()
    return (
        presence.groupBy("presence_category").agg(F.count("*").alias("devices"))
        .withColumn("pct_devices", F.round(F.col("devices") / total * 100, 2))
    )


def mostly_present(presence: DataFrame, percent: float = 50.0) -> DataFrame:
    return presence.agg(F.count_if(F.col("presence_percentage") >= percent).alias("devices_mostly_present"))


def top_present(presence: DataFrame, k: int = 10) -> DataFrame:
    return presence.orderBy(F.desc("presence_percentage"), "ci_name").limit(k)


def _presence_patterns(df: DataFrame) -> DataFrame:
    """Items with the same set of weeks merge into one weighted row."""
    return (
        _item_weeks(df).groupBy("ci_name")
        .agg(F.array_sort(F.collect_set("year_week")).alias("weeks"))
        .groupBy("weeks").agg(F.count("*").alias("n"))
    )


def _week_grid(patterns: DataFrame, pairs: str) -> DataFrame:
    """All week pairs from one sorted list of the calendar's weeks."""
    weeks = patterns.select(F.explode("weeks").alias("w")).agg(
        F.array_sort(F.collect_set("w")).alias("all_weeks")
    )
    grid = weeks.select("all_weeks", F.explode("all_weeks").alias("week_a"))
    grid = grid.select("week_a", F.explode("all_weeks").alias("week_b"))
    return grid.filter(pairs)


def _pair_counts(patterns: DataFrame) -> DataFrame:
    one = patterns.select("weeks", "n", F.explode("weeks").alias("week_a"))
    return (
        one.select("week_a", F.explode("weeks").alias("week_b"), "n")
        .groupBy("week_a", "week_b").agg(F.sum("n").alias("n_both"))
    )


def week_correlation(df: DataFrame) -> DataFrame:
    """Pearson correlation of the 0/1 presence columns of every two weeks."""
    patterns = _presence_patterns(df)
    pairs = _pair_counts(patterns)
    single = pairs.filter("week_a = week_b").select(F.col("week_a").alias("w"), F.col("n_both").alias("c"))
    n = patterns.agg(F.sum("n")).scalar().cast("double")
    a = single.select(F.col("w").alias("week_a"), F.col("c").alias("na"))
    b = single.select(F.col("w").alias("week_b"), F.col("c").alias("nb"))
    both = F.coalesce("n_both", F.lit(0)).cast("double")
    na, nb = F.col("na").cast("double"), F.col("nb").cast("double")
    return (
        _week_grid(patterns, "week_a < week_b")
        .join(pairs, ["week_a", "week_b"], "left").join(a, "week_a").join(b, "week_b")
        .withColumn("n", n)
        .select(
            "week_a", "week_b",
            F.try_divide(
                F.col("n") * both - na * nb,
                F.sqrt(na * (F.col("n") - na)) * F.sqrt(nb * (F.col("n") - nb)),
            ).alias("correlation"),
        )
    )


def week_overlap(df: DataFrame) -> DataFrame:
    """Share of the first week's items that also appear in the second week."""
    patterns = _presence_patterns(df)
    pairs = _pair_counts(patterns)
    own = pairs.filter("week_a = week_b").select("week_a", F.col("n_both").alias("own"))
    return (
        _week_grid(patterns, "true")
        .join(pairs, ["week_a", "week_b"], "left").join(own, "week_a")
        .select("week_a", "week_b", (F.coalesce("n_both", F.lit(0)) / F.col("own")).alias("overlap"))
    )


def time_axis(df: DataFrame) -> DataFrame:
    """Distinct event times numbered from 0, in two levels so no task orders them all."""
    ts = df.select("event_date_time").distinct().withColumn("day", F.to_date("event_date_time"))
    days = ts.groupBy("day").agg(F.count("*").alias("c"))
    before = F.sum("c").over(Window.orderBy("day")) - F.col("c")  # one row per calendar day
    offsets = days.select("day", before.alias("offset"))
    pos = F.row_number().over(Window.partitionBy("day").orderBy("event_date_time"))
    return ts.withColumn("pos", pos).join(offsets, "day").select(
        "event_date_time", (F.col("offset") + F.col("pos") - 1).alias("idx")
    )


def _runs(df: DataFrame, axis: DataFrame) -> DataFrame:
    """Missing stretches of each item as (start index, length), from neighbouring indexes."""
    n_axis = axis.agg(F.count("*")).scalar()
    seen = df.select("ci_name", "event_date_time").distinct().join(axis, "event_date_time")
    w = Window.partitionBy("ci_name").orderBy("idx")
    step = seen.select("ci_name", "idx", F.coalesce(F.lag("idx").over(w), F.lit(-1)).alias("prev"))
    inner = step.select("ci_name", (F.col("prev") + 1).alias("start"), (F.col("idx") - F.col("prev") - 1).alias("len"))
    tail = seen.groupBy("ci_name").agg(F.max("idx").alias("last")).withColumn("n_axis", n_axis).select(
        "ci_name", (F.col("last") + 1).alias("start"), (F.col("n_axis") - 1 - F.col("last")).alias("len")
    )
    return inner.unionByName(tail).filter("len > 0")


def gap_runs(df: DataFrame) -> DataFrame:
    """Lengths of consecutive missing stretches per item on the fleet's time axis."""
    axis = time_axis(df)
    return (
        _runs(df, axis).join(axis, F.col("start") == F.col("idx"))
        .select("ci_name", F.col("event_date_time").alias("run_start"), F.col("len").cast("long").alias("run_length"))
    )


def missing_cells(df: DataFrame) -> DataFrame:
    """Every (item, event time) without a reading, expanded from the missing stretches."""
    axis = time_axis(df)
    cells = _runs(df, axis).select(
        "ci_name", F.explode(F.expr("sequence(start, start + len - 1)")).alias("idx")
    )
    return cells.join(axis, "idx").select("ci_name", "event_date_time")


def missing_per_item(df: DataFrame) -> DataFrame:
    seen = df.select("ci_name", "event_date_time").distinct()
    total = df.agg(F.count_distinct("event_date_time")).scalar()
    return (
        seen.groupBy("ci_name").agg(F.count("*").alias("present")).withColumn("expected", total)
        .select(
            "ci_name",
            (F.col("expected") - F.col("present")).alias("missing"),
            ((F.col("expected") - F.col("present")) / F.col("expected") * 100).alias("pct_missing"),
        )
    )


def missing_by_ts(df: DataFrame) -> DataFrame:
    seen = df.select("ci_name", "event_date_time").distinct()
    return (
        seen.groupBy("event_date_time").agg(F.count("*").alias("present"))
        .withColumn("fleet", _fleet_size(df))
        .select("event_date_time", (F.col("fleet") - F.col("present")).alias("missing_devices"))
    )


def alignment_verdict(df: DataFrame) -> DataFrame:
    """Expected against actual rows; no grid is built, counts are enough."""
    cells = df.groupBy("ci_name", "event_date_time").agg(F.count("*").alias("rows"))
    per_ts = cells.groupBy("event_date_time").agg(F.count("*").alias("items"), F.sum("rows").alias("rows"))
    n_ci = _fleet_size(df)
    totals = per_ts.withColumn("fleet", n_ci).agg(
        F.count("*").alias("n_timestamps"), F.max("fleet").alias("n_devices"), F.sum("rows").alias("n_rows"),
        F.sum("items").alias("cells"), F.count_if(F.col("items") < F.col("fleet")).alias("timestamps_with_missing"),
    )
    return totals.select(
        "n_timestamps", "n_devices",
        (F.col("n_timestamps") * F.col("n_devices")).alias("expected_rows"),
        "n_rows",
        (F.col("n_timestamps") * F.col("n_devices") - F.col("cells")).alias("missing_cells"),
        "timestamps_with_missing",
        (F.col("n_timestamps") * F.col("n_devices") == F.col("cells")).cast("int").alias("aligned"),
    )


def histogram(df: DataFrame, col: str, bins: int = 50) -> DataFrame:
    """Counts in equal-width bins; the last bin includes the maximum."""
    ends = df.agg(F.struct(F.min(col).alias("lo"), F.max(col).alias("hi"))).scalar()
    spaced = df.filter(F.col(col).isNotNull()).select(F.col(col).alias("v")).withColumn("e", ends)
    width = F.col("e.hi") - F.col("e.lo")
    pos = F.coalesce(F.floor(F.try_divide(F.col("v") - F.col("e.lo"), width) * bins), F.lit(0))
    return spaced.groupBy(F.least(pos, F.lit(bins - 1)).cast("int").alias("bin")).agg(F.count("*").alias("n"))


def null_report(df: DataFrame, cols: list[str] | None = None) -> DataFrame:
    """Null count and share of every column in one scan."""
    cols = cols or df.columns
    rows = [
        F.struct(F.lit(c).alias("column_name"), F.count_if(F.col(f"`{c}`").isNull()).alias("missing_values"),
                 F.count("*").alias("n"))
        for c in cols
    ]
    return df.agg(F.array(*rows).alias("r")).selectExpr("inline(r)").select(
        "column_name", "missing_values",
        F.coalesce(F.try_divide(F.col("missing_values") * 100.0, F.col("n")), F.lit(0.0)).alias("percentage"),
    )


def describe_values(df: DataFrame, cols: list[str]) -> DataFrame:
    """Count, mean, deviation, extremes and exact quartiles per column."""
    q = exact_quantiles(df, cols, [0.25, 0.5, 0.75])
    rows = [
        F.struct(
            F.lit(c).alias("column_name"), F.count(c).alias("n"), F.avg(c).alias("mean"),
            F.stddev_samp(c).alias("std"), F.min(c).cast("double").alias("min"),
            *[F.lit(v).cast("double").alias(a) for v, a in zip(q[c], ("p25", "p50", "p75"))],
            F.max(c).cast("double").alias("max"),
        )
        for c in cols
    ]
    return df.agg(F.array(*rows).alias("r")).selectExpr("inline(r)")


def value_counts(df: DataFrame, col: str) -> DataFrame:
    return df.groupBy(F.col(col).alias("value")).agg(F.count("*").alias("n"))


def distinct_dates(df: DataFrame) -> DataFrame:
    pairs = df.select("ci_name", "event_date_time").distinct()
    return pairs.groupBy("ci_name").agg(F.count("*").alias("distinct_dates"))


def fill_from_site(df: DataFrame, cols: list[str], site: str = "site_name") -> DataFrame:
    """Fill nulls with the site's most frequent value, then the fleet's; ties take the smallest.

    Everything derives from one count per combination of site and values, so the
    readings are grouped once. The fleet's value counts rows already filled by site.
    """
    combos = df.groupBy(site, *cols).agg(F.count("*").alias("n"))
    out = df
    for c in cols:
        counts = combos.groupBy(site, c).agg(F.sum("n").alias("n"))
        most = F.min_by(c, F.struct(-F.col("n"), F.col(c)))
        by_site = (
            counts.filter(F.col(c).isNotNull() & F.col(site).isNotNull())
            .groupBy(site).agg(most.alias("_site_value"))
        )
        filled = counts.join(by_site, site, "left").groupBy(
            F.coalesce(c, "_site_value").alias(c)).agg(F.sum("n").alias("n"))
        fleet = filled.filter(F.col(c).isNotNull()).agg(most).scalar()
        out = (
            lookup_join(out, by_site, site)
            .withColumn(c, F.coalesce(c, "_site_value", fleet))
            .drop("_site_value")
        )
    return out.select(df.columns)
