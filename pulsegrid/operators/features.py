"""Per-series features that built-in aggregates and window functions express.

Every function takes ``base(df)``: one row per item and hour, so the largest
group is the number of hours in the study period whatever the raw data holds.
All group and window keys start with ``ci_name``; once ``base`` is partitioned
by it, none of the features below adds another shuffle of readings.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window, WindowSpec, functions as F

from pulsegrid.functions.calendar import week_start
from pulsegrid.functions.stats import positive_ratio, safe_corr, sample_kurtosis, sample_skew
from pulsegrid.operators.rollup import hourly_grain

ROLL_WINDOWS = (3, 6, 12, 24)
EPISODE_LEVELS = (50, 75, 90, 95)
EXCEED_LEVELS = (50, 60, 70, 80, 90, 95)
ACF_LAGS = (1, 2, 3, 7, 12, 24)
PERIOD = 24
PERCENTS = (1, 5, 10, 25, 50, 75, 90, 95, 99)


def _item() -> WindowSpec:
    return Window.partitionBy("ci_name")


def _ordered() -> WindowSpec:
    return _item().orderBy("rn")


def base(df: DataFrame) -> DataFrame:
    """``x`` raw, ``v`` scaled to 0-100 within the item (raw if constant), ``rn`` from 0."""
    w = _item()
    grain = hourly_grain(df.filter(F.col("event_value").isNotNull()))
    lo, hi, x = F.min("event_value").over(w), F.max("event_value").over(w), F.col("event_value")
    return grain.select(
        "ci_name", "event_date_time", x.alias("x"),
        F.when(hi > lo, 100 * (x - lo) / (hi - lo)).otherwise(x).alias("v"),
        (F.row_number().over(w.orderBy("event_date_time")) - 1).alias("rn"),
        F.count("*").over(w).alias("n"),
    )


def basic(b: DataFrame) -> DataFrame:
    v = F.col("v")
    med = F.percentile("v", 0.5).over(_item())
    q = F.percentile("v", [0.25, 0.5, 0.75])
    mean, std, power = F.avg(v), F.stddev_pop(v), F.avg(v * v)
    return b.withColumn("dev", F.abs(v - med)).groupBy("ci_name").agg(
        mean.alias("mean"), std.alias("std"), F.min(v).alias("min"), F.max(v).alias("max"),
        q[1].alias("median"), (q[2] - q[0]).alias("iqr"),
        sample_skew(v).alias("skewness"), sample_kurtosis(v).alias("kurtosis"),
        (F.max(v) - F.min(v)).alias("range"), positive_ratio(std, mean).alias("cv"),
        F.percentile("dev", 0.5).alias("mad"), F.sum(v * v).alias("energy"), F.sqrt(power).alias("rms"),
        F.when(power > 0, F.max(F.abs(v)) / F.sqrt(power)).alias("crest_factor"),
    )


def percentiles(b: DataFrame) -> DataFrame:
    p = b.groupBy("ci_name").agg(F.percentile("v", [k / 100 for k in PERCENTS]).alias("p"))
    at = {k: F.col("p")[i] for i, k in enumerate(PERCENTS)}
    return p.select(
        "ci_name",
        *[at[k].alias(f"load_{k}p") for k in (10, 25, 50, 75, 90, 95, 99)],
        *[at[k].alias(f"asym_{k}p") for k in (1, 5, 25, 50, 75, 95, 99)],
        *[positive_ratio(at[a], at[c]).alias(f"ratio_{a}_{c}") for a, c in ((75, 25), (90, 10), (95, 5), (99, 1))],
    )


def rolling(b: DataFrame) -> DataFrame:
    """Means over time of trailing-window statistics. The 3-row kurtosis never exists."""
    cols: dict[str, Column] = {}
    v = F.col("v")
    for k in ROLL_WINDOWS:
        f = _ordered().rowsBetween(1 - k, 0)
        c = F.count(v).over(f)
        full = lambda e, c=c, k=k: F.when(c == k, e)
        q = F.percentile(v, [0.25, 0.5, 0.75]).over(f)
        cols[f"roll_slope_{k}h"] = F.when(c >= 2, F.regr_slope(v, F.col("rn")).over(f))
        cols[f"roll_std_{k}h"] = full(F.stddev_samp(v).over(f))
        cols[f"roll_mean_{k}h"] = full(F.avg(v).over(f))
        cols[f"roll_median_{k}h"] = full(q[1])
        cols[f"roll_q25_{k}h"] = full(q[0])
        cols[f"roll_q75_{k}h"] = full(q[2])
        cols[f"roll_skew_{k}h"] = sample_skew(v, f)
        if k > 3:
            cols[f"roll_kurt_{k}h"] = sample_kurtosis(v, f)
    return b.withColumns(cols).groupBy("ci_name").agg(*[F.avg(c).alias(c) for c in cols])


def _with_diffs(b: DataFrame) -> DataFrame:
    w = _ordered()
    d = F.col("v") - F.lag("v", 1).over(w)
    d2 = F.col("v") - 2 * F.lag("v", 1).over(w) + F.lag("v", 2).over(w)
    return b.withColumns({"d": d, "d2": d2, "prev_v": F.lag("v", 1).over(w)})


def diffs(b: DataFrame) -> DataFrame:
    d, d2 = F.col("d"), F.col("d2")
    q = F.percentile("d", [0.25, 0.75])
    return _with_diffs(b).groupBy("ci_name").agg(
        F.avg(F.abs(d)).alias("mean_abs_diff"), F.stddev_pop(d).alias("std_diff"),
        F.percentile(F.abs(d), 0.5).alias("median_abs_diff"),
        F.max(F.abs(d)).alias("max_abs_diff"), F.min(F.abs(d)).alias("min_abs_diff"),
        (q[1] - q[0]).alias("diff_iqr"),
        F.avg(F.abs(d2)).alias("mean_abs_diff2"), F.stddev_pop(d2).alias("std_diff2"),
        F.max(F.abs(d2)).alias("max_abs_diff2"),
    )


def episodes(b: DataFrame) -> DataFrame:
    """Stretches above each level. The running index of the last reading at or below
    the level gives the current stretch length, so no second grouping is needed."""
    cols, aggs = {}, []
    v, before = F.col("v"), _ordered().rowsBetween(Window.unboundedPreceding, 0)
    for t in EPISODE_LEVELS:
        last_low = F.max(F.when(v <= t, F.col("rn"))).over(before)
        cols[f"len_{t}"] = F.when(v > t, F.col("rn") - F.coalesce(last_low, F.lit(-1)))
    for t in EPISODE_LEVELS:
        run = F.col(f"len_{t}")
        above, starts = F.count(run), F.count_if(run == 1)
        aggs += [
            F.coalesce(F.try_divide(above, starts), F.lit(0.0)).alias(f"avg_duration_above_{t}"),
            F.coalesce(F.max(run), F.lit(0)).alias(f"max_duration_above_{t}"),
            starts.alias(f"num_episodes_above_{t}"),
            (above / F.count("*") * 100).alias(f"pct_time_above_{t}"),
        ]
    return b.withColumns(cols).groupBy("ci_name").agg(*aggs)


def hjorth(b: DataFrame) -> DataFrame:
    mean = F.avg("v").over(_item())
    prev, v = F.col("prev_v"), F.col("v")
    crossed = lambda a, c: F.count_if(a * c < 0) / F.count("*")
    act, va, vb = F.var_pop("v"), F.var_pop("d"), F.var_pop("d2")
    out = _with_diffs(b).withColumn("m", mean).groupBy("ci_name").agg(
        act.alias("hjorth_activity"),
        F.when(act > 0, F.sqrt(va / act)).alias("hjorth_mobility"),
        va.alias("va"), vb.alias("vb"),
        crossed(prev, v).alias("zero_crossing_rate"),
        crossed(prev - F.col("m"), v - F.col("m")).alias("mean_crossing_rate"),
    )
    mob = F.col("hjorth_mobility")
    complexity = F.when((mob > 0) & (F.col("va") > 0), F.sqrt(F.col("vb") / F.col("va")) / mob)
    return out.withColumn("hjorth_complexity", complexity).drop("va", "vb")


def exceedances(b: DataFrame) -> DataFrame:
    """Readings above each level per day and per ISO week number, averaged and at most.

    Weeks are summed from the per-day counts, so readings are scanned once.
    """
    day = F.to_date("event_date_time")
    counts = b.groupBy("ci_name", day.alias("day")).agg(
        *[F.count_if(F.col("v") > t).alias(f"c{t}") for t in EXCEED_LEVELS])
    weeks = counts.groupBy("ci_name", F.weekofyear("day").alias("week")).agg(
        *[F.sum(f"c{t}").alias(f"w{t}") for t in EXCEED_LEVELS],
        *[F.sum(f"c{t}").alias(f"s{t}") for t in EXCEED_LEVELS],
        *[F.max(f"c{t}").alias(f"m{t}") for t in EXCEED_LEVELS], F.count("*").alias("days"))
    aggs = []
    for t in EXCEED_LEVELS:
        aggs += [
            (F.sum(f"s{t}") / F.sum("days")).alias(f"avg_daily_exceed_{t}pct"),
            F.max(f"m{t}").alias(f"max_daily_exceed_{t}pct"),
            F.avg(f"w{t}").alias(f"avg_weekly_exceed_{t}pct"),
            F.max(f"w{t}").alias(f"max_weekly_exceed_{t}pct"),
        ]
    return weeks.groupBy("ci_name").agg(*aggs)


def day_night(b: DataFrame) -> DataFrame:
    """Day against night and weekday against weekend; null unless both sides have readings."""
    hour = F.hour("event_date_time")
    sides = {
        ("day", "night"): (hour >= 8) & (hour < 20),
        ("weekday", "weekend"): F.weekday("event_date_time") < 5,
    }
    aggs: list[Column] = []
    for (a, z), is_a in sides.items():
        va, vz = F.when(is_a, F.col("v")), F.when(~is_a, F.col("v"))
        both = (F.count(va) > 0) & (F.count(vz) > 0)
        ma, mz = F.avg(va), F.avg(vz)
        for name, e in {
            f"{a}_mean": ma, f"{z}_mean": mz, f"{a}_std": F.stddev_pop(va), f"{z}_std": F.stddev_pop(vz),
            f"{a}_{z}_ratio": positive_ratio(ma, mz), f"{a}_{z}_diff": ma - mz,
        }.items():
            aggs.append(F.when(both, e).alias(name))
    return b.groupBy("ci_name").agg(*aggs)


_FOUR = ("mean", "std", "max", "min")


def _four(col: str) -> list[Column]:
    return [F.avg(col).alias("mean"), F.stddev_pop(col).alias("std"), F.max(col).alias("max"), F.min(col).alias("min")]


def _spread(df: DataFrame, key: str, size: int, prefix: str, stats: tuple[str, ...]) -> DataFrame:
    """Pivot with listed values: one column per key value and statistic, no extra job."""
    wide = df.groupBy("ci_name").pivot(key, list(range(size))).agg(*[F.first(s).alias(s) for s in stats])
    return wide.select("ci_name", *[
        F.col(f"{i}_{s}" if len(stats) > 1 else f"{i}").alias(f"{prefix}_{i}_{s}") for i in range(size) for s in stats])


def hour_dow(b: DataFrame) -> DataFrame:
    """Hour-of-day statistics of scaled and raw values and weekday statistics of raw values."""
    by_hour = b.groupBy("ci_name", F.hour("event_date_time").alias("h"))
    dow = b.groupBy("ci_name", F.weekday("event_date_time").alias("d")).agg(*_four("x"))
    dow = dow.withColumn("range", F.col("max") - F.col("min"))
    return (
        _spread(by_hour.agg(*_four("v")), "h", 24, "hour", _FOUR)
        .join(_spread(by_hour.agg(*_four("x")), "h", 24, "hour_raw", _FOUR), "ci_name")
        .join(_spread(dow, "d", 7, "dow", (*_FOUR, "range")), "ci_name")
    )


def weeks_long(b: DataFrame) -> DataFrame:
    """Raw statistics per item and calendar week, in long form."""
    return b.groupBy("ci_name", week_start(F.col("event_date_time")).alias("week_start")).agg(
        F.avg("x").alias("mean"), F.min("x").alias("min"), F.max("x").alias("max"),
        F.stddev_pop("x").alias("std"), F.percentile("x", 0.5).alias("median"))


def weeks_wide(b: DataFrame, weeks: int) -> DataFrame:
    """The same as ``week_{i}_*`` columns, ``i`` counting an item's weeks in calendar order."""
    w = _item().orderBy("week_start")
    long = weeks_long(b).withColumn("i", F.row_number().over(w) - 1)
    return _spread(long, "i", weeks, "week", ("mean", "min", "max", "std", "median"))


def profile(b: DataFrame) -> DataFrame:
    """Mean day and week shapes, their shares and night and weekend ratios."""
    hours = b.groupBy("ci_name", F.hour("event_date_time").alias("h")).agg(F.avg("v").alias("mean"))
    days = b.groupBy("ci_name", F.weekday("event_date_time").alias("d")).agg(F.avg("v").alias("mean"))
    wide = _spread(hours, "h", 24, "p", ("mean",)).join(_spread(days, "d", 7, "q", ("mean",)), "ci_name")
    hour = [F.coalesce(F.col(f"p_{i}_mean"), F.lit(0.0)) for i in range(24)]
    day = [F.coalesce(F.col(f"q_{i}_mean"), F.lit(0.0)) for i in range(7)]
    wide = wide.select("ci_name", *[c.alias(f"avg_hour_{i}") for i, c in enumerate(hour)],
                       *[c.alias(f"avg_day_{i}") for i, c in enumerate(day)])
    total = lambda name, ids: sum((F.col(f"{name}_{i}") for i in ids), F.lit(0.0))
    hour_sum, day_sum = total("avg_hour", range(24)), total("avg_day", range(7))
    night, light = total("avg_hour", [*range(8), *range(20, 24)]), total("avg_hour", range(8, 20))
    return wide.select(
        "*",
        *[positive_ratio(F.col(f"avg_hour_{i}"), hour_sum).alias(f"avg_hour_norm_{i}") for i in range(24)],
        *[positive_ratio(F.col(f"avg_day_{i}"), day_sum).alias(f"avg_day_norm_{i}") for i in range(7)],
        (night / (light + 1e-6)).alias("night_day_ratio"),
        (total("avg_day", (5, 6)) / (total("avg_day", range(5)) + 1e-6)).alias("weekend_week_ratio"),
    )


def trend_acf(b: DataFrame) -> DataFrame:
    """Line, curvature and autocorrelations.

    Positions are equally spaced, so the squared distance from the middle is
    uncorrelated with the position and one regression gives the quadratic term.
    """
    w = _ordered()
    lagged = b.withColumns({f"lag{k}": F.lag("v", k).over(w) for k in ACF_LAGS})
    mid = F.col("rn") - (F.col("n") - 1) / 2
    v, n = F.col("v"), F.count("*")
    return lagged.groupBy("ci_name").agg(
        F.when(n > 1, F.regr_slope(v, F.col("rn"))).alias("trend_slope"),
        F.when(n > 1, F.regr_intercept(v, F.col("rn"))).alias("trend_intercept"),
        F.when(n > 2, F.regr_slope(v, mid * mid)).alias("quad_coeff"),
        *[F.when(n > k, safe_corr(v, F.col(f"lag{k}"))).alias(f"acf_lag{k}") for k in ACF_LAGS],
    )


def static_first(df: DataFrame, cols: list[str]) -> DataFrame:
    """Attributes of each item's earliest reading, null included."""
    return df.groupBy("ci_name").agg(*[F.min_by(c, "event_date_time").alias(c) for c in cols])


def peaks(b: DataFrame) -> DataFrame:
    """Local maxima at least two deviations above the mean; a plateau counts once, at its middle."""
    w, it = _ordered(), _item()
    change = F.when(F.lag("v").over(w) == F.col("v"), 0).otherwise(1)
    marked = b.withColumns({"change": change, "level": F.avg("v").over(it) + 2 * F.stddev_pop("v").over(it)})
    runs = (
        marked.withColumn("run", F.sum("change").over(w))
        .groupBy("ci_name", "run")
        .agg(F.first("v").alias("v"), F.first("level").alias("level"),
             F.floor((F.min("rn") + F.max("rn")) / 2).alias("at"))
    )
    o = it.orderBy("run")
    found = runs.withColumn(
        "is_peak", (F.lag("v").over(o) < F.col("v")) & (F.lead("v").over(o) < F.col("v")) & (F.col("v") >= F.col("level")))
    only = found.withColumns({"h": F.when(F.col("is_peak"), F.col("v")), "p": F.when(F.col("is_peak"), F.col("at"))})
    last = F.last("p", ignorenulls=True).over(o.rowsBetween(Window.unboundedPreceding, -1))
    stepped = only.withColumn("step", F.col("p") - last)
    h, s, k = F.col("h"), F.col("step"), F.count("h")
    many = lambda e: F.when(k >= 2, e)
    return stepped.groupBy("ci_name").agg(
        k.alias("num_peaks"), F.coalesce(F.avg(h), F.lit(0.0)).alias("avg_peak_height"),
        many(F.avg(s)).alias("mean_peak_interval"), many(F.stddev_pop(s)).alias("std_peak_interval"),
        many(F.min(s)).alias("min_peak_interval"), many(F.max(s)).alias("max_peak_interval"),
        many(F.max(h)).alias("max_peak_height"), many(F.min(h)).alias("min_peak_height"),
        many(F.max(h) - F.min(h)).alias("peak_height_range"),
        many(F.when(F.avg(h) > 0, F.stddev_pop(h) / F.avg(h)).otherwise(0.0)).alias("peak_height_cv"),
    )


def permutation_entropy(b: DataFrame, orders: tuple[int, ...] = (2, 3, 4, 5)) -> DataFrame:
    """Normalised entropy of the order patterns of consecutive values; ties rank by position."""
    w = _ordered()
    deepest = max(orders)
    lagged = b.withColumns({f"l{k}": F.lag("v", k).over(w) for k in range(deepest)})

    def pattern(m: int) -> Column:
        x = [F.col(f"l{m - 1 - i}") for i in range(m)]  # oldest first
        ranks = []
        for i in range(m):
            below = [(x[j] <= x[i] if j < i else x[j] < x[i]).cast("int") for j in range(m) if j != i]
            ranks.append(sum(below[1:], below[0]).cast("string"))
        return F.struct(F.lit(m).alias("m"), F.when(F.col("rn") >= m - 1, F.concat(*ranks)).alias("pattern"))

    counted = (
        lagged.select("ci_name", F.explode(F.array(*[pattern(m) for m in orders])).alias("e"))
        .select("ci_name", "e.m", "e.pattern").filter("pattern IS NOT NULL")
        .groupBy("ci_name", "m", "pattern").agg(F.count("*").alias("c"))
        .groupBy("ci_name", "m").agg(F.sum("c").alias("n"), F.sum(F.col("c") * F.log2("c")).alias("s"))
    )
    bits = F.log2("n") - F.col("s") / F.col("n")
    name = {m: "perm_entropy" if m == 3 else f"perm_entropy_order{m}" for m in orders}
    return counted.withColumn("h", bits).groupBy("ci_name").agg(*[
        F.max(F.when(F.col("m") == m, F.col("h") / math.log2(math.factorial(m)))).alias(name[m]) for m in orders])


def seasonal(b: DataFrame, period: int = PERIOD) -> DataFrame:
    """Additive decomposition: centred moving average, mean seasonal shape, remainder.

    Both ends of the trend continue the line through the nearest period of trend
    points. Null below two full periods.
    """
    half = period // 2
    w, it = _ordered(), _item()
    rn, n = F.col("rn"), F.col("n")
    inside = (rn >= half) & (rn <= n - 1 - half)
    wide = F.sum("v").over(w.rowsBetween(-half, half))
    edges = (F.lag("v", half).over(w) + F.lead("v", half).over(w)) / 2
    out = b.filter(n >= 2 * period).withColumn("mid", F.when(inside, (wide - edges) / period))
    back = n - 1 - half
    head = F.when((rn >= half) & (rn < F.least(F.lit(half + period), back)), F.col("mid"))
    tail = F.when((rn >= F.greatest(F.lit(half), back - period)) & (rn < back), F.col("mid"))
    line = lambda y: F.regr_slope(y, rn).over(it) * rn + F.regr_intercept(y, rn).over(it)
    out = out.withColumns({"head": line(head), "tail": line(tail)})
    trend = F.when(rn < half, F.col("head")).when(rn > back, F.col("tail")).otherwise(F.col("mid"))
    out = out.withColumn("trend", trend).withColumn("phase", rn % period)
    out = out.withColumn("shape", F.avg(F.col("v") - F.col("trend")).over(Window.partitionBy("ci_name", "phase")))
    centre = F.avg(F.when(rn < period, F.col("shape"))).over(it)
    out = out.withColumn("seasonal", F.col("shape") - centre)
    out = out.withColumn("resid", F.col("v") - F.col("trend") - F.col("seasonal"))
    aggs = [f(c).alias(f"{p}_{c}") for c in ("trend", "seasonal", "resid")
            for p, f in (("var", F.var_pop), ("mean", F.avg))]
    for c in ("trend", "seasonal"):
        aggs += [F.max(c).alias(f"max_{c}"), F.min(c).alias(f"min_{c}"), (F.max(c) - F.min(c)).alias(f"{c}_range")]
    out = out.groupBy("ci_name").agg(*aggs)
    total = F.col("var_trend") + F.col("var_seasonal") + F.col("var_resid")
    return out.withColumns(
        {f"{c}_var_ratio": positive_ratio(F.col(f"var_{c}"), total) for c in ("trend", "seasonal", "resid")})


def higuchi(b: DataFrame, kmax: int = 10) -> DataFrame:
    """Fractal dimension: slope of log curve length against log inverse step."""
    w = _ordered()
    stepped = b.withColumns({f"d{k}": F.abs(F.col("v") - F.lag("v", k).over(w)) for k in range(1, kmax + 1)})
    steps = F.array(*[
        F.struct(F.lit(k).alias("k"), (F.col("rn") % k).alias("m"), F.col(f"d{k}").alias("d"))
        for k in range(1, kmax + 1)])
    k, c = F.col("k"), F.col("c")
    length = F.col("s") * (F.col("n") - 1) / (c * k) / k
    return (
        stepped.select("ci_name", "n", F.explode(steps).alias("e")).select("ci_name", "n", "e.*").filter("d IS NOT NULL")
        .groupBy("ci_name", "n", "k", "m").agg(F.sum("d").alias("s"), F.count("*").alias("c"))
        .withColumn("length", length)
        .groupBy("ci_name", "k").agg(F.avg("length").alias("l"))
        .groupBy("ci_name").agg(
            F.regr_slope(F.log(F.when(F.col("l") > 0, F.col("l"))), F.log(1.0 / k)).alias("fractal_dim_higuchi"))
    )


def canonical(b: DataFrame) -> DataFrame:
    """The canonical features that aggregates express, on z-scored values.

    Stretch lengths are distances between successive interruptions, the last
    usable position counting as one, as in the published implementation.
    """
    it, w = _item(), _ordered()
    z = F.try_divide(F.col("v") - F.avg("v").over(it), F.stddev_samp("v").over(it))
    lags = {"p1": F.lag("z", 1).over(w), "p2": F.lag("z", 2).over(w), "p3": F.lag("z", 3).over(w),
            "nx": F.lead("z", 1).over(w), "lo": F.min("z").over(it), "hi": F.max("z").over(it)}
    out = b.withColumn("z", z).filter("z IS NOT NULL").withColumns(lags)
    last = F.col("rn") == F.col("n") - 2
    usable = F.col("rn") <= F.col("n") - 2
    cut_mean = usable & ((F.col("z") <= 0) | last)
    cut_rise = usable & ((F.col("nx") >= F.col("z")) | last)
    before = w.rowsBetween(Window.unboundedPreceding, -1)
    stretch = lambda cut: F.when(
        cut, F.col("rn") - F.coalesce(F.max(F.when(cut, F.col("rn"))).over(before), F.lit(0)))
    step = (F.col("hi") - F.col("lo") + 0.2) / 5
    bin_of = lambda c: F.floor((F.col(c) - F.col("lo") + 0.1) / step)
    out = out.withColumns({
        "s1": stretch(cut_mean), "s0": stretch(cut_rise), "d": F.col("z") - F.col("p1"),
        "e3": F.col("z") - (F.col("p1") + F.col("p2") + F.col("p3")) / 3,
        "ba": F.when(F.col("rn") >= 2, bin_of("p2")), "bb": F.when(F.col("rn") >= 2, bin_of("z")),
    })
    d = F.col("d")
    simple = out.groupBy("ci_name").agg(
        F.max("s1").cast("double").alias("SB_BinaryStats_mean_longstretch1"),
        F.max("s0").cast("double").alias("SB_BinaryStats_diff_longstretch0"),
        F.try_divide(F.count_if(F.abs(d) * 1000 > 40), F.count(d)).alias("MD_hrv_classic_pnn40"),
        F.avg(d * d * d).alias("CO_trev_1_num"),
        F.stddev_samp("e3").alias("FC_LocalSimple_mean3_stderr"),
    )
    return (
        simple.join(_histogram_mode(out, 5), "ci_name", "left").join(_histogram_mode(out, 10), "ci_name", "left")
        .join(_histogram_ami(out), "ci_name", "left").join(_motif_three(out), "ci_name", "left")
    )


def _histogram_mode(z: DataFrame, bins: int) -> DataFrame:
    width = (F.col("hi") - F.col("lo")) / bins
    pos = F.least(F.floor((F.col("z") - F.col("lo")) / width), F.lit(bins - 1))
    counts = z.groupBy("ci_name", "lo", width.alias("width"), pos.alias("bin")).agg(F.count("*").alias("c"))
    top = F.max("c").over(_item())
    centre = F.col("lo") + (F.col("bin") + 0.5) * F.col("width")
    return (
        counts.withColumn("top", top).filter("c = top")
        .groupBy("ci_name").agg(F.avg(centre).alias(f"DN_HistogramMode_{bins}"))
    )


def _histogram_ami(z: DataFrame) -> DataFrame:
    cells = z.filter("ba IS NOT NULL").groupBy("ci_name", "ba", "bb").agg(F.count("*").alias("c"))
    ra = F.sum("c").over(Window.partitionBy("ci_name", "ba"))
    rb = F.sum("c").over(Window.partitionBy("ci_name", "bb"))
    n = F.sum("c").over(_item())
    return (
        cells.withColumns({"ra": ra, "rb": rb, "t": n}).groupBy("ci_name")
        .agg(F.sum(F.col("c") / F.col("t") * F.log(F.col("c") * F.col("t") / (F.col("ra") * F.col("rb"))))
             .alias("CO_HistogramAMI_even_2_5"))
    )


def _motif_three(z: DataFrame) -> DataFrame:
    """Entropy of letter pairs; letters are thirds by value, cut at midpoint quantiles."""
    rank = F.row_number().over(_item().orderBy("z"))
    ranked = z.withColumn("rank", rank)

    def cut(q: float) -> Column:
        at = F.col("n") * q - 0.5
        left = F.max(F.when(F.col("rank") == F.floor(at) + 1, F.col("z"))).over(_item())
        right = F.max(F.when(F.col("rank") == F.ceil(at) + 1, F.col("z"))).over(_item())
        return left + (at - F.floor(at)) * (right - left)

    letters = ranked.withColumns({"c1": cut(1 / 3), "c2": cut(2 / 3)})
    letter = F.when(F.col("z") <= F.col("c1"), 1).when(F.col("z") <= F.col("c2"), 2).otherwise(3)
    pairs = letters.withColumn("a", letter).withColumn("nxt", F.lead("a").over(_ordered()))
    total = F.sum("c").over(_item())
    return (
        pairs.filter("nxt IS NOT NULL").groupBy("ci_name", "a", "nxt").agg(F.count("*").alias("c"))
        .withColumn("t", total).groupBy("ci_name")
        .agg((-F.sum(F.col("c") / F.col("t") * F.log(F.col("c") / F.col("t")))).alias("SB_MotifThree_quantile_hh"))
    )


SQL_FEATURES = (basic, percentiles, rolling, diffs, episodes, hjorth, exceedances, day_night, hour_dow, profile,
                trend_acf, peaks, permutation_entropy, seasonal, higuchi, canonical)
