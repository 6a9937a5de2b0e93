import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from pulsegrid.functions.quantiles import exact_quantiles
from pulsegrid.functions.stats import safe_corr, sample_kurtosis, sample_skew
from pulsegrid.operators import features as X, prepare as P, series_kernels as K
from pulsegrid.functions import kernels as N


@pytest.mark.parametrize("limit", [20, 1_000_000])
def test_exact_quantiles(spark, limit):
    rng = np.random.default_rng(3)
    pdf = pd.DataFrame({"a": rng.exponential(1, 5000), "b": rng.integers(0, 4, 5000).astype(float), "c": [1.0] * 5000})
    pdf.loc[::7, "a"] = np.nan
    df = spark.createDataFrame(pdf).replace(float("nan"), None)
    probs = [0, 0.1, 0.25, 0.5, 0.9, 0.999, 1]
    got = exact_quantiles(df, ["a", "b", "c"], probs, in_memory=limit)
    for c in pdf:
        assert np.allclose(got[c], pdf[c].quantile(probs))


def test_exact_quantiles_of_two_repeated_values(spark):
    """More copies of two neighbouring values than are held in memory: a bracket between them cannot be halved."""
    v = F.when(F.col("id") < 500, 1.0).otherwise(2.0)
    df = spark.range(1000).select(v.alias("a"), F.when(F.col("id") % 4 > 0, v).alias("b"), (F.col("id") % 3).alias("c"))
    got = exact_quantiles(df, ["a", "b", "c"], [0.25, 0.5, 0.75], in_memory=20)
    assert got == {"a": [1.0, 1.5, 2.0], "b": [1.0, 1.5, 2.0], "c": [0.0, 1.0, 2.0]}


def test_exact_quantiles_empty(spark):
    df = spark.createDataFrame([(None,)], "a double")
    assert exact_quantiles(df, ["a"], [0.5]) == {"a": [None]}


def _series(spark, values, name="CI-1"):
    t0 = pd.Timestamp("2025-01-01")
    rows = [(name, (t0 + pd.Timedelta(hours=i)).to_pydatetime(), None if v is None else float(v)) for i, v in enumerate(values)]
    return spark.createDataFrame(rows, "ci_name string, event_date_time timestamp_ntz, event_value double")


@pytest.fixture(scope="module")
def wave(spark):
    rng = np.random.default_rng(5)
    v = 40 + 20 * np.sin(np.arange(400) * 2 * np.pi / 24) + rng.normal(0, 6, 400) + np.arange(400) * 0.03
    b = X.base(_series(spark, v)).persist()
    scaled = 100 * (v - v.min()) / (v.max() - v.min())
    return b, pd.Series(scaled)


def test_moments_match_pandas(spark, wave):
    b, s = wave
    r = X.basic(b).first()
    assert r["skewness"] == pytest.approx(s.skew()) and r["kurtosis"] == pytest.approx(s.kurt())
    assert r["mad"] == pytest.approx((s - s.median()).abs().median())
    a = X.trend_acf(b).first()
    for k in X.ACF_LAGS:
        assert a[f"acf_lag{k}"] == pytest.approx(s.autocorr(k))
    q, slope, icpt = np.polyfit(range(len(s)), s, 2)[0], *np.polyfit(range(len(s)), s, 1)
    assert a["quad_coeff"] == pytest.approx(q) and a["trend_slope"] == pytest.approx(slope)
    assert a["trend_intercept"] == pytest.approx(icpt)


def test_rolling_matches_pandas(wave):
    b, s = wave
    r = X.rolling(b).first()
    for k in X.ROLL_WINDOWS:
        w = s.rolling(k)
        assert r[f"roll_mean_{k}h"] == pytest.approx(w.mean().mean())
        assert r[f"roll_std_{k}h"] == pytest.approx(w.std().mean())
        assert r[f"roll_q25_{k}h"] == pytest.approx(w.quantile(0.25).mean())
        assert r[f"roll_skew_{k}h"] == pytest.approx(s.rolling(k, min_periods=3).skew().mean())
        if k > 3:
            assert r[f"roll_kurt_{k}h"] == pytest.approx(s.rolling(k, min_periods=4).kurt().mean())


def test_peaks_plateau(spark):
    v = [0, 0, 9, 9, 9, 0, 0, 0, 0, 0, 0, 0, 0, 0, 0, 8, 0, 0, 0, 0, 0, 0, 0, 0, 0, 0, 0, 0, 0, 0, 0, 0]
    r = X.peaks(X.base(_series(spark, v))).first()
    assert r["num_peaks"] == 2 and r["mean_peak_interval"] == 12


def test_decomposition_recovers_shape(spark):
    i = np.arange(240)
    v = 2.0 * i + 30 * np.sin(2 * np.pi * i / 24)
    b = X.base(_series(spark, v))
    r = X.seasonal(b).first()
    assert r["var_resid"] == pytest.approx(0, abs=1e-12) and r["seasonal_var_ratio"] > 0


def test_constant_and_short_series(spark):
    flat = X.base(_series(spark, [5.0] * 60))
    for f in X.SQL_FEATURES:
        assert f(flat).count() <= 1
    assert X.basic(flat).first()["skewness"] is None
    assert X.trend_acf(flat).first()["acf_lag1"] is None
    assert K.kernel_table(flat).first()["dfa"] is None
    one = X.base(_series(spark, [5.0]))
    for f in X.SQL_FEATURES:
        f(one).collect()
    assert K.kernel_table(one).first()["sample_entropy"] is None


def test_null_and_duplicate_readings(spark):
    df = _series(spark, [1.0, None, 3.0]).union(_series(spark, [2.0]))
    assert [(r["rn"], r["x"]) for r in X.base(df).orderBy("rn").collect()] == [(0, 2.0), (1, 3.0)]


def test_safe_corr_constant_group(spark):
    df = spark.createDataFrame([(1, 1.0, 5.0), (1, 2.0, 5.0), (2, 1.0, 1.0), (2, 2.0, 3.0)], "g int, x double, y double")
    got = {r["g"]: r["c"] for r in df.groupBy("g").agg(safe_corr(F.col("x"), F.col("y")).alias("c")).collect()}
    assert got[1] is None and got[2] == pytest.approx(1)
    r = df.agg(sample_skew(F.col("y")).alias("s"), sample_kurtosis(F.col("y")).alias("k")).first()
    assert r["s"] == pytest.approx(pd.Series([5, 5, 1, 3]).skew()) and r["k"] == pytest.approx(pd.Series([5, 5, 1, 3.0]).kurt())


def test_kernels_on_known_signals():
    rng = np.random.default_rng(2)
    noise = rng.normal(size=4000)
    assert 0.4 < N.hurst(noise) < 0.6 and 0.4 < N.dfa(noise) < 0.6
    assert 1.4 < N.dfa(np.cumsum(noise)) < 1.6
    tone = np.sin(2 * np.pi * np.arange(2048) / 16)
    assert N.spectral(tone)["dominant_freq"] == pytest.approx(1 / 16)
    assert N.entropies(tone)["sample_entropy"] < N.entropies(noise[:2048])["sample_entropy"]
    c = N.canonical(tone)
    assert set(c) == set(N.CANONICAL) and c["CO_FirstMin_ac"] == 8 and c["PD_PeriodicityWang_th0_01"] == 15


def test_yeo_johnson_and_normal_scores(spark):
    rng = np.random.default_rng(4)
    df = spark.createDataFrame(pd.DataFrame({"a": rng.lognormal(0, 1, 800), "b": rng.normal(5, 2, 800)}))
    out = P.power_transform(df, ["a", "b"]).toPandas()
    assert abs(out["a"].skew()) < 0.2 and out["a"].std(ddof=0) == pytest.approx(1)
    q = P.quantile_normal(df, ["a"]).toPandas()["a"]
    assert abs(q.skew()) < 0.1 and q.std() == pytest.approx(1, abs=0.1)
    assert P.normal_quantile(np.array([0.5, 0.975]))[1] == pytest.approx(1.959964, abs=1e-6)


def test_isolation_forest_finds_the_odd_rows(spark):
    rng = np.random.default_rng(6)
    x = rng.normal(size=(400, 3))
    x[:10] += 12
    df = spark.createDataFrame([(i, *map(float, r)) for i, r in enumerate(x)], "id int, a double, b double, c double")
    worst = [r["id"] for r in P.isolation_scores(df, "id", ["a", "b", "c"]).orderBy(F.desc("anomaly")).limit(10).collect()]
    assert set(worst) == set(range(10))
    assert P.drop_outliers(df, "id", ["a", "b", "c"]).count() == 380


def test_no_value_is_lost_to_nan():
    assert N.spectral(np.ones(50))["spectral_entropy"] is None
    # five templates that have a third value: (1,2) three times and (2,1) twice, so 3 + 1 pairs
    assert N.entropies(np.array([1.0, 2.0, 1.0, 2.0, 1.0, 2.0, 1.0]))["matches_2"] == 4


def test_plans_for_quantiles_do_not_grow_with_the_columns(spark, monkeypatch):
    rng = np.random.default_rng(7)
    x = rng.normal(size=(700, 30)).round(2)
    rows = [tuple(None if (i + c) % (c + 3) == 0 and c < 5 else float("nan") if c == 6 and i < 400 else float(v) for c, v in enumerate(r)) for i, r in enumerate(x)]
    df = spark.createDataFrame(rows, ", ".join(f"c{c} double" for c in range(30))).withColumn("none", F.lit(None).cast("double")).persist()
    width, agg = [], type(df).agg
    monkeypatch.setattr(type(df), "agg", lambda self, *e: width.append(len(e)) or agg(self, *e))
    got = exact_quantiles(df, df.columns, [0.1, 0.5], in_memory=50)
    assert max(width, default=0) <= 3 and got["none"] == [None, None]
    for c in range(30):
        own = np.sort([r[c] for r in rows if r[c] is not None])
        for p, v in zip((0.1, 0.5), got[f"c{c}"]):
            at = p * (len(own) - 1)
            want = own[int(at)] + (own[int(np.ceil(at))] - own[int(at)]) * (at % 1)
            assert v == pytest.approx(want, nan_ok=True)


def test_powers_are_the_most_likely_ones(spark):
    rng = np.random.default_rng(8)
    cols = {"a": rng.lognormal(size=500), "b": -rng.lognormal(size=500), "c": rng.normal(size=500) * 3, "same": np.full(500, 0.1), "gaps": rng.gamma(2, size=500)}
    rows = [tuple(None if c == "gaps" and i % 3 else float(v[i]) for c, v in cols.items()) + (None,) for i in range(500)]
    df = spark.createDataFrame(rows, ", ".join(f"{c} double" for c in cols) + ", none double").repartition(7).persist()
    got = P.power_lambdas(df, df.columns)
    assert got["same"] == got["none"] == 1.0
    for c in ("a", "b", "c", "gaps"):
        x = cols[c][::3] if c == "gaps" else cols[c]

        def like(lam):
            up = np.log1p(np.abs(x)) if abs(lam) < 1e-9 else ((np.abs(x) + 1) ** lam - 1) / lam
            two = 2 - lam
            down = -np.log1p(np.abs(x)) if abs(two) < 1e-9 else -((1 + np.abs(x)) ** two - 1) / two
            return -len(x) / 2 * np.log(np.where(x >= 0, up, down).var()) + (lam - 1) * (np.sign(x) * np.log1p(np.abs(x))).sum()

        fine = np.arange(got[c] - 0.3, got[c] + 0.3, 1e-3)
        assert abs(fine[np.argmax([like(v) for v in fine])] - got[c]) <= 2e-3
    assert P.power_lambdas(df.limit(0), ["a"]) == {"a": 1.0}
