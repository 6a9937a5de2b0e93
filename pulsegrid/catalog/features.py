"""Per-series feature queries with their SQL."""

from __future__ import annotations

import math

from pyspark.sql import functions as F

from pulsegrid.catalog.duck import rounded as rnd, sql
from pulsegrid.catalog.util import rounded
from pulsegrid.operators import features as X, rollup as R, series_kernels as K
from pulsegrid.sources import views as V

STATIC = ["device_role", "site_criticality", "site_country", "Criticality_unknown"]


def _base(s, d):
    return X.base(V.type_hourly(s, d))


def _fleet_base(s, d):
    return X.base(V.poller(s, d).filter(F.col("event_type") == "in_bandwidth_pct"))


def _q(fn, src=_base):
    return lambda s, d: rounded(fn(src(s, d)))


QUERIES = {
    "fe_basic": _q(X.basic, _fleet_base),
    "fe_percentiles": _q(X.percentiles, _fleet_base),
    "fe_rolling": _q(X.rolling),
    "fe_diffs": _q(X.diffs, _fleet_base),
    "fe_episodes": _q(X.episodes),
    "fe_hjorth": _q(X.hjorth),
    "fe_exceed": _q(X.exceedances, _fleet_base),
    "fe_daynight": _q(X.day_night, _fleet_base),
    "fe_hour_dow": _q(X.hour_dow),
    "fe_week_long": _q(X.weeks_long),
    "fe_profile": _q(X.profile, _fleet_base),
    "fe_trend_acf": _q(X.trend_acf),
    "fe_static": lambda s, d: X.static_first(R.unknown_criticality(V.poller(s, d)), STATIC),
    "fe_peaks": _q(X.peaks),
    "fe_perm_entropy": _q(X.permutation_entropy),
    "fe_seasonal": _q(X.seasonal),
    "fe_higuchi": _q(X.higuchi),
    "fe_canonical_sql": _q(X.canonical),
    "fe_sample_entropy": _q(K.entropies),
    "fe_corr_dim_counts": lambda s, d: rounded(K.dimension_counts(_base(s, d))),
    "fe_corr_dim": lambda s, d: rounded(K.dimension(K.dimension_counts(_base(s, d)))),
    "fe_welch": _q(K.welch),
    "fe_hurst_dfa": _q(K.scaling),
    "fe_canonical_kernel": _q(K.canonical),
}


def _base_cte(source: str) -> str:
    return f"""b AS (SELECT ci_name, event_date_time, x, CASE WHEN mx > mn THEN 100 * (x - mn) / (mx - mn) ELSE x END AS v, rn, n
  FROM (SELECT *, min(x) OVER (PARTITION BY ci_name) AS mn, max(x) OVER (PARTITION BY ci_name) AS mx,
    row_number() OVER (PARTITION BY ci_name ORDER BY event_date_time) - 1 AS rn, count(*) OVER (PARTITION BY ci_name) AS n
    FROM ({source})))"""


_TYPE = _base_cte("SELECT ci_name, event_date_time, event_value AS x FROM type_hourly")
_FLEET = _base_cte("""SELECT ci_name, CAST(date_trunc('hour', event_date_time) AS TIMESTAMP) AS event_date_time, max(event_value) AS x
  FROM poller WHERE event_type = 'in_bandwidth_pct' GROUP BY 1, 2""")
_OV = "OVER (PARTITION BY ci_name ORDER BY rn)"
_IT = "OVER (PARTITION BY ci_name)"
_DIFF = f"""dd AS (SELECT *, v - lag(v) {_OV} AS d, v - 2 * lag(v) {_OV} + lag(v, 2) {_OV} AS d2, lag(v) {_OV} AS pv,
  avg(v) {_IT} AS m FROM b)"""


def _r(expr: str, name: str, digits: int = 6) -> str:
    return f"round({expr}, {digits}) AS {name}"


def _pct(p: float, col: str = "v") -> str:
    return f"quantile_cont({col}, {p})"


def _guard(skew: str, least: int, std: str) -> str:
    return f"CASE WHEN {least} AND {std} > 1e-9 THEN {skew} END"


def _rolling_sql() -> str:
    inner, outer = [], []
    for k in X.ROLL_WINDOWS:
        o = f"OVER (PARTITION BY ci_name ORDER BY rn ROWS BETWEEN {k - 1} PRECEDING AND CURRENT ROW)"
        c = f"count(v) {o}"
        cells = {
            "slope": f"CASE WHEN {c} >= 2 THEN regr_slope(v, rn) {o} END",
            "std": f"CASE WHEN {c} = {k} THEN stddev_samp(v) {o} END",
            "mean": f"CASE WHEN {c} = {k} THEN avg(v) {o} END",
            "median": f"CASE WHEN {c} = {k} THEN quantile_cont(v, 0.5) {o} END",
            "q25": f"CASE WHEN {c} = {k} THEN quantile_cont(v, 0.25) {o} END",
            "q75": f"CASE WHEN {c} = {k} THEN quantile_cont(v, 0.75) {o} END",
            "skew": f"CASE WHEN {c} >= 3 AND stddev_pop(v) {o} > 1e-9 THEN skewness(v) {o} END",
        }
        if k > 3:
            cells["kurt"] = f"CASE WHEN {c} >= 4 AND stddev_pop(v) {o} > 1e-9 THEN kurtosis(v) {o} END"
        for name, e in cells.items():
            inner.append(f"{e} AS roll_{name}_{k}h")
            outer.append(_r(f"avg(roll_{name}_{k}h)", f"roll_{name}_{k}h"))
    return f"SELECT ci_name, {', '.join(outer)} FROM (SELECT ci_name, {', '.join(inner)} FROM b) GROUP BY 1"


def _episodes_sql() -> str:
    parts = []
    for t in X.EPISODE_LEVELS:
        parts.append(f"""SELECT ci_name, {t} AS t, coalesce(avg(len), 0) AS a, coalesce(max(len), 0) AS m, count(len) AS k, max(pct) AS pct FROM (
  SELECT ci_name, g, CASE WHEN up THEN count(*) END AS len, max(pct) AS pct FROM (
    SELECT ci_name, v > {t} AS up, rn - row_number() OVER (PARTITION BY ci_name, v > {t} ORDER BY rn) AS g,
      avg(CASE WHEN v > {t} THEN 100.0 ELSE 0 END) {_IT} AS pct FROM b) GROUP BY ci_name, g, up) GROUP BY 1""")
    cols = []
    for t in X.EPISODE_LEVELS:
        pick = lambda c, t=t: f"max(CASE WHEN t = {t} THEN {c} END)"
        cols += [_r(pick("a"), f"avg_duration_above_{t}"), f"{pick('m')} AS max_duration_above_{t}",
                 f"{pick('k')} AS num_episodes_above_{t}", _r(pick("pct"), f"pct_time_above_{t}")]
    return f"SELECT ci_name, {', '.join(cols)} FROM ({' UNION ALL '.join(parts)}) GROUP BY 1"


def _exceed_sql() -> str:
    day = ", ".join(f"count(*) FILTER (v > {t}) AS c{t}" for t in X.EXCEED_LEVELS)
    agg = lambda p: ", ".join(f"{_r(f'avg(c{t})', f'avg_{p}_exceed_{t}pct')}, max(c{t}) AS max_{p}_exceed_{t}pct" for t in X.EXCEED_LEVELS)
    return f"""SELECT * FROM (SELECT ci_name, {agg('daily')} FROM (SELECT ci_name, CAST(event_date_time AS DATE) AS g, {day} FROM b GROUP BY 1, 2) GROUP BY 1)
  JOIN (SELECT ci_name, {agg('weekly')} FROM (SELECT ci_name, weekofyear(event_date_time) AS g, {day} FROM b GROUP BY 1, 2) GROUP BY 1) USING (ci_name)"""


def _day_night_sql() -> str:
    cols = []
    for a, z, cond in (("day", "night", "hour(event_date_time) >= 8 AND hour(event_date_time) < 20"),
                       ("weekday", "weekend", "isodow(event_date_time) <= 5")):
        va, vz = f"FILTER ({cond})", f"FILTER (NOT ({cond}))"
        both = f"count(v) {va} > 0 AND count(v) {vz} > 0"
        ma, mz = f"(avg(v) {va})", f"(avg(v) {vz})"
        for name, e in {f"{a}_mean": ma, f"{z}_mean": mz, f"{a}_std": f"(stddev_pop(v) {va})", f"{z}_std": f"(stddev_pop(v) {vz})",
                        f"{a}_{z}_ratio": f"CASE WHEN {mz} > 0 THEN {ma} / {mz} END", f"{a}_{z}_diff": f"{ma} - {mz}"}.items():
            cols.append(_r(f"CASE WHEN {both} THEN {e} END", name))
    return f"SELECT ci_name, {', '.join(cols)} FROM b GROUP BY 1"


def _hour_dow_sql() -> str:
    cols = []
    fn = {"mean": "avg({c})", "std": "stddev_pop({c})", "max": "max({c})", "min": "min({c})", "range": "max({c}) - min({c})"}
    for prefix, col, key, size in (("hour", "v", "hour(event_date_time)", 24), ("hour_raw", "x", "hour(event_date_time)", 24),
                                   ("dow", "x", "isodow(event_date_time) - 1", 7)):
        for i in range(size):
            for st, f in fn.items():
                if st == "range" and prefix != "dow":
                    continue
                cols.append(_r(f.format(c=f"CASE WHEN {key} = {i} THEN {col} END"), f"{prefix}_{i}_{st}"))
    return f"SELECT ci_name, {', '.join(cols)} FROM b GROUP BY 1"


def _profile_sql() -> str:
    h = ", ".join(f"coalesce(avg(v) FILTER (hour(event_date_time) = {i}), 0) AS avg_hour_{i}" for i in range(24))
    w = ", ".join(f"coalesce(avg(v) FILTER (isodow(event_date_time) = {i + 1}), 0) AS avg_day_{i}" for i in range(7))
    hs, ds = " + ".join(f"avg_hour_{i}" for i in range(24)), " + ".join(f"avg_day_{i}" for i in range(7))
    night = " + ".join(f"avg_hour_{i}" for i in [*range(8), *range(20, 24)])
    light = " + ".join(f"avg_hour_{i}" for i in range(8, 20))
    cols = [_r(f"avg_hour_{i}", f"avg_hour_{i}") for i in range(24)] + [_r(f"avg_day_{i}", f"avg_day_{i}") for i in range(7)]
    cols += [_r(f"CASE WHEN {hs} > 0 THEN avg_hour_{i} / ({hs}) END", f"avg_hour_norm_{i}") for i in range(24)]
    cols += [_r(f"CASE WHEN {ds} > 0 THEN avg_day_{i} / ({ds}) END", f"avg_day_norm_{i}") for i in range(7)]
    cols += [_r(f"({night}) / ({light} + 1e-6)", "night_day_ratio"),
             _r("(avg_day_5 + avg_day_6) / (avg_day_0 + avg_day_1 + avg_day_2 + avg_day_3 + avg_day_4 + 1e-6)", "weekend_week_ratio")]
    return f"SELECT ci_name, {', '.join(cols)} FROM (SELECT ci_name, {h}, {w} FROM b GROUP BY 1)"


def _acf_sql() -> str:
    lags = ", ".join(f"lag(v, {k}) {_OV} AS lag{k}" for k in X.ACF_LAGS)
    acf = ", ".join(_r(f"CASE WHEN count(*) > {k} THEN corr(v, lag{k}) END", f"acf_lag{k}") for k in X.ACF_LAGS)
    # the quadratic coefficient from the normal equations, not from the symmetry used by the Spark side
    return f"""SELECT ci_name, {_r("regr_slope(v, rn)", "trend_slope")}, {_r("regr_intercept(v, rn)", "trend_intercept")},
  round((covar_pop(rn * rn, v) * var_pop(rn) - covar_pop(rn * rn, rn) * covar_pop(rn, v))
    / (var_pop(rn * rn) * var_pop(rn) - pow(covar_pop(rn * rn, rn), 2)), 6) AS quad_coeff, {acf}
  FROM (SELECT *, {lags} FROM b) GROUP BY 1"""


_PEAKS = f"""SELECT ci_name, count(h) AS num_peaks, round(coalesce(avg(h), 0), 6) AS avg_peak_height,
  {", ".join(_r(f"CASE WHEN count(h) >= 2 THEN {e} END", n) for n, e in {
    "mean_peak_interval": "avg(s)", "std_peak_interval": "stddev_pop(s)", "max_peak_height": "max(h)", "min_peak_height": "min(h)",
    "peak_height_range": "max(h) - min(h)", "peak_height_cv": "CASE WHEN avg(h) > 0 THEN stddev_pop(h) / avg(h) ELSE 0 END"}.items())},
  CASE WHEN count(h) >= 2 THEN min(s) END AS min_peak_interval, CASE WHEN count(h) >= 2 THEN max(s) END AS max_peak_interval
  FROM (SELECT i.ci_name, k.h, k.at - lag(k.at) OVER (PARTITION BY i.ci_name ORDER BY k.at) AS s FROM (SELECT DISTINCT ci_name FROM b) i
    LEFT JOIN (SELECT ci_name, v AS h, (lo + hi) // 2 AS at FROM (SELECT *, lag(v) OVER (PARTITION BY ci_name ORDER BY lo) AS p,
      lead(v) OVER (PARTITION BY ci_name ORDER BY lo) AS nx FROM (SELECT ci_name, g, min(rn) AS lo, max(rn) AS hi, max(v) AS v, max(lim) AS lim
        FROM (SELECT *, rn - row_number() OVER (PARTITION BY ci_name, v ORDER BY rn) AS g, avg(v) {_IT} + 2 * stddev_pop(v) {_IT} AS lim FROM b)
        GROUP BY ci_name, v, g)) WHERE p < v AND nx < v AND v >= lim) k ON k.ci_name = i.ci_name) GROUP BY 1"""


def _perm_sql() -> str:
    parts = []
    for m in (2, 3, 4, 5):
        x = [f"lag(v, {m - 1 - i}) {_OV}" for i in range(m)]
        lst = "[" + ", ".join(f"struct_pack(a := {e}, p := {i})" for i, e in enumerate(x)) + "]"
        parts.append(f"""SELECT ci_name, {m} AS m, (log2(sum(c)) - sum(c * log2(c)) / sum(c)) / log2({math.factorial(m)}) AS h FROM (
  SELECT ci_name, pat, count(*) AS c FROM (SELECT ci_name, rn, list_transform(list_sort({lst}), lambda e: e.p)::VARCHAR AS pat FROM b)
  WHERE rn >= {m - 1} GROUP BY 1, 2) GROUP BY 1""")
    cols = ", ".join(_r(f"max(CASE WHEN m = {m} THEN h END)", "perm_entropy" if m == 3 else f"perm_entropy_order{m}") for m in (2, 3, 4, 5))
    return f"SELECT ci_name, {cols} FROM ({' UNION ALL '.join(parts)}) GROUP BY 1"


_SEASONAL_CTES = [
    f"""s1 AS (SELECT *, CASE WHEN rn >= 12 AND rn <= n - 13 THEN (sum(v) OVER (PARTITION BY ci_name ORDER BY rn ROWS BETWEEN 12 PRECEDING AND 12 FOLLOWING)
   - (lag(v, 12) {_OV} + lead(v, 12) {_OV}) / 2) / 24 END AS mid FROM b WHERE n >= 48)""",
    """ends AS (SELECT ci_name, regr_slope(mid, rn) FILTER (rn < least(36, n - 13)) AS fs, regr_intercept(mid, rn) FILTER (rn < least(36, n - 13)) AS fi,
   regr_slope(mid, rn) FILTER (rn >= greatest(12, n - 37) AND rn < n - 13) AS bs, regr_intercept(mid, rn) FILTER (rn >= greatest(12, n - 37) AND rn < n - 13) AS bi
   FROM s1 WHERE mid IS NOT NULL GROUP BY 1)""",
    """s2 AS (SELECT s1.*, CASE WHEN rn < 12 THEN fs * rn + fi WHEN rn > n - 13 THEN bs * rn + bi ELSE mid END AS trend FROM s1 JOIN ends USING (ci_name))""",
    """ph AS (SELECT ci_name, rn % 24 AS phase, avg(v - trend) AS shape FROM s2 GROUP BY 1, 2)""",
    """s3 AS (SELECT s2.*, ph.shape - c.centre AS seasonal, v - trend - (ph.shape - c.centre) AS resid FROM s2 JOIN ph ON ph.ci_name = s2.ci_name AND ph.phase = s2.rn % 24
   JOIN (SELECT ci_name, avg(shape) AS centre FROM ph GROUP BY 1) c ON c.ci_name = s2.ci_name)""",
]
_SEASONAL = "SELECT ci_name, " + ", ".join(
    [_r(f"{f}({c})", f"{p}_{c}") for c in ("trend", "seasonal", "resid") for p, f in (("var", "var_pop"), ("mean", "avg"))]
    + [_r(e, n) for c in ("trend", "seasonal") for n, e in ((f"max_{c}", f"max({c})"), (f"min_{c}", f"min({c})"), (f"{c}_range", f"max({c}) - min({c})"))]
    + [_r(f"var_pop({c}) / (var_pop(trend) + var_pop(seasonal) + var_pop(resid))", f"{c}_var_ratio") for c in ("trend", "seasonal", "resid")]
) + " FROM s3 GROUP BY 1"

_HIGUCHI = f"""SELECT ci_name, round(regr_slope(ln(l), ln(1.0 / k)), 6) AS fractal_dim_higuchi FROM (
  SELECT ci_name, k, avg(s * (n - 1) / (c * k) / k) AS l FROM ({" UNION ALL ".join(
      f"SELECT ci_name, n, {k} AS k, rn % {k} AS m, sum(d) AS s, count(d) AS c FROM (SELECT *, abs(v - lag(v, {k}) {_OV}) AS d FROM b) GROUP BY 1, 2, 3, 4"
      for k in range(1, 11))}) WHERE c > 0 GROUP BY 1, 2) GROUP BY 1"""

_Z = f"""z AS (SELECT *, min(z) {_IT} AS lo, max(z) {_IT} AS hi, lag(z) {_OV} AS p1, lag(z, 2) {_OV} AS p2, lag(z, 3) {_OV} AS p3, lead(z) {_OV} AS nx
  FROM (SELECT *, (v - avg(v) {_IT}) / stddev_samp(v) {_IT} AS z FROM b))"""


def _stretch(cond: str) -> str:
    return f"""(SELECT ci_name, CAST(max(rn - pr) AS DOUBLE) AS s FROM (SELECT ci_name, rn, lag(rn, 1, 0) {_OV} AS pr FROM z
  WHERE rn <= n - 2 AND ({cond} OR rn = n - 2)) GROUP BY 1)"""


def _mode_sql(k: int) -> str:
    return f"""(SELECT ci_name, avg(lo + (bin + 0.5) * (hi - lo) / {k}) AS h FROM (SELECT *, max(c) {_IT} AS top FROM (
  SELECT ci_name, lo, hi, least(floor((z - lo) / ((hi - lo) / {k})), {k - 1}) AS bin, count(*) AS c FROM z GROUP BY 1, 2, 3, 4)) WHERE c = top GROUP BY 1)"""


_CANON = f"""SELECT a.ci_name, m.s AS SB_BinaryStats_mean_longstretch1, r.s AS SB_BinaryStats_diff_longstretch0,
  {rnd("MD_hrv_classic_pnn40, CO_trev_1_num, FC_LocalSimple_mean3_stderr")}, round(h5.h, 6) AS DN_HistogramMode_5, round(h10.h, 6) AS DN_HistogramMode_10,
  round(ami.v, 6) AS CO_HistogramAMI_even_2_5, round(mo.v, 6) AS SB_MotifThree_quantile_hh
FROM (SELECT ci_name, count(*) FILTER (abs(z - p1) * 1000 > 40) / count(z - p1) AS MD_hrv_classic_pnn40, avg(pow(z - p1, 3)) AS CO_trev_1_num,
   stddev_samp(z - (p1 + p2 + p3) / 3) AS FC_LocalSimple_mean3_stderr FROM z GROUP BY 1) a
JOIN {_stretch("z <= 0")} m USING (ci_name) JOIN {_stretch("nx >= z")} r USING (ci_name)
JOIN {_mode_sql(5)} h5 USING (ci_name) JOIN {_mode_sql(10)} h10 USING (ci_name)
JOIN (SELECT ci_name, sum(c / t * ln(c * t / (ra * rb))) AS v FROM (SELECT *, sum(c) {_IT} AS t, sum(c) OVER (PARTITION BY ci_name, i) AS ra,
   sum(c) OVER (PARTITION BY ci_name, j) AS rb FROM (SELECT ci_name, floor((p2 - lo + 0.1) / ((hi - lo + 0.2) / 5)) AS i,
   floor((z - lo + 0.1) / ((hi - lo + 0.2) / 5)) AS j, count(*) AS c FROM z WHERE rn >= 2 GROUP BY 1, 2, 3)) GROUP BY 1) ami USING (ci_name)
JOIN (SELECT ci_name, -sum(c / t * ln(c / t)) AS v FROM (SELECT *, sum(c) {_IT} AS t FROM (SELECT ci_name, l, nl, count(*) AS c FROM (
   SELECT *, lead(l) {_OV} AS nl FROM (SELECT z.ci_name, rn, CASE WHEN z <= c1 THEN 1 WHEN z <= c2 THEN 2 ELSE 3 END AS l FROM z JOIN (
     SELECT ci_name, s[CAST(floor(a1) AS INT) + 1] + (a1 - floor(a1)) * (s[CAST(ceil(a1) AS INT) + 1] - s[CAST(floor(a1) AS INT) + 1]) AS c1,
       s[CAST(floor(a2) AS INT) + 1] + (a2 - floor(a2)) * (s[CAST(ceil(a2) AS INT) + 1] - s[CAST(floor(a2) AS INT) + 1]) AS c2
     FROM (SELECT ci_name, list_sort(list(z)) AS s, count(*) * (1.0 / 3)::DOUBLE - 0.5 AS a1, count(*) * (2.0 / 3)::DOUBLE - 0.5 AS a2 FROM z GROUP BY 1)) q ON q.ci_name = z.ci_name))
   WHERE nl IS NOT NULL GROUP BY 1, 2, 3)) GROUP BY 1) mo USING (ci_name)"""

_TEMPL = f"""t AS (SELECT ci_name, rn, n, v AS a, lead(v) {_OV} AS b2, lead(v, 2) {_OV} AS c2, 0.2 * stddev_pop(v) {_IT} AS r FROM b),
near AS (SELECT i.ci_name, i.rn AS i, j.rn AS j, i.n, i.rn < i.n - 2 AND j.rn < i.n - 2 AS full3,
  CASE WHEN i.rn < i.n - 2 AND j.rn < i.n - 2 THEN abs(i.c2 - j.c2) <= i.r ELSE false END AS near3
  FROM t i JOIN t j ON i.ci_name = j.ci_name AND i.rn < i.n - 1 AND j.rn < j.n - 1 AND abs(i.a - j.a) <= i.r AND abs(i.b2 - j.b2) <= i.r)"""
_ENTROPY = """SELECT ci_name, matches_2, matches_3, round(-ln(matches_3 / matches_2), 6) AS sample_entropy, round(p2 - p3, 6) AS approx_entropy
FROM (SELECT ci_name, count(*) FILTER (full3 AND i < j) AS matches_2, count(*) FILTER (near3 AND i < j) AS matches_3 FROM near GROUP BY 1)
JOIN (SELECT ci_name, avg(ln(c / (n - 1))) AS p2 FROM (SELECT ci_name, i, n, count(*) AS c FROM near GROUP BY 1, 2, 3) GROUP BY 1) USING (ci_name)
JOIN (SELECT ci_name, avg(ln(c / (n - 2))) AS p3 FROM (SELECT ci_name, i, n, count(*) AS c FROM near WHERE near3 GROUP BY 1, 2, 3) GROUP BY 1) USING (ci_name)"""

_STEPS = int(math.floor(math.log(5.0) / math.log(1.03)))
_DIM = f"""pt AS (SELECT ci_name, rn, n, v AS a, lead(v) {_OV} AS c, stddev_samp(v) {_IT} AS sd FROM b),
pd AS (SELECT i.ci_name, greatest(abs(i.a - j.a), abs(i.c - j.c)) AS d, i.sd FROM pt i JOIN pt j ON i.ci_name = j.ci_name AND i.rn < j.rn AND j.rn < j.n - 1),
rad AS (SELECT ci_name, CAST(k AS INT) AS step, 0.1 * sd * pow(1.03, k) AS radius FROM (SELECT DISTINCT ci_name, sd FROM pt), (SELECT unnest(generate_series(0, {_STEPS})) AS k)),
cnt AS (SELECT rad.ci_name, step, radius, (SELECT count(*) FROM pd WHERE pd.ci_name = rad.ci_name AND pd.d <= rad.radius) AS pairs FROM rad)"""

_WELCH_CTES = [
    """hop AS (SELECT *, least(256, n) AS m, least(256, n) - least(256, n) // 2 AS h FROM b)""",
    """seg AS (SELECT b.ci_name, s.k, m, b.rn - s.k * h AS t, v - avg(v) OVER (PARTITION BY b.ci_name, s.k) AS u, 0.5 - 0.5 * cos(2 * pi() * (b.rn - s.k * h) / m) AS w
  FROM hop b JOIN (SELECT unnest(generate_series(0, 100000)) AS k) s ON s.k < (b.n - m // 2) // h AND b.rn >= s.k * h AND b.rn < s.k * h + m)""",
    """dft AS (SELECT ci_name, k, m, f, sum(u * w * cos(2 * pi() * f * t / m)) AS re, sum(u * w * sin(2 * pi() * f * t / m)) AS im, sum(w * w) AS ww
  FROM seg JOIN (SELECT unnest(generate_series(0, 128)) AS f) ON f <= m // 2 GROUP BY 1, 2, 3, 4)""",
    """psd AS (SELECT ci_name, f, f / m AS fr, avg((re * re + im * im) / ww * CASE WHEN f = 0 OR 2 * f = m THEN 1 ELSE 2 END) AS p FROM dft GROUP BY 1, 2, 3)""",
    """nrm AS (SELECT *, p / sum(p) OVER (PARTITION BY ci_name) AS q FROM psd)""",
    """cen AS (SELECT *, sum(fr * q) OVER (PARTITION BY ci_name) AS c FROM nrm)""",
    """bw AS (SELECT *, sqrt(sum((fr - c) * (fr - c) * q) OVER (PARTITION BY ci_name)) AS w FROM cen)""",
]
_WELCH = """SELECT ci_name, round(-sum(q * log2(q + 1e-12)), 6) AS spectral_entropy, round(arg_max(fr, p), 6) AS dominant_freq, round(max(c), 6) AS spec_centroid,
  round(max(w), 6) AS spec_bandwidth, round(sum(q) FILTER (fr <= 0.1), 6) AS low_freq_energy, round(sum(q) FILTER (fr > 0.1 AND fr <= 0.3), 6) AS mid_freq_energy,
  round(sum(q) FILTER (fr > 0.3), 6) AS high_freq_energy, round(sum(q) FILTER (fr <= 0.1) / sum(q) FILTER (fr > 0.3), 6) AS low_high_ratio,
  round(sum(pow(fr - c, 3) * q) / pow(max(w), 3), 6) AS spec_skewness, round(sum(pow(fr - c, 4) * q) / pow(max(w), 4), 6) AS spec_kurtosis,
  round(exp(avg(ln(p + 1e-10))) / (avg(p) + 1e-10), 6) AS spec_flatness FROM bw GROUP BY 1"""

_BASIC = f"""SELECT ci_name, {_r("avg(v)", "mean")}, {_r("stddev_pop(v)", "std")}, {_r("min(v)", "min")}, {_r("max(v)", "max")}, {_r(_pct(0.5), "median")},
  {_r(f"{_pct(0.75)} - {_pct(0.25)}", "iqr")}, round(CASE WHEN count(*) >= 3 AND stddev_pop(v) > 1e-9 THEN skewness(v) END, 6) AS skewness,
  round(CASE WHEN count(*) >= 4 AND stddev_pop(v) > 1e-9 THEN kurtosis(v) END, 6) AS kurtosis, {_r("max(v) - min(v)", "range")},
  round(CASE WHEN avg(v) > 0 THEN stddev_pop(v) / avg(v) END, 6) AS cv, {_r("mad(v)", "mad")}, {_r("sum(v * v)", "energy")}, {_r("sqrt(avg(v * v))", "rms")},
  round(CASE WHEN avg(v * v) > 0 THEN max(abs(v)) / sqrt(avg(v * v)) END, 6) AS crest_factor FROM b GROUP BY 1"""

_PERCENTILES = "SELECT ci_name, " + ", ".join(
    [_r(_pct(k / 100), f"load_{k}p") for k in (10, 25, 50, 75, 90, 95, 99)]
    + [_r(_pct(k / 100), f"asym_{k}p") for k in (1, 5, 25, 50, 75, 95, 99)]
    + [_r(f"CASE WHEN {_pct(c / 100)} > 0 THEN {_pct(a / 100)} / {_pct(c / 100)} END", f"ratio_{a}_{c}")
       for a, c in ((75, 25), (90, 10), (95, 5), (99, 1))]) + " FROM b GROUP BY 1"

ORACLES = {
    "fe_basic": sql("poller", _BASIC, [_FLEET]),
    "fe_percentiles": sql("poller", _PERCENTILES, [_FLEET]),
    "fe_rolling": sql("type_hourly", _rolling_sql(), [_TYPE]),
    "fe_diffs": sql("poller", f"""SELECT ci_name, {_r("avg(abs(d))", "mean_abs_diff")}, {_r("stddev_pop(d)", "std_diff")}, {_r(_pct(0.5, "abs(d)"), "median_abs_diff")},
  {_r("max(abs(d))", "max_abs_diff")}, {_r("min(abs(d))", "min_abs_diff")}, {_r(f"{_pct(0.75, 'd')} - {_pct(0.25, 'd')}", "diff_iqr")},
  {_r("avg(abs(d2))", "mean_abs_diff2")}, {_r("stddev_pop(d2)", "std_diff2")}, {_r("max(abs(d2))", "max_abs_diff2")} FROM dd GROUP BY 1""", [_FLEET, _DIFF]),
    "fe_episodes": sql("type_hourly", _episodes_sql(), [_TYPE]),
    "fe_hjorth": sql("type_hourly", """SELECT ci_name, round(va, 6) AS hjorth_activity, round(sqrt(vd / va), 6) AS hjorth_mobility,
  round(sqrt(vd2 / vd) / sqrt(vd / va), 6) AS hjorth_complexity, round(zc, 6) AS zero_crossing_rate, round(mc, 6) AS mean_crossing_rate FROM (
  SELECT ci_name, var_pop(v) AS va, var_pop(d) AS vd, var_pop(d2) AS vd2, count(*) FILTER (pv * v < 0) / count(*) AS zc,
  count(*) FILTER ((pv - m) * (v - m) < 0) / count(*) AS mc FROM dd GROUP BY 1)""", [_TYPE, _DIFF]),
    "fe_exceed": sql("poller", _exceed_sql(), [_FLEET]),
    "fe_daynight": sql("poller", _day_night_sql(), [_FLEET]),
    "fe_hour_dow": sql("type_hourly", _hour_dow_sql(), [_TYPE]),
    "fe_week_long": sql("type_hourly", f"""SELECT ci_name, CAST(date_trunc('week', event_date_time) AS TIMESTAMP) AS week_start, {_r("avg(x)", "mean")},
  {_r("min(x)", "min")}, {_r("max(x)", "max")}, {_r("stddev_pop(x)", "std")}, {_r(_pct(0.5, "x"), "median")} FROM b GROUP BY 1, 2""", [_TYPE]),
    "fe_profile": sql("poller", _profile_sql(), [_FLEET]),
    "fe_trend_acf": sql("type_hourly", _acf_sql(), [_TYPE]),
    "fe_static": sql("poller", """SELECT ci_name, device_role, site_criticality, site_country, CAST(site_criticality = 'Unknown' AS INT) AS Criticality_unknown
  FROM (SELECT *, row_number() OVER (PARTITION BY ci_name ORDER BY event_date_time) AS r FROM poller) WHERE r = 1"""),
    "fe_peaks": sql("type_hourly", _PEAKS, [_TYPE]),
    "fe_perm_entropy": sql("type_hourly", _perm_sql(), [_TYPE]),
    "fe_seasonal": sql("type_hourly", _SEASONAL, [_TYPE, *_SEASONAL_CTES]),
    "fe_higuchi": sql("type_hourly", _HIGUCHI, [_TYPE]),
    "fe_canonical_sql": sql("type_hourly", _CANON, [_TYPE, _Z]),
    "fe_sample_entropy": sql("type_hourly", _ENTROPY, [_TYPE, _TEMPL]),
    "fe_corr_dim_counts": sql("type_hourly", "SELECT ci_name, step, round(radius, 6) AS radius, pairs FROM cnt", [_TYPE, _DIM]),
    "fe_corr_dim": sql("type_hourly", "SELECT ci_name, round(regr_slope(ln(pairs), ln(radius)), 6) AS corr_dim FROM cnt WHERE pairs > 0 GROUP BY 1", [_TYPE, _DIM]),
    "fe_welch": sql("type_hourly", _WELCH, [_TYPE, *_WELCH_CTES]),
}
