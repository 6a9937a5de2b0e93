"""Forecasting queries: models on hourly series, one set of readings per cluster."""

from __future__ import annotations

from pyspark.sql import functions as F

from pulsegrid.operators import forecast as M, gram as G, lags as L
from pulsegrid.plans import forecasting as P
from pulsegrid.session import settle
from pulsegrid.sources import views as V
from pulsegrid.catalog.duck import sql
from pulsegrid.catalog.util import rounded

# Smaller ensembles than the defaults; the ranges are otherwise searched alike.
QUICK = {**M.SPACE, "forest": {"trees": (20, 40, "int"), "depth": (5, 8, "int"), "leaf": (2, 10, "int")},
         "boosting": {"trees": (10, 20, "int"), "rate": (0.05, 0.2, "log"), "depth": (2, 4, "int"), "share": (0.6, 1.0, "lin")}}


def _rows(s, d, clusters=1):
    df = V.type_hourly(s, d).withColumn("cluster", (F.length("ci_name") % clusters).cast("int"))
    return P.prepared(df)


def _predict(model):
    return lambda s, d: P.run_cluster(_rows(s, d), (model,), 1, folds=3, select=False, space=QUICK)[2]


def _best(s, d):
    data = settle(_rows(s, d, 2))
    out = None
    for c in (0, 1):
        fits, _, _ = P.run_cluster(data.filter(F.col("cluster") == c), M.LINEAR, 3, folds=3, space=QUICK)
        table = P.compare(fits, s, c)
        out = table if out is None else out.unionByName(table)
    return out


LAGGED = ["Lag_1", "Lag_24"]


def _gram_linear(s, d):
    fits = G.linear_models(_rows(s, d, 3), LAGGED, ("linear",), test=None)
    out = fits.select("cluster", F.col("n_train").alias("n_rows"), "intercept", F.col("coefficients")[0].alias("b_lag_1"), F.col("coefficients")[1].alias("b_lag_24"), "cv_rmse")
    return rounded(out, 4)


def _linear_models(s, d):
    """The whole search of every linear model, for all clusters at once."""
    data = _rows(s, d, 3)
    features, _ = M.feature_columns(data)
    return G.linear_models(data, features, trials=P.TRIALS)


def _linear_forecast(s, d):
    data = settle(_rows(s, d, 3))
    features, _ = M.feature_columns(data)
    fits = G.linear_models(data, features, trials=P.TRIALS)
    return G.predict(data.where("is_test = 1"), fits, features).select("ci_name", "event_date_time", "cluster", M.TARGET, "model", "y_pred")


QUERIES = {
    "forecast_features": lambda s, d: rounded(L.forecast_features(V.type_hourly(s, d)).select(
        "ci_name", "event_date_time", "Lag_1", "Lag_24", "Diff_1", "Rolling_mean_6", "Rolling_std_24", "Deviation_from_mean",
        "Z_score", "Trend_up", "Part_of_day")),
    "forecast_linear": _predict("linear"),
    "forecast_elastic_net": _predict("elastic_net"),
    "forecast_forest": _predict("forest"),
    "forecast_gbt": _predict("boosting"),
    "forecast_best": _best,
    "gram_linear": _gram_linear,
    "linear_models": _linear_models,
    "linear_forecast": _linear_forecast,
}

_W = "OVER (PARTITION BY ci_name ORDER BY event_date_time ROWS BETWEEN {} PRECEDING AND 1 PRECEDING)"
_FEAT = f"""f AS (SELECT ci_name, event_date_time, lag(event_value) OVER o AS l1, lag(event_value, 2) OVER o AS l2, lag(event_value, 24) OVER o AS l24,
  CASE WHEN count(event_value) {_W.format(6)} >= 2 THEN avg(event_value) {_W.format(6)} END AS m6,
  CASE WHEN count(event_value) {_W.format(24)} >= 2 THEN avg(event_value) {_W.format(24)} END AS m24,
  CASE WHEN count(event_value) {_W.format(24)} >= 2 THEN stddev_samp(event_value) {_W.format(24)} END AS s24
  FROM type_hourly WINDOW o AS (PARTITION BY ci_name ORDER BY event_date_time))"""

_GRAM = ["""r AS (SELECT length(ci_name) % 3 AS cluster, epoch(event_date_time)::BIGINT AS t, event_value AS y, lag(event_value) OVER o AS a, lag(event_value, 24) OVER o AS b
  FROM type_hourly WINDOW o AS (PARTITION BY ci_name ORDER BY event_date_time))""", "k AS (SELECT * FROM r WHERE y IS NOT NULL AND a IS NOT NULL AND b IS NOT NULL)",
  "span AS (SELECT cluster, min(t) AS lo, max(t) AS hi FROM k GROUP BY 1)",
  "parts AS (SELECT k.*, (SELECT count(*) FROM range(1, 6) g(i) WHERE t >= lo + floor((hi - lo) * i / 6)) AS part FROM k JOIN span USING (cluster))",
  """m AS (SELECT cluster, f, count(*) AS n, avg(a) AS ma, avg(b) AS mb, avg(y) AS my, var_pop(a) AS aa, var_pop(b) AS bb, covar_pop(a, b) AS ab, covar_pop(a, y) AS ay,
  covar_pop(b, y) AS byy FROM parts JOIN range(1, 7) g(f) ON part < f GROUP BY 1, 2)""",
  "w AS (SELECT *, (ay * bb - byy * ab) / (aa * bb - ab * ab) AS wa, (byy * aa - ay * ab) / (aa * bb - ab * ab) AS wb FROM m)",
  """v AS (SELECT p.cluster, f, sqrt(avg((y - my - wa * (a - ma) - wb * (b - mb)) ** 2)) AS rmse FROM parts p JOIN w ON p.cluster = w.cluster AND part = f GROUP BY 1, 2)"""]

ORACLES = {
    "gram_linear": sql("type_hourly", """SELECT cluster, n AS n_rows, round(my - wa * ma - wb * mb, 4) AS intercept, round(wa, 4) AS b_lag_1, round(wb, 4) AS b_lag_24,
  round((SELECT avg(rmse) FROM v WHERE v.cluster = w.cluster), 4) AS cv_rmse FROM w WHERE f = 6""", _GRAM),
    "forecast_features": sql("type_hourly", """SELECT ci_name, event_date_time, round(l1, 6) AS Lag_1, round(l24, 6) AS Lag_24, round(l1 - l2, 6) AS Diff_1,
  round(m6, 6) AS Rolling_mean_6, round(s24, 6) AS Rolling_std_24, round(l1 - m24, 6) AS Deviation_from_mean, round((l1 - m24) / (s24 + 1e-6), 6) AS Z_score,
  CAST(coalesce(m6 > m24, false) AS INT) AS Trend_up, CASE WHEN hour(event_date_time) <= 6 THEN 'Night' WHEN hour(event_date_time) <= 12 THEN 'Morning'
  WHEN hour(event_date_time) <= 18 THEN 'Afternoon' ELSE 'Evening' END AS Part_of_day FROM f""", [_FEAT]),
}
