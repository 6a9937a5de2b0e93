"""Imputation, selection and transform queries with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from pulsegrid.catalog.duck import rounded as rnd, sql
from pulsegrid.catalog.evaluate import _PART, PART_COLS, part_features
from pulsegrid.catalog.util import rounded
from pulsegrid.operators import evaluate as E, prepare as P, split as S
from pulsegrid.sources import views as V

TARGET = "avg_price"
FEATURES = [c for c in PART_COLS if c != TARGET]


def gappy(s, d):
    """Readings with three copies of the value that miss 2, 10 and 25 in 100 items."""
    u = F.substring("ci_name", 4, 9).cast("int")
    v = F.col("event_value")
    return V.poller(s, d).select(
        "ci_name", "event_date_time", "site_country",
        F.when(u % 50 != 0, v).alias("few"), F.when(u % 10 != 0, v).alias("mid"), F.when(u % 4 != 0, v).alias("many"))


def _train_medians(s, d):
    marked = S.mark_test(gappy(s, d).withColumn("cluster", F.lit(0)))
    train, test = P.impute_from_train(marked.filter("is_test = 0"), marked.filter("is_test = 1"), ["few", "mid", "many"])
    return rounded(train.unionByName(test).groupBy("is_test").agg(
        *[F.sum(c).alias(f"sum_{c}") for c in ("few", "mid", "many")], F.count("many").alias("n")), 4)


def filled_parts(s, d):
    df = part_features(s, d)
    return P.impute_median_mode(df, PART_COLS, [])


def _variance_keep(s, d):
    df = part_features(s, d)
    kept = P.variance_keep(df, PART_COLS)
    return s.createDataFrame([(c, int(c in kept)) for c in PART_COLS], "feature string, kept int")


def wide_parts(s, d):
    """Part features with two columns that follow others closely."""
    return filled_parts(s, d).withColumns({
        "price_with_tax": F.col("p_retailprice") * 1.2 + F.col("p_size") / 100,
        "qty_twice": F.col("avg_qty") * 2 + F.col("avg_tax")})


WIDE = [*PART_COLS, "price_with_tax", "qty_twice"]


def _corr_drop(s, d):
    gone = P.correlated_drop(wide_parts(s, d), WIDE)
    return s.createDataFrame([(c, int(c in gone)) for c in WIDE], "feature string, dropped int")


def _corr_pairs(s, d):
    rows = P.correlated_pairs(wide_parts(s, d), WIDE)
    return rounded(s.createDataFrame(rows, "feature_a string, feature_b string, correlation double"))


def _importance_like(s, d):
    """A stand-in importance SQL can state: unit-free spread of means over part types."""
    df = part_features(s, d).withColumnRenamed("p_partkey", "item")
    means = E.cluster_means(df, df.select("item", F.col("p_type").alias("label")), FEATURES)
    return E.importance_by_variance(means, FEATURES)


def _combined(s, d):
    df = part_features(s, d)
    known = df.filter(f"{TARGET} IS NOT NULL")
    return rounded(P.combined_score(P.target_correlation(known, FEATURES, TARGET), _importance_like(s, d),
                                    P.binned_mutual_information(known, FEATURES, TARGET)))


def _static(s, d):
    df = part_features(s, d).withColumns({"ci_name": F.col("p_brand"), "always": F.lit(1.0)}).drop("p_partkey")
    return rounded(P.compact_static(df, k=4), 4)


def _groups(s, d):
    """Group sizes of the feature names of the fleet's basic and percentile tables."""
    from pulsegrid.operators import features as X

    b = X.base(V.type_hourly(s, d))
    cols = [c for c in X.basic(b).join(X.percentiles(b), "ci_name").columns if c != "ci_name"]
    long = b.groupBy("ci_name").agg(F.count("*").alias("n"))
    sizes = F.array(*[F.struct(F.lit(g).alias("feature_group"), F.lit(len(c)).alias("features"))
                      for g, c in P.feature_groups(cols).items()])
    return long.agg(F.count("*").alias("items")).withColumn("g", F.explode(sizes)).select("items", "g.*")



QUERIES = {
    "impute_median_mode": lambda s, d: rounded(P.impute_median_mode(gappy(s, d), ["few", "mid", "many"], ["site_country"])),
    "missing_strategy": lambda s, d: rounded(P.missing_strategy(gappy(s, d), ["few", "mid", "many"], ["site_country"])),
    "impute_train_median": _train_medians,
    "variance_keep": _variance_keep,
    "corr_pairs_drop": _corr_drop,
    "corr_pairs": _corr_pairs,
    "target_corr": lambda s, d: rounded(P.target_correlation(part_features(s, d).filter(f"{TARGET} IS NOT NULL"), FEATURES, TARGET)),
    "binned_mi": lambda s, d: rounded(P.binned_mutual_information(part_features(s, d).filter(f"{TARGET} IS NOT NULL"), FEATURES, TARGET)),
    "combined_feature_score": _combined,
    "static_compact": _static,
    "feature_groups": _groups,
    "standardise": lambda s, d: (lambda df: rounded(df.select("p_partkey", P.standard_array(df, PART_COLS).alias("z")).select(
        "p_partkey", *[F.round(F.col("z")[i], 6).alias(c) for i, c in enumerate(PART_COLS)])))(filled_parts(s, d)),
    "iforest": lambda s, d: P.drop_outliers(filled_parts(s, d), "p_partkey", PART_COLS),
    "yeo_johnson": lambda s, d: P.power_transform(filled_parts(s, d), PART_COLS),
    "quantile_normal": lambda s, d: P.quantile_normal(filled_parts(s, d), PART_COLS),
    "one_hot": lambda s, d: P.encode(filled_parts(s, d), PART_COLS, ["p_type", "p_brand"]).select("p_partkey", "vec"),
    "pca_scores": lambda s, d: P.pca_scores(P.encode(filled_parts(s, d), PART_COLS, []), share=0.95).select("p_partkey", "scores"),
    "forest_importance": lambda s, d: P.regression_importance(part_features(s, d).filter(f"{TARGET} IS NOT NULL"), FEATURES, TARGET),
}

_GAPPY = """g AS (SELECT ci_name, event_date_time, site_country, CASE WHEN u % 50 <> 0 THEN event_value END AS few,
  CASE WHEN u % 10 <> 0 THEN event_value END AS mid, CASE WHEN u % 4 <> 0 THEN event_value END AS many
  FROM (SELECT *, CAST(substr(ci_name, 4) AS INT) AS u FROM poller))"""
_MED = lambda c, src="g": f"(SELECT quantile_cont({c}, 0.5) FROM {src})"
_FILLED = "fp AS (SELECT item, p_brand, p_type, " + ", ".join(
    f"coalesce({c}, (SELECT quantile_cont({c}, 0.5) FROM pf)) AS {c}" for c in PART_COLS) + " FROM pf)"
_WIDE = "wp AS (SELECT *, p_retailprice * 1.2 + p_size / 100 AS price_with_tax, avg_qty * 2 + avg_tax AS qty_twice FROM fp)"
_KNOWN = f"kn AS (SELECT * FROM pf WHERE {TARGET} IS NOT NULL)"
_PAIRS = [(a, b) for i, a in enumerate(WIDE) for b in WIDE[i + 1:]]
_CP = "cp AS (" + " UNION ALL ".join(
    f"SELECT {i} AS o, '{a}' AS feature_a, '{b}' AS feature_b, abs(corr({a}, {b})) AS correlation FROM wp" for i, (a, b) in enumerate(_PAIRS)) + ")"


def _bucket(c: str) -> str:
    edges = ", ".join(f"quantile_cont({c}, {i / 10})" for i in range(1, 10))
    return f"len(list_filter(list_distinct((SELECT [{edges}] FROM kn)), lambda e: e < {c}))"


_MI = "mi AS (SELECT feature, greatest(sum(c / n * ln(c * n / (nb * ny))), 0) AS mi FROM (SELECT *, sum(c) OVER (PARTITION BY feature) AS n, " \
      "sum(c) OVER (PARTITION BY feature, b) AS nb, sum(c) OVER (PARTITION BY feature, y) AS ny FROM (SELECT feature, b, y, count(*) AS c FROM (" + \
      " UNION ALL ".join(f"SELECT '{c}' AS feature, {_bucket(c)} AS b, {_bucket(TARGET)} AS y FROM kn" for c in FEATURES) + \
      ") GROUP BY 1, 2, 3)) GROUP BY 1)"
_TC = "tc AS (" + " UNION ALL ".join(
    f"SELECT '{c}' AS feature, abs(corr(coalesce({c}, {_MED(c, 'kn')}), {TARGET})) AS correlation FROM kn" for c in FEATURES) + ")"
_IM = "im AS (" + " UNION ALL ".join(
    f"SELECT '{c}' AS feature, var_samp(m) AS importance FROM (SELECT p_type, avg({c}) AS m FROM pf GROUP BY 1)" for c in FEATURES) + ")"


def _BAND(c: str) -> str:
    """The mean where 5 to 15 % of a column are missing, else the median."""
    share = f"100.0 * count(*) FILTER ({c} IS NULL) / count(*)"
    return f"(SELECT CASE WHEN {share} >= 5 AND {share} < 15 THEN avg({c}) ELSE quantile_cont({c}, 0.5) END FROM g)"


def _static_sql() -> str:
    # item means per brand; the four most varying columns at every scale of the test tables
    cols = ["avg_price", "n_lines", "p_retailprice", "p_size"]
    return "SELECT p_brand AS ci_name, " + ", ".join(f"round(avg({c}), 4) AS fx_{c}" for c in cols) + " FROM pf GROUP BY 1"


def _groups_sql() -> str:
    from pulsegrid.operators.features import PERCENTS  # noqa: F401

    names = ("mean std min max median iqr skewness kurtosis range cv mad energy rms crest_factor load_10p load_25p load_50p load_75p load_90p load_95p "
             "load_99p asym_1p asym_5p asym_25p asym_50p asym_75p asym_95p asym_99p ratio_75_25 ratio_90_10 ratio_95_5 ratio_99_1").split()
    vals = ", ".join(f"('{n}')" for n in names)
    like = " UNION ALL ".join(
        f"SELECT '{g}' AS feature_group, count(*) FILTER ({' OR '.join(f'contains(f, $${p}$$)' for p in parts)}) AS features FROM names"
        for g, parts in P.FEATURE_GROUPS.items())
    return (f"WITH names(f) AS (VALUES {vals}), gr AS ({like}) SELECT (SELECT count(DISTINCT event_type) FROM events) AS items, "
            "feature_group, CAST(features AS INT) AS features FROM gr")


ORACLES = {
    "impute_median_mode": sql("poller", f"""SELECT ci_name, event_date_time, coalesce(site_country, (SELECT site_country FROM g WHERE site_country IS NOT NULL GROUP BY 1 ORDER BY count(*) DESC, 1 LIMIT 1)) AS site_country,
  {', '.join(f'round(coalesce({c}, {_MED(c)}), 6) AS {c}' for c in ('few', 'mid', 'many'))} FROM g""", [_GAPPY]),
    "missing_strategy": sql("poller", f"""SELECT ci_name, event_date_time, coalesce(site_country, 'Unknown') AS site_country,
  {', '.join(f'round(coalesce({c}, {_BAND(c)}), 6) AS {c}' for c in ('few', 'mid', 'many'))}, CAST(many IS NULL AS INT) AS many_missing FROM g""", [_GAPPY]),
    "impute_train_median": sql("poller", f"""SELECT is_test, {', '.join(f"round(sum(coalesce({c}, (SELECT quantile_cont({c}, 0.5) FROM m WHERE is_test = 0))), 4) AS sum_{c}" for c in ('few', 'mid', 'many'))},
  count(*) AS n FROM m GROUP BY 1""", [_GAPPY, "m AS (SELECT *, CAST(event_date_time >= (SELECT max(event_date_time) FROM g) - INTERVAL 21 DAY AS INT) AS is_test FROM g)"]),
    "variance_keep": sql("", " UNION ALL ".join(f"SELECT '{c}' AS feature, CAST(var_pop({c}) > 0.01 AS INT) AS kept FROM pf" for c in PART_COLS), [_PART]),
    "corr_pairs_drop": sql("", " UNION ALL ".join(
        f"SELECT '{c}' AS feature, CAST(count(*) > 0 AS INT) AS dropped FROM cp WHERE feature_b = '{c}' AND correlation > 0.95" for c in WIDE), [_PART, _FILLED, _WIDE, _CP]),
    "corr_pairs": sql("", "SELECT feature_a, feature_b, round(correlation, 6) AS correlation FROM cp WHERE correlation > 0.95", [_PART, _FILLED, _WIDE, _CP]),
    "target_corr": sql("", "SELECT feature, round(correlation, 6) AS correlation FROM tc", [_PART, _KNOWN, _TC]),
    "binned_mi": sql("", "SELECT feature, round(mi, 6) AS mi FROM mi", [_PART, _KNOWN, _MI]),
    "combined_feature_score": sql("", """SELECT feature, round((correlation / (SELECT max(correlation) FROM tc) + importance / (SELECT max(importance) FROM im)
  + mi / (SELECT max(mi) FROM mi)) / 3, 6) AS combined_score FROM tc JOIN im USING (feature) JOIN mi USING (feature)""", [_PART, _KNOWN, _TC, _IM, _MI]),
    "static_compact": sql("", _static_sql(), [_PART]),
    "feature_groups": _groups_sql(),
    "standardise": sql("", "SELECT item AS p_partkey, " + ", ".join(
        f"round(({c} - (SELECT avg({c}) FROM fp)) / (SELECT stddev_pop({c}) FROM fp), 6) AS {c}" for c in PART_COLS) + " FROM fp", [_PART, _FILLED]),
}
