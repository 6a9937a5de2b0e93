"""One forecaster per cluster: split, features, search, choice and predictions."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.ml import PipelineModel
from pyspark.sql import DataFrame, SparkSession, functions as F

from pulsegrid.operators import forecast as M, lags as L, prepare as P, split as S
from pulsegrid.session import settle
from pulsegrid.sources.writers import save_model, write_result

# Search trials per model.
TRIALS = {"linear": 1, "ridge": 25, "lasso": 25, "elastic_net": 40, "forest": 30, "boosting": 40}


def prepared(df: DataFrame, static: DataFrame | None = None, leak_free: bool = True, days: int = 21) -> DataFrame:
    """Rows with features and the ``is_test`` flag, for all clusters at once.

    In leak-free mode features come before the split, so test lags see the training
    history; otherwise each side only sees its own rows.
    """
    marked = S.mark_test(df, days)
    if leak_free:
        out = L.forecast_features(marked)
    else:
        sides = [L.forecast_features(marked.filter(F.col("is_test") == t), leak_free=False) for t in (0, 1)]
        out = sides[0].unionByName(sides[1])
    return out if static is None else L.with_static(out, static)


def split_sets(data: DataFrame, numeric: list[str]) -> tuple[DataFrame, DataFrame]:
    """Training rows without warm-up, test rows; missing values from training medians, the target untouched."""
    known = data.filter(F.col(M.TARGET).isNotNull())
    train = L.drop_warmup(known.filter("is_test = 0"))
    return P.impute_from_train(train, known.filter("is_test = 1"), numeric)


def selected(train: DataFrame, numeric: list[str], k: int = 100) -> list[str]:
    """Numeric features by correlation, forest importance and mutual information, without near duplicates."""
    live = [c for c in numeric if c not in {r["column_name"] for r in _constant(train, numeric)}]
    scores = P.combined_score(P.target_correlation(train, live, M.TARGET), P.regression_importance(train, live, M.TARGET),
                              P.binned_mutual_information(train, live, M.TARGET))
    return P.choose_features(scores, P.correlated_pairs(train, live), k)


def _constant(df: DataFrame, cols: list[str]) -> list:
    from pulsegrid.operators.rollup import constant_columns

    return constant_columns(df, cols).filter("is_constant").collect()


def run_cluster(data: DataFrame, models: Iterable[str] = M.MODELS, trials: dict | int | None = None, folds: int | None = None,
                select: bool = True, space: dict | None = None, seed: int = 42) -> tuple[list[M.Fit], PipelineModel, DataFrame]:
    """Fits, the best pipeline and the test predictions of one cluster's prepared rows."""
    numeric, text = M.feature_columns(data)
    train, test = split_sets(data, numeric)
    train, test = settle(train), settle(test)
    try:
        used = selected(train, numeric) if select else numeric
        shape = M.design(train, used, text)
        keep = ["ci_name", "event_date_time", "cluster", M.TARGET, "features"]
        x, y = settle(shape.transform(train).select(*keep)), settle(shape.transform(test).select(*keep))
        budget = trials if isinstance(trials, int) else None
        fits = [M.tune_and_fit(x, y, m, budget or (trials or TRIALS)[m], folds or 5, seed, space) for m in models]
        best = M.best_fit(fits)
        pipe = PipelineModel(stages=[*shape.stages, best.model])
        pred = best.model.transform(y).select("ci_name", "event_date_time", M.TARGET, "y_pred", "cluster")
        pred = pred.withColumn("residual", S.residuals(pred))
        return fits, pipe, pred
    finally:
        train.unpersist()
        test.unpersist()


def run(spark: SparkSession, df: DataFrame, clusters: DataFrame, out: str, static: DataFrame | None = None, **options) -> DataFrame:
    """All clusters; a failing cluster is reported and skipped. Returns the comparison table."""
    joined = S.join_clusters(df, clusters)
    write_result(S.cluster_summary(joined), f"{out}/cluster_summary")
    write_result(prepared(joined, static), f"{out}/prepared", partition_by=["cluster"])
    data = spark.read.parquet(f"{out}/prepared")
    rows = []
    for (c,) in sorted(tuple(r) for r in data.select("cluster").distinct().collect()):
        try:
            fits, pipe, pred = run_cluster(data.filter(F.col("cluster") == c), **options)
        except Exception as err:
            rows.append((c, None, None, None, None, None, None, None, f"{type(err).__name__}: {err}"))
            continue
        best = M.best_fit(fits)
        for f in fits:
            s = f.scores
            rows.append((c, f.name, f.cv_rmse if f.model else None, s.get("rmse"), s.get("mae"), s.get("r2"), s.get("mape"),
                         s.get("smape"), "best" if f is best else f.error))
        save_model(pipe, f"{out}/models/cluster={c}")
        write_result(pred.drop("cluster"), f"{out}/predictions/cluster={c}")
    table = spark.createDataFrame(
        rows, "cluster int, model string, cv_rmse double, rmse double, mae double, r2 double, mape double, smape double, note string")
    write_result(table, f"{out}/comparison")
    return table


def compare(fits: list[M.Fit], spark: SparkSession, cluster: int) -> DataFrame:
    rows = [(cluster, f.name, f.cv_rmse, f.scores.get("rmse"), f.scores.get("mae"), f.scores.get("r2")) for f in fits if f.model]
    return spark.createDataFrame(rows, "cluster int, model string, cv_rmse double, rmse double, mae double, r2 double")


def predictions(spark: SparkSession, out: str) -> DataFrame:
    """Union of every cluster's predictions by one partitioned read."""
    return spark.read.parquet(f"{out}/predictions")
