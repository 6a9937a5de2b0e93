"""Design matrix, regression models, time-ordered validation and random search."""

from __future__ import annotations

import math
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass, field

import numpy as np
from pyspark.ml import Model, Pipeline, PipelineModel
from pyspark.ml.feature import OneHotEncoder, StringIndexer, VectorAssembler, VectorSlicer
from pyspark.ml.regression import GBTRegressor, LinearRegression, RandomForestRegressor
from pyspark.ml.stat import Correlation
from pyspark.sql import DataFrame, functions as F

from pulsegrid.operators import split as S

TARGET = "event_value"
LINEAR = ("linear", "ridge", "lasso", "elastic_net")
MODELS = (*LINEAR, "forest", "boosting")

# Columns that never enter the design matrix.
EXCLUDED = {
    "event_value", "event_date_time", "event_date", "cluster", "ci_name", "site_name", "site_city", "site_country",
    "site_business_hours", "service_line", "is_test",
}

# Search ranges; (low, high, scale) with scale log, int or lin.
SPACE: dict[str, dict[str, tuple[float, float, str]]] = {
    "linear": {},
    "ridge": {"alpha": (1e-3, 10.0, "log")},
    "lasso": {"alpha": (1e-4, 1.0, "log")},
    "elastic_net": {"alpha": (1e-4, 1.0, "log"), "l1_ratio": (0.0, 1.0, "lin")},
    "forest": {"trees": (100, 300, "int"), "depth": (8, 20, "int"), "leaf": (1, 10, "int")},
    "boosting": {"trees": (100, 400, "int"), "rate": (0.01, 0.2, "log"), "depth": (2, 6, "int"), "share": (0.6, 1.0, "lin")},
}


@dataclass
class Fit:
    name: str
    params: dict
    cv_rmse: float
    model: Model | None = None
    scores: dict = field(default_factory=dict)
    error: str | None = None


def feature_columns(df: DataFrame) -> tuple[list[str], list[str]]:
    """Numeric and text columns of the design matrix."""
    cols = [(c, t) for c, t in df.dtypes if c not in EXCLUDED]
    return [c for c, t in cols if t not in ("string", "timestamp", "timestamp_ntz", "date")], [c for c, t in cols if t == "string"]


def design(train: DataFrame, numeric: list[str], categorical: list[str]) -> PipelineModel:
    """Sparse one-hot codes learned on the training rows only, and features that no others add up to.

    Unseen values get a code of their own. Constant features and those that are linear in the ones before them are left
    out, so a linear model has one solution.
    """
    stages: list = []
    inputs = list(numeric)
    if categorical:
        codes = [f"_code_{c}" for c in categorical]
        stages.append(StringIndexer(inputCols=categorical, outputCols=codes, handleInvalid="keep"))
        hot = [f"_hot_{c}" for c in categorical]
        stages.append(OneHotEncoder(inputCols=codes, outputCols=hot, handleInvalid="keep"))
        inputs += hot
    stages.append(VectorAssembler(inputCols=inputs, outputCol="_all", handleInvalid="skip"))
    shape = Pipeline(stages=stages).fit(train)
    keep = independent(shape.transform(train).select("_all"), "_all")
    slicer = VectorSlicer(inputCol="_all", outputCol="features", indices=keep)
    return PipelineModel(stages=[*shape.stages, slicer])


def independent(df: DataFrame, column: str, least: float = 1e-6) -> list[int]:
    """Positions of the vector's entries that vary and are not linear in the kept ones before them.

    One pass gives the correlations; an entry stays if the share of its variance that the kept ones leave is ``least``.
    """
    corr = np.asarray(Correlation.corr(df, column).first()[0].toArray())
    kept: list[int] = []
    rest: list[np.ndarray] = []
    for j in np.flatnonzero(np.isfinite(corr).sum(axis=1) > 1) if len(corr) > 1 else range(len(corr)):
        row = np.nan_to_num(corr[j]).copy()
        for other, base in zip(kept, rest):
            row -= base[j] / base[other] * base
        if row[j] > least:
            kept.append(int(j))
            rest.append(row)
    return kept or [0]


def estimator(name: str, params: dict, rows: int, seed: int = 42):
    """Penalties are stated per training row, so a ridge weight is divided by the row count."""
    common = {"featuresCol": "features", "labelCol": TARGET, "predictionCol": "y_pred"}
    if name in LINEAR:
        reg = {"linear": (0.0, 0.0), "ridge": (params.get("alpha", 1.0) / max(rows, 1), 0.0),
               "lasso": (params.get("alpha", 0.01), 1.0),
               "elastic_net": (params.get("alpha", 0.01), params.get("l1_ratio", 0.5))}[name]
        return LinearRegression(regParam=reg[0], elasticNetParam=reg[1], standardization=True, maxIter=200, **common)
    if name == "forest":
        return RandomForestRegressor(numTrees=params.get("trees", 100), maxDepth=params.get("depth", 12),
                                     minInstancesPerNode=params.get("leaf", 2), featureSubsetStrategy="sqrt",
                                     subsamplingRate=params.get("sample", 0.2), seed=seed, **common)
    if name == "boosting":
        return GBTRegressor(maxIter=params.get("trees", 100), stepSize=params.get("rate", 0.1), maxDepth=params.get("depth", 4),
                            subsamplingRate=params.get("share", 0.8), seed=seed, **common)
    raise ValueError(f"unknown model {name}")


def draw(name: str, rng: np.random.Generator, space: dict | None = None) -> dict:
    out: dict = {}
    for key, (lo, hi, scale) in (space or SPACE)[name].items():
        if scale == "int":
            out[key] = int(rng.integers(lo, hi + 1))
        else:
            u = rng.uniform(math.log(lo), math.log(hi)) if scale == "log" else rng.uniform(lo, hi)
            out[key] = float(math.exp(u) if scale == "log" else u)
    return out


def cross_validate(data: DataFrame, bounds: list, name: str, params: dict) -> float:
    """Mean RMSE over expanding folds cut on event time."""
    scores = []
    for b in bounds:
        ts = F.col("event_date_time")
        train = data.filter(ts < F.lit(b["valid_from"]))
        last = b is bounds[-1]
        upper = ts <= F.lit(b["valid_to"]) if last else ts < F.lit(b["valid_to"])
        valid = data.filter((ts >= F.lit(b["valid_from"])) & upper)
        rows = train.count()
        if rows < 2:
            continue
        pred = estimator(name, params, rows).fit(train).transform(valid)
        rmse = S.forecast_metrics(pred).first()["rmse"]
        if rmse is not None:
            scores.append(rmse)
    return float(np.mean(scores)) if scores else math.inf


def search(data: DataFrame, name: str, trials: int, folds: int = 5, seed: int = 42, space: dict | None = None,
           threads: int = 4, rows: int | None = None) -> Fit:
    """Seeded random search; trials run side by side as Spark jobs. All rows are used unless the caller asks for about ``rows``."""
    ranges = (space or SPACE)[name]
    rng = np.random.default_rng([seed, MODELS.index(name)])
    options = [draw(name, rng, space) for _ in range(trials if ranges else 1)]
    tune = (data if rows is None else S.hash_sample(data, rows, ["ci_name", "event_date_time"], seed)).persist()
    try:
        bounds = S.fold_bounds(tune, folds).orderBy("fold").collect()
        with ThreadPoolExecutor(max_workers=threads) as pool:
            scored = list(pool.map(lambda p: cross_validate(tune, bounds, name, p), options))
    finally:
        tune.unpersist()
    best = int(np.argmin(scored))
    return Fit(name, options[best], scored[best])


def tune_and_fit(train: DataFrame, test: DataFrame, name: str, trials: int, folds: int = 5, seed: int = 42,
                 space: dict | None = None) -> Fit:
    """Search, refit on every training row, score on the test rows. A failing model reports its error."""
    try:
        fit = search(train, name, trials, folds, seed, space)
        fit.model = estimator(name, fit.params, train.count(), seed).fit(train)
        fit.scores = S.forecast_metrics(fit.model.transform(test)).first().asDict()
        return fit
    except Exception as err:  # one model must not stop the others
        return Fit(name, {}, math.inf, error=f"{type(err).__name__}: {err}")


def best_fit(fits: list[Fit]) -> Fit:
    """Lowest validation error; the test rows are only reported."""
    usable = [f for f in fits if f.model is not None]
    if not usable:
        raise RuntimeError("; ".join(f"{f.name}: {f.error}" for f in fits))
    return min(usable, key=lambda f: f.cv_rmse)
