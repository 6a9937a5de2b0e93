"""Linear models of all clusters, folds and penalties from one scan of the rows.

Rows are reduced to sums of products for each cluster and time slice. Such sums
add up: an expanding fold trains on the slices before it, and errors on other
slices follow from their sums, too. So neither a further fold nor a further
penalty nor a further cluster reads the rows again.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from pulsegrid.operators.forecast import LINEAR, TARGET, draw

#: The slice of the test rows; training slices count from 0.
TEST = -1
#: Sums of so many clusters and slices are held in a task before they are passed on.
HELD = 512
_FITS = ("cluster long, model string, alpha double, l1_ratio double, cv_rmse double, n_train long, n_test long, test_rmse double, "
         "test_r2 double, intercept double, coefficients array<double>, is_best boolean")


def time_slices(df: DataFrame, folds: int = 5, time: str = "event_date_time", test: str | None = "is_test") -> DataFrame:
    """``df`` with ``slice``: each cluster's training span in ``folds + 1`` equal parts, -1 for test rows."""
    train = F.lit(True) if test is None else F.col(test) == 0
    seconds = F.unix_timestamp(time)
    spans = df.where(train).groupBy("cluster").agg(F.min(seconds).alias("_lo"), F.max(seconds).alias("_hi"))
    part = sum((seconds >= F.col("_lo") + F.floor((F.col("_hi") - F.col("_lo")) * i / (folds + 1))).cast("int") for i in range(1, folds + 1))
    return df.join(spans, "cluster").withColumn("slice", F.when(train, part).otherwise(TEST)).drop("_lo", "_hi")


def gram_sums(df: DataFrame, features: Sequence[str], target: str = TARGET) -> DataFrame:
    """``(cluster, slice, pos, total)``: sums of the products of any two of 1, the features and the target, rows without null.

    ``pos`` counts the upper triangle row by row. Tasks multiply matrices and pass on a triangle for each cluster and slice.
    """
    width = len(features) + 2
    upper = np.triu_indices(width)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[tuple[int, int], np.ndarray] = {}

        def passed_on() -> pa.RecordBatch:
            n = len(upper[0])
            keys = np.array(list(held), np.int64).reshape(-1, 2)
            total = np.concatenate([m[upper] for m in held.values()]) if held else np.zeros(0)
            return pa.RecordBatch.from_pydict({"cluster": np.repeat(keys[:, 0], n), "slice": np.repeat(keys[:, 1], n).astype(np.int32),
                                               "pos": np.tile(np.arange(n, dtype=np.int32), len(held)), "total": total})

        for batch in batches:
            cols = [c.to_numpy(zero_copy_only=False) for c in batch.columns[:2]]
            numbers = batch.columns[2].flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, width - 1)
            rows = np.column_stack([np.ones(batch.num_rows), numbers])
            order = np.lexsort((cols[1], cols[0]))
            keys = np.column_stack([cols[0], cols[1]])[order]
            cuts = np.flatnonzero(np.r_[True, (keys[1:] != keys[:-1]).any(axis=1), True]) if len(keys) else [0]
            for lo, hi in zip(cuts, cuts[1:]):
                x = rows[order[lo:hi]]
                key = (int(keys[lo, 0]), int(keys[lo, 1]))
                held[key] = held.get(key, 0) + x.T @ x
            if len(held) >= HELD:
                yield passed_on()
                held = {}
        yield passed_on()

    # one array: a filter on many columns that are renamed one by one would be restated for every subset of the names
    numbers = F.array(*[F.col(f"`{c}`").cast("double") for c in (*features, target)])
    kept = df.select(F.col("cluster").cast("long").alias("cluster"), F.col("slice").cast("int").alias("slice"), numbers.alias("numbers"))
    kept = kept.where("cluster IS NOT NULL AND slice IS NOT NULL").where(~F.exists("numbers", lambda v: v.isNull() | F.isnan(v)))
    partial = kept.mapInArrow(run, "cluster long, slice int, pos int, total double")
    return partial.groupBy("cluster", "slice", "pos").agg(F.sum("total").alias("total"))


def _moments(m: np.ndarray) -> tuple[float, np.ndarray, np.ndarray, np.ndarray, np.ndarray, float]:
    """Rows, means, deviations, standardised X'X / n and X'y / n, and the target's mean."""
    n = m[0, 0]
    mean = m[0, 1:] / n
    cov = m[1:, 1:] / n - np.outer(mean, mean)
    var = np.diag(cov)[:-1]
    std = np.sqrt(np.where(var > 1e-10 * np.maximum(1, mean[:-1] ** 2), var, 0))  # 0: does not vary
    scale = np.where(std > 0, 1 / np.where(std > 0, std, 1), 0)
    return n, mean[:-1], scale, cov[:-1, :-1] * np.outer(scale, scale), cov[:-1, -1] * scale, mean[-1]


def solve(m: np.ndarray, model: str, params: dict) -> tuple[np.ndarray, float]:
    """Coefficients and intercept for the sums ``m``, on standardised features.

    Ridge adds ``alpha`` to the diagonal of X'X (Cholesky); lasso and elastic net weigh the mean squared error by one half
    (coordinate descent on the sums); plain regression takes the shortest solution where features depend on each other.
    """
    n, mean, scale, xx, xy, y_mean = _moments(m)
    if model == "linear":
        b = np.linalg.lstsq(xx, xy, rcond=1e-10)[0]
    elif model == "ridge":
        factor = np.linalg.cholesky(xx + np.eye(len(xx)) * params["alpha"] / n)
        b = np.linalg.solve(factor.T, np.linalg.solve(factor, xy))
    else:
        b = _descent(xx, xy, params["alpha"], params.get("l1_ratio", 1.0))
    b = b * scale
    return b, float(y_mean - b @ mean)


def _descent(xx: np.ndarray, xy: np.ndarray, alpha: float, ratio: float, sweeps: int = 200, least: float = 1e-5) -> np.ndarray:
    b, fit = np.zeros(len(xy)), np.zeros(len(xy))
    bound = least * max(1e-12, float(np.abs(xy).max(initial=0)))
    for _ in range(sweeps):
        moved = 0.0
        for j in np.flatnonzero(np.diag(xx)):
            rest = xy[j] - fit[j] + xx[j, j] * b[j]
            new = np.sign(rest) * max(abs(rest) - alpha * ratio, 0) / (xx[j, j] + alpha * (1 - ratio))
            if new != b[j]:
                fit += xx[:, j] * (new - b[j])
                moved = max(moved, abs(new - b[j]))
                b[j] = new
        if moved <= bound:
            break
    return b


def squared_error(m: np.ndarray, b: np.ndarray, intercept: float) -> float:
    """The sum of squared errors of a model on the rows behind ``m``."""
    w = np.concatenate([[intercept], b, [-1.0]])
    return max(float(w @ m @ w), 0.0)


def _rmse(m: np.ndarray, b: np.ndarray, intercept: float) -> float:
    return float(np.sqrt(squared_error(m, b, intercept) / m[0, 0]))


def _options(model: str, trials: int, seed: int) -> list[dict]:
    rng = np.random.default_rng([seed, LINEAR.index(model)])
    return [draw(model, rng) for _ in range(1 if model == "linear" else trials)]


def fit_models(sums: DataFrame, features: Sequence[str], models: Sequence[str] = LINEAR, trials: dict[str, int] | int = 25, folds: int = 5, seed: int = 42) -> DataFrame:
    """A row for each cluster and model, with the penalty that has the least mean RMSE over the expanding folds.

    Fold f trains on the slices before f and is measured on slice f; a fold without rows on either side is left out. The
    model is fitted again on all training slices; ``test_rmse`` and ``test_r2`` are on the test slice (null without rows).
    ``is_best`` marks the cluster's least ``cv_rmse``. Clusters without training rows have no row. A task sees a cluster's
    sums, whose number does not depend on its rows.
    """
    width = len(features) + 2
    upper = np.triu_indices(width)
    options = {m: _options(m, trials if isinstance(trials, int) else trials.get(m, 1), seed) for m in models}

    def run(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        slices = np.zeros((folds + 2, width, width))  # the last one holds the test rows
        np.add.at(slices, (rows["slice"].to_numpy(), upper[0][rows["pos"]], upper[1][rows["pos"]]), rows["total"])
        slices += np.triu(slices, 1).transpose(0, 2, 1)
        before = np.cumsum(slices[:-1], axis=0)
        every, test = before[-1], slices[TEST]
        checks = [(before[f - 1], slices[f]) for f in range(1, folds + 1) if before[f - 1][0, 0] > 1 and slices[f][0, 0]]
        out = []
        for model, tried in options.items():
            if every[0, 0] < 2:
                break
            scores = [np.mean([_rmse(valid, *solve(train, model, p)) for train, valid in checks]) if checks else np.nan for p in tried]
            k = int(np.nanargmin(scores)) if checks else 0
            b, intercept = solve(every, model, tried[k])
            n = test[0, 0]
            spread = test[-1, -1] - test[0, -1] ** 2 / n if n else 0.0
            out.append((key[0], model, tried[k].get("alpha"), tried[k].get("l1_ratio"), scores[k], int(every[0, 0]), int(n), _rmse(test, b, intercept) if n else None,
                        1 - squared_error(test, b, intercept) / spread if spread > 0 else None, intercept, b.tolist(), False))
        table = pd.DataFrame(out, columns=[c.split()[0] for c in _FITS.split(", ")])
        if len(table) and table["cv_rmse"].notna().any():
            table.loc[table["cv_rmse"].idxmin(), "is_best"] = True
        return table

    return sums.groupBy("cluster").applyInPandas(run, _FITS)


def linear_models(df: DataFrame, features: Sequence[str], models: Sequence[str] = LINEAR, trials: dict[str, int] | int = 25, folds: int = 5,
                  seed: int = 42, target: str = TARGET, test: str | None = "is_test") -> DataFrame:
    """``fit_models`` of the rows ``(cluster, event_date_time, features, target[, is_test])``, all clusters in one job.

    Rows with a null among features or target, or without a cluster, are left out.
    """
    known = df.dropna(subset=[*features, target])
    return fit_models(gram_sums(time_slices(known, folds, test=test), features, target), features, models, trials, folds, seed)


def prediction(features: Sequence[str], coefficients: str = "coefficients", intercept: str = "intercept") -> Column:
    terms = [F.col(coefficients)[k] * F.col(f"`{c}`").cast("double") for k, c in enumerate(features)]
    return sum(terms, F.col(intercept))


def predict(df: DataFrame, fits: DataFrame, features: Sequence[str]) -> DataFrame:
    """``df`` with ``model`` and ``y_pred`` of its cluster's best model; the join's small side has a row for each cluster."""
    best = fits.where("is_best").select("cluster", "model", "intercept", "coefficients")
    return df.join(best, "cluster").withColumn("y_pred", prediction(features)).drop("intercept", "coefficients")
