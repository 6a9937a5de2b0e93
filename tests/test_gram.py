"""Models from sums of products against fits and errors on the rows."""

import numpy as np
import pandas as pd
import pytest

from pulsegrid.operators import gram as G

FEATURES = ["a", "b", "c"]


def data(seed=3, n=400):
    rng = np.random.default_rng(seed)
    x = rng.normal(size=(n, 3)) * [1, 10, 3] + [5, 100, 0]
    cluster = rng.integers(0, 2, n)
    y = x @ [2, -.3, 0] * np.where(cluster, 1, -1) + rng.normal(size=n) + 7
    time = pd.Timestamp("2024-01-01") + pd.to_timedelta(rng.permutation(n), unit="h")
    return pd.DataFrame({"cluster": cluster, "event_date_time": time, "a": x[:, 0], "b": x[:, 1], "c": x[:, 2], "event_value": y,
                         "is_test": (time >= pd.Timestamp("2024-01-14")).astype(int)})


def plain(train):
    x = np.column_stack([np.ones(len(train)), train[FEATURES]])
    return np.linalg.lstsq(x, train["event_value"], rcond=None)[0]


def rmse(rows, w):
    return float(np.sqrt(np.mean((np.column_stack([np.ones(len(rows)), rows[FEATURES]]) @ w - rows["event_value"]) ** 2)))


def test_plain_regression_folds_and_test_rows(spark):
    frame = data()
    holes = pd.concat([frame, frame.head(3).assign(a=np.nan), frame.head(2).assign(cluster=None)])
    rows = spark.createDataFrame(holes).repartition(5)
    rows = rows.replace(float("nan"), None, subset=["a", "cluster"])
    fits = {r["cluster"]: r for r in G.linear_models(rows, FEATURES, ("linear",)).collect()}
    assert set(fits) == {0, 1}
    for c, r in fits.items():
        own = frame[frame.cluster == c]
        train, test = own[own.is_test == 0], own[own.is_test == 1]
        t = train.event_date_time.astype("int64") // 10 ** int(np.log10(train.event_date_time.astype("int64").max() / 1.7e9))
        part = sum((t >= t.min() + (t.max() - t.min()) * i // 6).astype(int) for i in range(1, 6))
        scores = [rmse(train[part == f], plain(train[part < f])) for f in range(1, 6)]
        w = plain(train)
        assert r["n_train"] == len(train) and r["n_test"] == len(test) and r["is_best"]
        assert np.allclose([r["intercept"], *r["coefficients"]], w, rtol=1e-6) and np.isclose(r["cv_rmse"], np.mean(scores), rtol=1e-6)
        assert np.isclose(r["test_rmse"], rmse(test, w), rtol=1e-6)
        assert np.isclose(r["test_r2"], 1 - len(test) * rmse(test, w) ** 2 / ((test.event_value - test.event_value.mean()) ** 2).sum(), rtol=1e-6)


@pytest.mark.parametrize("model,params", [("ridge", {"alpha": 5.0}), ("lasso", {"alpha": 0.2}), ("elastic_net", {"alpha": 0.3, "l1_ratio": 0.4})])
def test_penalties_reach_their_optimum(model, params):
    frame = data()
    x, y = frame[FEATURES].to_numpy(), frame["event_value"].to_numpy()
    rows = np.column_stack([np.ones(len(x)), x, y])
    b, intercept = G.solve(rows.T @ rows, model, params)
    std = x.std(axis=0)
    beta, rest = b * std, y - x @ b - intercept
    slope = ((x - x.mean(axis=0)) / std).T @ rest / len(x)
    assert np.isclose(rest.mean(), 0, atol=1e-8)
    if model == "ridge":
        assert np.allclose(slope, params["alpha"] * beta / len(x), atol=1e-8)
    else:
        l1, l2 = params["alpha"] * params.get("l1_ratio", 1), params["alpha"] * (1 - params.get("l1_ratio", 1))
        for s, w in zip(slope, beta):
            assert np.isclose(s - l2 * w, l1 * np.sign(w), atol=1e-4) if w else abs(s) <= l1 + 1e-4


def test_constant_and_dependent_features_and_predictions(spark):
    frame = data().assign(d=4.0, e=lambda x: 2 * x.a + 1)
    rows = spark.createDataFrame(frame)
    names = [*FEATURES, "d", "e"]
    fits = G.linear_models(rows, names, trials=4)
    got = fits.collect()
    assert len(got) == 8 and sum(r["is_best"] for r in got) == 2 and all(r["coefficients"][3] == 0 for r in got)
    scored = G.predict(rows.where("is_test = 1"), fits, names).toPandas()
    for r in got:
        if r["is_best"]:
            own = scored[scored.cluster == r["cluster"]]
            assert np.isclose(np.sqrt(((own.y_pred - own.event_value) ** 2).mean()), r["test_rmse"], rtol=1e-6)


def test_many_features_and_predictions(spark):
    """Filters above the sums must not be planned for every subset of the features."""
    rng = np.random.default_rng(4)
    frame = data(n=200)
    names = [f"x{k}" for k in range(30)]
    frame[names] = rng.normal(size=(len(frame), 30))
    frame.loc[frame.index[:3], "x7"] = np.nan
    rows = spark.createDataFrame(frame)
    fits = G.linear_models(rows, names, ("linear", "ridge"), trials=2)
    assert {r["cluster"]: r["n_train"] + r["n_test"] for r in fits.collect()} == frame.dropna(subset=names).groupby("cluster").size().to_dict()
    assert G.predict(rows.where("is_test = 1"), fits, names).count() == int(frame.is_test.sum())


def test_small_and_empty_tables(spark):
    rows = spark.createDataFrame(data(n=60).head(1))
    assert G.linear_models(rows, FEATURES).count() == 0
    assert G.linear_models(rows.limit(0), FEATURES).count() == 0
