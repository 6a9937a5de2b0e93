"""Elastic clustering: compare distances over the whole fleet, assign it with the best."""

from __future__ import annotations

from pyspark.sql import DataFrame

from pulsegrid.functions import elastic as K
from pulsegrid.operators import elastic as X, evaluate as E, series as S
from pulsegrid.session import settle


def compare_distances(series: DataFrame, names: tuple[str, ...] = tuple(K.DISTANCES), ks: tuple[int, ...] = X.K_RANGE,
                      seed: int = 42) -> tuple[DataFrame, DataFrame, dict]:
    """Scored runs, labels and medoids of every distance and ``k``, over all series."""
    found = X.fleet_medoids(series, tuple((name, k) for name in names for k in ks), seed)
    labels = settle(X.label_fleet(series, found))
    return X.score_runs(series, labels), labels, found


def cluster_fleet(df: DataFrame, names: tuple[str, ...] = tuple(K.DISTANCES), ks: tuple[int, ...] = X.K_RANGE,
                  seed: int = 42) -> tuple[DataFrame, DataFrame]:
    """Assignments of every fenced series and the best setting per distance."""
    series = settle(S.prepare_series(df))
    runs, _, found = compare_distances(series, names, ks, seed)
    best = E.best_per_group(runs).persist()
    top = best.orderBy(best["combined_score"].desc(), "distance").first()
    medoids = [(c, v) for c, (_, v) in enumerate(found[top["distance"], top["k"]])]
    return X.assign_fleet(series, medoids, top["distance"]), best
