"""Feature table of the fleet and feature-based clustering."""

from __future__ import annotations

from functools import reduce

from pyspark import StorageLevel
from pyspark.sql import DataFrame, functions as F

from pulsegrid.operators import cluster as C, evaluate as E, features as X, prepare as P, series_kernels as K
from pulsegrid.session import cut_lineage, settle

REPRESENTATIONS = ("original", "pca", "power", "quantile")


def feature_table(df: DataFrame, static: list[str] | None = None, kernels: bool = True) -> DataFrame:
    """One wide row per item. The hourly base is shuffled by item once and kept; every
    feature block and every join of blocks reuses that partitioning."""
    base = X.base(df).persist(StorageLevel.MEMORY_AND_DISK)
    blocks = [f(base) for f in X.SQL_FEATURES]
    if kernels:
        blocks.append(K.kernel_table(base))
    if static:
        blocks.append(X.static_first(df, static))
    return cut_lineage(reduce(lambda a, b: a.join(b, "ci_name", "left"), blocks))


def select_columns(table: DataFrame, cols: list[str]) -> list[str]:
    """Drop nearly constant columns, then the later of every strongly correlated pair."""
    kept = P.variance_keep(table, cols)
    gone = set(P.correlated_drop(table, kept))
    return [c for c in kept if c not in gone]


def numeric_columns(table: DataFrame) -> list[str]:
    return [c for c, t in table.dtypes if c != "ci_name" and t in ("double", "bigint", "int", "float")]


def clean_table(table: DataFrame) -> tuple[DataFrame, list[str]]:
    """Impute, remove outliers, select columns."""
    cols = numeric_columns(table)
    full = settle(P.impute_median_mode(table, cols, [c for c, t in table.dtypes if t == "string" and c != "ci_name"]))
    cols = [c for c in cols if c not in {r["column_name"] for r in P.null_report(full, cols).filter("missing_values > 0").collect()}]
    kept = settle(P.drop_outliers(full, "ci_name", cols))
    return kept, select_columns(kept, cols)


def as_vectors(table: DataFrame, cols: list[str], categorical: list[str] | None = None) -> DataFrame:
    return P.encode(table, cols, categorical or []).select(F.col("ci_name").alias("item"), "vec")


def represent(table: DataFrame, cols: list[str], kind: str) -> DataFrame:
    """Vectors under one of the compared representations."""
    if kind == "original":
        return as_vectors(table, cols)
    if kind == "pca":
        return P.pca_scores(as_vectors(table, cols), k=20).select("item", F.col("scores").alias("vec"))
    moved = P.power_transform(table, cols) if kind == "power" else P.quantile_normal(table.select("ci_name", *[
        F.col(c).cast("double").alias(c) for c in cols]), cols)
    return as_vectors(moved, cols)


def best_kmeans(vectors: DataFrame, ks: tuple[int, ...], restarts: int = 20) -> tuple[float, int, DataFrame]:
    """Highest silhouette over ``ks``."""
    data = settle(vectors)
    labels = settle(C.kmeans(data, ks, restarts))
    scores = E.silhouette_runs(data, labels.select(F.col("k").cast("string").alias("run_id"), "item", "label"))
    found = [(r["silhouette"], int(r["run_id"])) for r in scores.collect()]
    score, k = max(found, key=lambda t: (t[0], -t[1]))
    return score, k, labels.filter(F.col("k") == k).select("item", "label")


def time_profile(table: DataFrame, ks: tuple[int, ...] = (2, 3, 4, 5), restarts: int = 20) -> tuple[float, int, DataFrame]:
    """Clusters of daily and weekly shape from the profile columns alone."""
    have = [c for c in P.PROFILE_COLUMNS if c in table.columns]
    return best_kmeans(as_vectors(table, have), ks, restarts)


def subspaces(table: DataFrame, cols: list[str], restarts: int = 20) -> dict[str, tuple[float, DataFrame]]:
    """Two clusters per feature group that has at least two features."""
    out = {}
    for group, members in P.feature_groups(cols).items():
        if len(members) >= 2:
            score, _, labels = best_kmeans(as_vectors(table, members), (2,), restarts)
            out[group] = (score, labels)
    return out


def informed_columns(table: DataFrame, cols: list[str], top: int = 50) -> tuple[list[str], list[str]]:
    """Columns that best tell two starting clusters apart, by mutual information and by forest importance."""
    labels = C.kmeans(as_vectors(table, cols), (2,)).select(F.col("item").alias("ci_name"), "label")
    joined = table.join(labels, "ci_name")
    mi = P.binned_mutual_information(joined, cols, "label", discrete=True)
    forest = P.classification_importance(joined, cols, "label")
    best = lambda t, c: [r["feature"] for r in t.orderBy(F.desc(c), "feature").limit(top).collect()]
    return best(mi, "mi"), best(forest, "importance")


def sweep(representations: dict[str, DataFrame], ks: tuple[int, ...] = tuple(range(2, 11)), few: tuple[int, ...] = (2, 3, 4),
          restarts: int = 20, eps: tuple[float, ...] = (0.5, 1.0, 1.5, 2.0, 3.0, 5.0, 7.0, 10.0),
          mins: tuple[int, ...] = (5, 10, 15, 20), algorithms: tuple[str, ...] = ("kmeans", "kmedoids", "gmm", "bisecting", "dbscan"),
          ) -> tuple[DataFrame, DataFrame]:
    """Every algorithm on its representations: a table of runs and a table of assignments."""
    labelled: list[DataFrame] = []

    def add(run_id: str, rep: str, labels: DataFrame) -> None:
        labelled.append(labels.select(F.lit(run_id).alias("run_id"), F.lit(rep).alias("rep"), F.col("item").cast("string").alias("item"),
                                      F.col("label").cast("string").alias("label")))

    data = {r: settle(v) for r, v in representations.items()}
    for rep, vectors in data.items():
        if "kmeans" in algorithms:
            span = ks if rep in ("original", "pca") else few
            labels = settle(C.kmeans(vectors, span, restarts))
            for k in span:
                add(f"kmeans_{rep}_k{k}", rep, labels.filter(F.col("k") == k))
    base = data.get("original", next(iter(data.values())))
    name = "original" if "original" in data else next(iter(data))
    if "kmedoids" in algorithms:
        labels = settle(C.kmedoids_vectors(base, ks))
        for k in ks:
            add(f"kmedoids_k{k}", name, labels.filter(F.col("k") == k))
    for k in ks:
        if "gmm" in algorithms:
            for kind in ("full", "tied", "diag"):
                add(f"gmm_{kind}_k{k}", name, C.gmm(base, k, kind))
        if "bisecting" in algorithms:
            add(f"bisecting_k{k}", name, C.bisecting(base, k))
    if "dbscan" in algorithms:
        grid = settle(C.dbscan_grid(base, eps, mins))
        for (run_id,) in sorted(tuple(r) for r in grid.select("run_id").distinct().collect()):
            add(run_id, name, grid.filter(F.col("run_id") == run_id))
    assignments = settle(reduce(DataFrame.unionByName, labelled))
    return score_assignments(data, assignments), assignments


def score_assignments(data: dict[str, DataFrame], assignments: DataFrame) -> DataFrame:
    """Scores of every run; a run with one label gets -1 everywhere. All runs of a representation are scored together."""
    scored = []
    for rep in sorted(r["rep"] for r in assignments.select("rep").distinct().collect()):
        vectors = data[rep].withColumn("item", F.col("item").cast("string"))
        labels = assignments.filter(F.col("rep") == rep).select("run_id", "item", "label")
        joined = labels.join(vectors.select("item", "vec"), "item")
        scored.append(E.silhouette_runs(vectors, labels).join(E.centre_scores(joined, ["run_id"]), "run_id")
                      .join(E.cluster_sizes(labels, ["run_id"]), "run_id", "left").withColumn("rep", F.lit(rep)))
    none = F.array().cast("array<bigint>")
    return settle(reduce(DataFrame.unionByName, scored).select(
        "run_id", "rep", F.coalesce("n_clusters", F.lit(0)).cast("int").alias("n_clusters"), "silhouette", "calinski_harabasz",
        "davies_bouldin", F.coalesce("counts", none).alias("counts")))


def report(table: DataFrame, cols: list[str], labels: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Cluster means and the features that set the clusters apart."""
    rows = table.withColumnRenamed("ci_name", "item")
    means = E.cluster_means(rows, labels, cols)
    return means, E.importance_by_variance(means, cols)


