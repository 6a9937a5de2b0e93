"""Internal cluster scores and the choice among runs.

Inputs are rows ``(item, vec, label)``; ``by`` names extra columns, such as a run
id, that are scored separately in the same jobs.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.ml.evaluation import ClusteringEvaluator
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import Column, DataFrame, Window, functions as F

from pulsegrid.functions import blocks as B
from pulsegrid.functions.joins import lookup_join


def euclid(a: Column, b: Column) -> Column:
    sq = F.zip_with(a, b, lambda x, y: (x - y) * (x - y))
    return F.sqrt(F.aggregate(sq, F.lit(0.0), lambda s, x: s + x))


def centroids(df: DataFrame, by: list[str] | None = None) -> DataFrame:
    """Size and mean vector of each cluster, from partial sums."""
    keys = [*(by or []), "label"]
    return df.groupBy(*keys).agg(
        F.count("*").alias("size"),
        vector_to_array(Summarizer.mean(array_to_vector(F.col("vec")))).alias("centre"))


def _with_centres(df: DataFrame, by: list[str]) -> tuple[DataFrame, DataFrame]:
    keyed = df.withColumn("_key", F.struct(*by, "label"))
    cents = centroids(df, by).withColumn("_key", F.struct(*by, "label"))
    far = lookup_join(keyed, cents.select("_key", "centre"), "_key", "inner")
    spread = far.withColumn("d", euclid(F.col("vec"), F.col("centre"))).groupBy(*by, "label").agg(
        F.avg("d").alias("scatter"), F.sum(F.col("d") * F.col("d")).alias("within"))
    return cents.drop("_key"), spread


def _grouped(df: DataFrame, by: list[str]) -> tuple[DataFrame, list[str]]:
    return (df, by) if by else (df.withColumn("_all", F.lit(0)), ["_all"])


def centre_scores(df: DataFrame, by: list[str] | None = None) -> DataFrame:
    """Davies-Bouldin and Calinski-Harabasz; only cluster centres are compared with each other."""
    data, keys = _grouped(df, by or [])
    cents, spread = _with_centres(data, keys)
    table = cents.join(spread, [*keys, "label"])
    others = table.groupBy(*keys).agg(
        F.collect_list(F.struct("label", "scatter", "centre", "size")).alias("others"),
        F.sum("size").alias("n_rows"), F.count("*").alias("n_labels"))
    both = table.join(others, keys)
    ratio = F.array_max(F.transform(
        F.filter("others", lambda o: o["label"] != F.col("label")),
        lambda o: F.try_divide(F.col("scatter") + o["scatter"], euclid(F.col("centre"), o["centre"]))))
    dim = F.size("centre")
    grand = F.transform(F.sequence(F.lit(0), dim - 1), lambda i: F.aggregate(
        "others", F.lit(0.0), lambda s, o: s + F.get(o["centre"], i) * o["size"]) / F.col("n_rows"))
    gap = euclid(F.col("centre"), grand)
    out = both.withColumns({"ratio": ratio, "between": F.col("size") * gap * gap}).groupBy(*keys).agg(
        F.avg("ratio").alias("davies_bouldin"),
        F.sum("between").alias("bk"), F.sum("within").alias("wk"), F.max("n_rows").alias("n_rows"),
        F.max("n_labels").alias("n_labels"))
    ch = F.try_divide(F.col("bk") * (F.col("n_rows") - F.col("n_labels")), F.col("wk") * (F.col("n_labels") - 1))
    one = F.col("n_labels") <= 1
    scored = out.select(
        *keys, F.when(one, -1.0).otherwise(F.col("davies_bouldin")).alias("davies_bouldin"),
        F.when(one, -1.0).otherwise(ch).alias("calinski_harabasz"))
    return scored if by else scored.drop("_all")


def _distance_sums(left: pd.DataFrame, right: pd.DataFrame, same: bool, own: np.ndarray, other: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distances from each row of two blocks added up for the clusters of the other block (0/1 columns), a tile at a time."""
    x, y = B.stack(left["vec"]), B.stack(right["vec"])
    near, far = np.zeros((len(x), other.shape[1])), np.zeros((len(y), own.shape[1]))
    for rows, cols, d in B.tiles(x, y) if len(x) and len(y) else ():
        if same and rows == cols:
            np.fill_diagonal(d, 0.0)
        near[rows] += d @ other[cols]
        if not same:
            far[cols] += d.T @ own[rows]
    return near, far


def silhouette_items(df: DataFrame, target: int = B.BLOCK_ROWS) -> DataFrame:
    """Exact Euclidean silhouette of every item.

    Two blocks meet in a task and give distance sums per item and cluster; the
    distances themselves never leave it.
    """
    slim = df.select(F.col("item").cast("string").alias("item"), F.col("label").cast("string").alias("label"), "vec")

    def sums(left: pd.DataFrame, right: pd.DataFrame, same: bool) -> pd.DataFrame:
        def coded(rows):
            names, code = np.unique(rows["label"].to_numpy(dtype=str), return_inverse=True)
            return names, np.eye(len(names))[code]

        def side(rows, names, total):
            return pd.DataFrame({
                "item": np.repeat(rows["item"].to_numpy(), len(names)), "label": np.repeat(rows["label"].to_numpy(), len(names)),
                "other": np.tile(names, len(rows)), "total": total.ravel()})

        (mine, own), (theirs, other) = coded(left), coded(right)
        near, far = _distance_sums(left, right, same, own, other)
        return pd.concat([side(left, theirs, near)] + ([] if same else [side(right, mine, far)]))

    part = B.meet(slim, "item", sums, "item string, label string, other string, total double", target=target, in_strips=True)
    sizes = slim.groupBy("label").agg(F.count("*").alias("size"))
    return _silhouette(part.groupBy("item", "label", "other").agg(F.sum("total").alias("total")), sizes, [])


def _silhouette(sums: DataFrame, sizes: DataFrame, by: list[str]) -> DataFrame:
    own = F.col("other") == F.col("label")
    sized = sums.join(sizes.select(*by, F.col("label").alias("other"), "size"), [*by, "other"])
    per_item = sized.groupBy(*by, "item", "label").agg(
        F.max(F.when(own, F.col("size"))).alias("own_size"),
        F.max(F.when(own, F.try_divide(F.col("total"), F.col("size") - 1))).alias("a"),
        F.min(F.when(~own, F.col("total") / F.col("size"))).alias("b"))
    a, b = F.col("a"), F.col("b")
    s = F.when(F.col("own_size") == 1, 0.0).otherwise(
        F.coalesce(F.try_divide(b - a, F.greatest(a, b)), F.when(b.isNotNull(), 0.0)))
    return per_item.select(*by, "item", "label", s.alias("silhouette"))


def silhouette(df: DataFrame) -> DataFrame:
    """Mean exact silhouette at any size; -1 for a single cluster. The distances grow with the square of the items."""
    if df.select("label").distinct().limit(2).count() <= 1:
        return df.sparkSession.createDataFrame([(-1.0,)], "silhouette double")
    return silhouette_items(df).agg(F.avg("silhouette").alias("silhouette"))


def silhouette_runs(vectors: DataFrame, labels: DataFrame, target: int = B.BLOCK_ROWS) -> DataFrame:
    """``(run_id, silhouette)``: exact mean silhouettes of many labellings ``(run_id, item, label)`` of the same items.

    The distances between two blocks are computed once and added up for the clusters of all runs; a block sends one array
    for each item. A run with one label gets -1; items that a run leaves out do not count in it, and labels of items
    without a vector are ignored.
    """
    known = labels.select("run_id", F.col("item").cast("string").alias("item"), F.col("label").cast("string").alias("label")).join(
        vectors.select(F.col("item").cast("string").alias("item")), "item", "left_semi")
    sizes = known.groupBy("run_id", "label").agg(F.count("*").alias("size"))
    coded = sizes.withColumn("code", F.row_number().over(Window.partitionBy("run_id").orderBy("label")).cast("int") - 1)
    # one row a run
    runs = sorted((r["run_id"], r["n"]) for r in coded.groupBy("run_id").agg(F.count("*").alias("n")).collect())
    if not runs:
        return labels.sparkSession.createDataFrame([], "run_id string, silhouette double")
    codes = known.join(coded.select("run_id", "label", "code"), ["run_id", "label"])
    by_run = codes.groupBy("item").agg(F.map_from_entries(F.collect_list(F.struct("run_id", "code"))).alias("m"))
    own = F.array(*[F.coalesce(F.try_element_at("m", F.lit(run)), F.lit(-1)) for run, _ in runs])
    slim = vectors.select(F.col("item").cast("string").alias("item"), "vec").join(by_run, "item").select("item", "vec", own.alias("codes"))
    widths = [n for _, n in runs]

    def sums(left: pd.DataFrame, right: pd.DataFrame, same: bool) -> pd.DataFrame:
        def coded(rows):
            own = np.stack(rows["codes"].to_numpy())
            return np.hstack([(own[:, r, None] == np.arange(n)[None, :]).astype(float) for r, n in enumerate(widths)])

        near, far = _distance_sums(left, right, same, coded(left), coded(right))
        sides = [(left, near)] + ([] if same else [(right, far)])
        return pd.concat([pd.DataFrame({"item": rows["item"].to_numpy(), "totals": list(total)}) for rows, total in sides])

    part = B.meet(slim, "item", sums, "item string, totals array<double>", target=target, in_strips=True)
    added = part.groupBy("item").agg(vector_to_array(Summarizer.sum(array_to_vector("totals"))).alias("totals"))
    starts = np.cumsum([0, *widths]).tolist()
    pieces = F.array(*[F.struct(F.lit(run).alias("run_id"), F.slice("totals", at + 1, n).alias("totals"))
                       for (run, n), at in zip(runs, starts)])
    long = added.select("item", F.explode(pieces).alias("p")).select("item", "p.run_id", F.posexplode("p.totals").alias("other", "total"))
    mine = codes.select("run_id", "item", F.col("code").alias("label"))
    table = long.join(mine, ["run_id", "item"]).select("run_id", "item", "label", "other", "total")
    items = _silhouette(table, coded.select("run_id", F.col("code").alias("label"), "size"), ["run_id"])
    counts = coded.groupBy("run_id").agg(F.count("*").alias("n_labels"))
    means = items.groupBy("run_id").agg(F.avg("silhouette").alias("mean"))
    return means.join(counts, "run_id").select("run_id", F.when(F.col("n_labels") <= 1, -1.0).otherwise(F.col("mean")).alias("silhouette"))


def silhouette_squared(df: DataFrame) -> DataFrame:
    """Mean silhouette under squared Euclidean distance, in time linear in the items; -1 for a single cluster.

    It is another score than :func:`silhouette`; the caller chooses, never the size.
    """
    if df.select("label").distinct().limit(2).count() <= 1:
        return df.sparkSession.createDataFrame([(-1.0,)], "silhouette_squared_euclidean double")
    codes = df.groupBy("label").agg(F.count("*")).select(
        "label", F.row_number().over(Window.orderBy("label")).cast("double").alias("code"))
    ready = lookup_join(df, codes, "label", "inner").select(array_to_vector("vec").alias("features"), "code")
    score = ClusteringEvaluator(featuresCol="features", predictionCol="code").evaluate(ready)
    return df.sparkSession.createDataFrame([(score,)], "silhouette_squared_euclidean double")


def silhouette_pairs(pairs: DataFrame, labels: DataFrame, by: list[str] | None = None) -> DataFrame:
    """Silhouette per item from a table of pair distances ``(i, j, dist)``.

    ``by`` columns present in both tables are joined on; those only in ``labels``
    repeat the pairs per labelling.
    """
    by = by or []
    shared = [c for c in by if c in pairs.columns]
    both = pairs.select(*shared, F.col("i").alias("item"), F.col("j").alias("peer"), "dist").unionByName(
        pairs.select(*shared, F.col("j").alias("item"), F.col("i").alias("peer"), "dist"))
    mine = labels.select(*by, "item", "label")
    peer = labels.select(*by, F.col("item").alias("peer"), F.col("label").alias("other"))
    wide = both.join(mine, [*shared, "item"]).join(peer, [*by, "peer"])
    sums = wide.groupBy(*by, "item", "label", "other").agg(F.sum("dist").alias("total"))
    # an item alone in its cluster has no pair with it; a zero row keeps it in the result
    own = mine.select(*by, "item", "label", F.col("label").alias("other"), F.lit(0.0).alias("total"))
    sums = sums.unionByName(own).groupBy(*by, "item", "label", "other").agg(F.sum("total").alias("total"))
    sizes = labels.groupBy(*by, "label").agg(F.count("*").alias("size"))
    return _silhouette(sums, sizes, by)


def cluster_means(features: DataFrame, labels: DataFrame, cols: list[str]) -> DataFrame:
    joined = lookup_join(features, labels.select("item", "label"), "item", "inner")
    return joined.groupBy("label").agg(*[F.avg(c).alias(c) for c in cols])


def importance_by_variance(means: DataFrame, cols: list[str], scale: DataFrame | None = None, top: int = 10) -> DataFrame:
    """Features whose cluster means differ most; ``scale`` (one row of deviations) makes them unit-free."""
    wide = means
    if scale is not None:
        dev = scale.select(F.struct(*cols)).scalar()
        wide = means.withColumn("_s", dev).select(
            "label", *[F.try_divide(F.col(c), F.col(f"_s.{c}")).alias(c) for c in cols])
    long = wide.unpivot(["label"], cols, "feature", "mean")
    return long.groupBy("feature").agg(F.var_samp("mean").alias("importance")).orderBy(
        F.desc("importance"), "feature").limit(top)


def mean_series(series: DataFrame, labels: DataFrame) -> DataFrame:
    """Pointwise mean series of each cluster."""
    joined = lookup_join(series, labels.select("ci_name", "cluster"), "ci_name", "inner")
    return (
        joined.select("cluster", F.posexplode("series").alias("pos", "v"))
        .groupBy("cluster", "pos").agg(F.avg("v").alias("mean_value")))


def cluster_sizes(labels: DataFrame, by: list[str] | None = None) -> DataFrame:
    """Sizes per run, noise (-1) left out."""
    keys = by or []
    return (
        labels.filter(F.col("label").cast("string") != "-1").groupBy(*keys, "label").agg(F.count("*").alias("c"))
        .groupBy(*keys).agg(F.array_sort(F.collect_list("c")).alias("counts"), F.count("*").alias("n_clusters")))


# ---------------------------------------------------------------- choosing a run (tables of runs, one row each)

def combined_score(runs: DataFrame, group: str = "distance") -> DataFrame:
    """Mean of the three scores, each scaled to 0-1 within its group of runs."""
    w = Window.partitionBy(group)

    def scaled(c: str) -> Column:
        lo, hi = F.min(c).over(w), F.max(c).over(w)
        return (F.col(c) - lo) / (hi - lo + 1e-10)

    return runs.withColumn(
        "combined_score",
        (scaled("silhouette") + (1 - scaled("davies_bouldin")) + scaled("calinski_harabasz")) / 3)


def best_per_group(scored: DataFrame, group: str = "distance") -> DataFrame:
    """Best ``k`` of each group; ties go to the smaller k."""
    pick = F.max_by(F.struct("k", "silhouette", "davies_bouldin", "calinski_harabasz", "combined_score"),
                    F.struct("combined_score", -F.col("k")))
    return scored.groupBy(group).agg(pick.alias("b")).select(group, "b.*")


def average_rank(col: str, descending: bool, w) -> Column:
    """Rank with ties sharing the mean of their places; missing scores come last."""
    order = F.col(col).desc_nulls_last() if descending else F.col(col).asc_nulls_last()
    peers = F.count("*").over(w.partitionBy(col))
    return F.rank().over(w.orderBy(order)) + (peers - 1) / 2


def rank_sum(runs: DataFrame, top: int = 15) -> DataFrame:
    """Runs by the sum of their ranks; a table of runs has one row per configuration."""
    w = Window
    ranked = runs.withColumns({
        "rank_silhouette": average_rank("silhouette", True, w),
        "rank_calinski": average_rank("calinski_harabasz", True, w),
        "rank_davies": average_rank("davies_bouldin", False, w)})
    total = F.col("rank_silhouette") + F.col("rank_calinski") + F.col("rank_davies")
    return ranked.withColumn("rank_total", total).orderBy("rank_total", "run_id").limit(top)


def balanced_best(runs: DataFrame, share: float = 0.05) -> DataFrame:
    """Highest silhouette among runs whose smallest cluster reaches ``share`` of the largest."""
    c = F.col("counts")
    ok = (F.size(c) > 1) & (F.array_min(c) >= share * F.array_max(c))
    return runs.filter(ok).orderBy(F.desc("silhouette"), "run_id").limit(1)


def best_by_metric(runs: DataFrame) -> DataFrame:
    key = lambda c: F.struct(F.col(c), F.col("run_id"))
    return runs.agg(
        F.min_by("run_id", F.struct(-F.col("silhouette"), F.col("run_id"))).alias("best_silhouette"),
        F.min_by("run_id", F.struct(-F.col("calinski_harabasz"), F.col("run_id"))).alias("best_calinski_harabasz"),
        F.min_by("run_id", key("davies_bouldin")).alias("best_davies_bouldin"))
