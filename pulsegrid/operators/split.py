"""Time-ordered splits, samples and forecast scores."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from pulsegrid.functions.joins import lookup_join


def mark_test(df: DataFrame, days: int = 21, cluster: str = "cluster") -> DataFrame:
    """``is_test`` = 1 for the last ``days`` of each cluster.

    The cluster's end is an aggregate joined back (one row per cluster), not a
    window, so a large cluster is never gathered.
    """
    last = df.groupBy(cluster).agg(F.max("event_date_time").alias("_last"))
    marked = lookup_join(df, last, cluster, "inner")
    cut = F.col("_last") - F.expr(f"INTERVAL {int(days)} DAYS")
    return marked.withColumn("is_test", (F.col("event_date_time") >= cut).cast("int")).drop("_last")


def fold_bounds(df: DataFrame, folds: int = 5) -> DataFrame:
    """Expanding folds cut on event time: fold f trains before ``valid_from``, tests up to ``valid_to``.

    The time span is cut in ``folds + 1`` equal parts.
    """
    span = df.agg(F.min("event_date_time").alias("lo"), F.max("event_date_time").alias("hi"))
    secs = F.timestamp_diff("SECOND", F.col("lo"), F.col("hi"))
    at = lambda i: F.timestamp_add(
        "SECOND", F.floor(secs * i / (folds + 1)).cast("int"), F.col("lo"))
    f = F.col("fold")
    return span.withColumn("fold", F.explode(F.sequence(F.lit(1), F.lit(folds)))).select(
        "fold", F.col("lo").alias("train_from"), at(f).alias("valid_from"), at(f + 1).alias("valid_to")
    )


def forecast_metrics(df: DataFrame, actual: str = "event_value", pred: str = "y_pred",
                     by: list[str] | None = None) -> DataFrame:
    """RMSE, MAE, R², MAPE and SMAPE in one aggregate.

    MAPE leaves zero actuals out and SMAPE zero denominators; null when nothing is left.
    """
    y, p = F.col(actual).cast("double"), F.col(pred).cast("double")
    err = p - y
    total = F.var_pop(y) * F.count(err)
    size = (F.abs(y) + F.abs(p)) / 2
    return df.groupBy(*(by or [])).agg(
        F.count(err).alias("n"),
        F.sqrt(F.avg(err * err)).alias("rmse"),
        F.avg(F.abs(err)).alias("mae"),
        (1 - F.try_divide(F.sum(err * err), total)).alias("r2"),
        (F.avg(F.when(y != 0, F.abs(err / y))) * 100).alias("mape"),
        (F.avg(F.when(size != 0, F.abs(err) / size)) * 100).alias("smape"),
    )


def join_clusters(df: DataFrame, clusters: DataFrame) -> DataFrame:
    return lookup_join(df, clusters.select("ci_name", "cluster"), "ci_name", "inner")


def cluster_summary(df: DataFrame) -> DataFrame:
    pairs = df.groupBy("cluster", "ci_name").agg(F.count("*").alias("c"))
    return pairs.groupBy("cluster").agg(F.count("*").alias("devices"), F.sum("c").alias("n_rows"))


def stratified_sample(df: DataFrame, total: int = 10, seed: int = 42) -> DataFrame:
    """About ``total`` items spread evenly over the clusters, repeatable for a seed.

    Each cluster gives ``ceil(total / clusters)`` items in hash order; a surplus is
    trimmed, and clusters with spare items top a shortage up. Only the ``total``
    lowest ranks of a cluster can be picked, so ranks come from a top-k aggregate.
    """
    pairs = df.select("cluster", "ci_name").distinct()
    key = F.md5(F.concat("ci_name", F.lit(f":{seed}")))
    part = pairs.withColumns({"key": key, "part": F.substring(key, 1, 2)})
    first = Window.partitionBy("cluster", "part").orderBy("key", "ci_name")
    final = Window.partitionBy("cluster").orderBy("key", "ci_name")
    top = part.withColumn("r", F.row_number().over(first)).filter(F.col("r") <= total)
    ranked = top.withColumn("rank", F.row_number().over(final))
    share = F.ceil(F.lit(float(total)) / pairs.agg(F.count_distinct("cluster")).scalar())
    return (
        ranked.withColumn("share", share)
        .orderBy((F.col("rank") > F.col("share")).cast("int"), "rank", "key").limit(total)
        .select("cluster", "ci_name")
    )


def downsample(df: DataFrame, points: int = 400) -> DataFrame:
    """Keep every k-th reading of an item, k chosen so at most ``points`` remain for plotting."""
    w = Window.partitionBy("ci_name")
    step = F.ceil(F.count("*").over(w) / points)
    rn = F.row_number().over(w.orderBy("event_date_time"))
    return (
        df.withColumns({"_step": step, "_rn": rn})
        .filter((F.col("_rn") - 1) % F.col("_step") == 0).drop("_step", "_rn")
    )


def hash_sample(df: DataFrame, rows: int, on: list[str], seed: int = 42) -> DataFrame:
    """About ``rows`` rows for model tuning, chosen by key hash: repeatable and without a sort."""
    n = df.count()
    if n <= rows:
        return df
    grain = 1 << 30
    pick = F.pmod(F.xxhash64(*on, F.lit(seed)), F.lit(grain))
    return df.filter(pick < int(grain * rows / n))


def residuals(df: DataFrame, actual: str = "event_value", pred: str = "y_pred") -> Column:
    return F.col(actual) - F.col(pred)
