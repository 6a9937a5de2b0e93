"""Clustering of feature vectors ``(item, vec)`` and consensus over partitions."""

from __future__ import annotations

from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import RDD, StorageLevel
from pyspark.ml.clustering import BisectingKMeans, GaussianMixture
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import DataFrame, functions as F

from pulsegrid.functions import blocks as B
from pulsegrid.functions.joins import lookup_join, spread_work
from pulsegrid.operators import elastic as X, evaluate as E
from pulsegrid.operators.graph import components
from pulsegrid.session import cut_lineage

SEED = 42
#: Rounds of drawing candidates for starting centres, and candidates a round for each centre (on average).
START_ROUNDS, START_FACTOR = 3, 2.0
#: Tasks whose sums are added up on the driver at most; sums of more are added up in the executors first.
MANY_TASKS = 64


def moments(df: DataFrame) -> tuple[int, np.ndarray, np.ndarray]:
    """Number, mean and covariance of all vectors, from one partial sum for each task."""
    def partial(batches):
        n, s, sq = 0, 0.0, 0.0
        for pdf in batches:
            if len(pdf):
                x = B.stack(pdf["vec"])
                n, s, sq = n + len(x), s + x.sum(axis=0), sq + x.T @ x
        if n:
            yield pd.DataFrame([{"flat": np.concatenate([[n], s, sq.ravel()]).tolist()}])

    total = df.select("vec").mapInPandas(partial, "flat array<double>").agg(
        vector_to_array(Summarizer.sum(array_to_vector(F.col("flat"))))).first()[0]
    flat = np.array(total)
    dim = int(round((np.sqrt(4 * len(flat) - 3) - 1) / 2))
    n, mean = int(flat[0]), flat[1:1 + dim] / flat[0]
    return n, mean, flat[1 + dim:].reshape(dim, dim) / n - np.outer(mean, mean)


def _uniform(h: np.ndarray, salt: int) -> np.ndarray:
    """Repeatable numbers in [0, 1) from row hashes."""
    z = h.view(np.uint64) ^ np.uint64(salt * 0x9E3779B97F4A7C15 & (1 << 64) - 1)
    for shift in (30, 27, 31):
        z = (z ^ (z >> np.uint64(shift))) * np.uint64(0xBF58476D1CE4E5B9)
    return (z >> np.uint64(11)).astype(float) / (1 << 53)


def _weighted_start(x: np.ndarray, w: np.ndarray, k: int, rng: np.random.Generator) -> np.ndarray:
    """``k`` of the weighted candidates, drawn with probability growing with squared distance."""
    picks = [int(rng.choice(len(x), p=w / w.sum()))]
    d = ((x - x[picks[0]]) ** 2).sum(1)
    while len(picks) < k:
        p = d * w
        picks.append(int(rng.choice(len(x), p=p / p.sum()) if p.sum() > 0 else rng.integers(len(x))))
        d = np.minimum(d, ((x - x[picks[-1]]) ** 2).sum(1))
    return x[picks]


def _packed(df: DataFrame, seed: int) -> RDD:
    """``(hashes, vectors)`` of the rows as arrays, kept in the executors: a scan of them plans no query and shuffles nothing.

    They lie in a task for each core, whatever the number of the table's tasks: a scan of few rows costs the start of its tasks.
    """
    def pack(batches):
        for batch in batches:
            x = B.matrix(batch.column("vec"))
            if len(x):
                h = batch.column("h").to_numpy(zero_copy_only=False)
                yield pa.RecordBatch.from_pydict({"h": pa.array([h.tobytes()], pa.binary()), "vec": pa.array([x.tobytes()], pa.binary())})

    keyed = df.select(F.xxhash64(F.col("item").cast("string"), F.lit(seed)).alias("h"), "vec")
    rows = keyed.mapInArrow(pack, "h binary, vec binary").rdd
    arrays = rows.map(lambda r: (np.frombuffer(r["h"], np.int64), np.frombuffer(r["vec"]).reshape(len(r["h"]) // 8, -1)))
    return arrays.coalesce(df.sparkSession.sparkContext.defaultParallelism).persist(StorageLevel.MEMORY_AND_DISK)


def _added(parts: RDD) -> list[np.ndarray]:
    """Arrays of all tasks added up, in stages where there are very many tasks."""
    add = lambda a, b: [x + y for x, y in zip(a, b)]
    return parts.treeReduce(add) if parts.getNumPartitions() > MANY_TASKS else reduce(add, parts.collect())


def starting_centres(df: DataFrame, runs: list[tuple[int, int]], seed: int = SEED) -> dict[tuple[int, int], np.ndarray]:
    """Starting centres of each ``(k, restart)`` by k-means|| over all rows.

    Each round draws rows with probability growing with their squared distance from the candidates so far, about
    ``2 k`` of them for each run; the candidates, weighted by the rows nearest to them, are then reduced to ``k``.
    """
    blocks = _packed(df.select("item", F.col("vec").cast("array<double>").alias("vec")), seed)
    try:
        return _starts(df, blocks, runs, seed)
    finally:
        blocks.unpersist()


def _starts(df: DataFrame, blocks: RDD, runs: list[tuple[int, int]], seed: int) -> dict[tuple[int, int], np.ndarray]:
    keyed = df.select(F.xxhash64(F.col("item").cast("string"), F.lit(seed)).alias("h"), "vec")
    restarts = sorted({r for _, r in runs})
    first = keyed.agg(*[F.min_by("vec", F.xxhash64("h", F.lit(r))).alias(f"v{r}") for r in restarts]).first()
    found = {run: np.array([first[f"v{run[1]}"]], float) for run in runs}

    def scan(use):
        """What ``use(total, hashes, rows, distances to all candidates, where each run's begin)`` leaves in ``total``, for each run by task."""
        centres, cuts = np.concatenate([found[run] for run in runs]), np.cumsum([0, *[len(found[run]) for run in runs]])

        def task(parts):
            total = [[] for _ in cuts[1:]]
            for h, x in parts:
                for piece in B.strips(len(x), len(centres)):
                    use(total, h[piece], x[piece], B.euclidean(x[piece], centres), cuts)
            yield total

        return zip(*blocks.mapPartitions(task).collect())

    def spent(total, h, x, d, cuts):
        near = np.minimum.reduceat(d, cuts[:-1], axis=1)
        for i, v in enumerate((near ** 2).sum(axis=0)):
            total[i] = [float(v) + sum(total[i])]

    def owned(total, h, x, d, cuts):
        for i, (a, b) in enumerate(zip(cuts, cuts[1:])):
            total[i] = np.bincount(d[:, a:b].argmin(axis=1), minlength=b - a) + (total[i] if len(total[i]) else 0)

    for step in range(START_ROUNDS):
        cost = [sum(v for part in own for v in part) for own in scan(spent)]

        def drawn(total, h, x, d, cuts, cost=cost, step=step):
            near = np.minimum.reduceat(d, cuts[:-1], axis=1)
            for i, run in enumerate(runs):
                chance = START_FACTOR * run[0] * near[:, i] ** 2 / max(cost[i], 1e-300)
                for k in np.flatnonzero(_uniform(h, 1 + i * START_ROUNDS + step) < chance):
                    total[i].append((int(h[k]), x[k].tolist()))

        gained = [sorted(v for part in own for v in part) for own in scan(drawn)]
        for run, own in zip(runs, gained):
            if own:
                found[run] = np.vstack([found[run], [v for _, v in own]])

    weights = [sum(np.asarray(n, float) for n in own if len(n)) for own in scan(owned)]
    return {run: _weighted_start(found[run], w, run[0], np.random.default_rng([seed, *run])) for run, w in zip(runs, weights)}


def _nearest(x: np.ndarray, c: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    d = B.euclidean(x, c)
    at = d.argmin(axis=1)
    return at, d[np.arange(len(x)), at]


def kmeans_restarts(df: DataFrame, ks: tuple[int, ...], restarts: int = 20, seed: int = SEED,
                    tol: float = 1e-4) -> dict[int, tuple[np.ndarray, float]]:
    """Best centres and cost per ``k`` over many starts, each moved until it settles.

    All starts of all ``k`` still moving advance in the same scan of the rows, which the executors keep as arrays: each task
    sends one partial sum per centre, so a scan's traffic does not depend on the rows.
    """
    # a small file is one task, however many rows it has
    kept = spread_work(df.select("item", F.col("vec").cast("array<double>").alias("vec")), "item").persist()
    try:
        return _moved(kept, ks, restarts, seed, tol)
    finally:
        kept.unpersist()


def _moved(df: DataFrame, ks: tuple[int, ...], restarts: int, seed: int, tol: float) -> dict[int, tuple[np.ndarray, float]]:
    blocks = _packed(df, seed)
    try:
        runs = _starts(df, blocks, [(k, r) for k in ks for r in range(restarts)], seed)
        scale = float(np.diag(moments(df)[2]).mean()) or 1.0
        return _rounds(blocks, runs, tol * scale, ks, restarts)
    finally:
        blocks.unpersist()


def _rounds(blocks: RDD, runs: dict[tuple[int, int], np.ndarray], near: float, ks: tuple[int, ...], restarts: int) -> dict[int, tuple[np.ndarray, float]]:
    """The best run of each ``k`` after all have moved until a round's steps are ``near`` at most, squared and added up."""
    runs, moving, cost = dict(runs), set(runs), {}
    while moving:
        live = sorted(moving)
        centres, cuts = np.concatenate([runs[key] for key in live]), np.cumsum([0, *[len(runs[key]) for key in live]])

        def partial(parts, centres=centres, cuts=cuts):
            n, sq, total = np.zeros(len(centres), int), np.zeros(len(centres)), np.zeros(centres.shape)
            for _, rows in parts:
                for piece in B.strips(len(rows), len(centres)):
                    x = rows[piece]
                    d = B.euclidean(x, centres)
                    hot = np.zeros((len(centres), len(x)))
                    for a, b in zip(cuts, cuts[1:]):
                        at = a + d[:, a:b].argmin(axis=1)
                        hot[at, np.arange(len(x))] = 1.0
                        n += np.bincount(at, minlength=len(n))
                        sq += np.bincount(at, weights=d[np.arange(len(x)), at] ** 2, minlength=len(n))
                    total += hot @ x
            yield [n, sq, total]

        n, sq, total = _added(blocks.mapPartitions(partial))
        for key, a, b in zip(live, cuts, cuts[1:]):
            cost[key] = float(sq[a:b].sum())
            used = n[a:b, None] > 0
            new = np.where(used, total[a:b] / np.maximum(n[a:b, None], 1), runs[key])
            if ((new - runs[key]) ** 2).sum() <= near:
                moving.discard(key)
            else:
                runs[key] = new
    return {k: min(((runs[(k, r)], cost[(k, r)]) for r in range(restarts)), key=lambda t: t[1]) for k in ks}


def assign_centres(df: DataFrame, models: dict[int, np.ndarray]) -> DataFrame:
    """``(k, item, label)`` for every k in one scan."""
    item_type = dict(df.dtypes)["item"]

    def run(batches):
        for pdf in batches:
            if len(pdf):
                x = B.stack(pdf["vec"])
                for k, centres in models.items():
                    yield pd.DataFrame({"k": k, "item": pdf["item"], "label": _nearest(x, centres)[0]})

    return df.select("item", "vec").mapInPandas(run, f"k int, item {item_type}, label int")


def kmeans(df: DataFrame, ks: tuple[int, ...], restarts: int = 20, seed: int = SEED) -> DataFrame:
    models = kmeans_restarts(df, ks, restarts, seed)
    return assign_centres(df, {k: m for k, (m, _) in models.items()})


def gmm_full(df: DataFrame, k: int, seed: int = SEED) -> DataFrame:
    wide = df.withColumn("features", array_to_vector("vec"))
    model = GaussianMixture(k=k, seed=seed, maxIter=100).fit(wide)
    return model.transform(wide).select("item", F.col("prediction").alias("label"))


def gmm_shared(df: DataFrame, k: int, kind: str, seed: int = SEED, tol: float = 1e-3,
               ridge: float = 1e-6) -> DataFrame:
    """Gaussian mixture with one shared (``tied``) or per-cluster diagonal (``diag``) covariance.

    One scan per step returns weighted sums only; they are as large as the model. Steps go on until the likelihood settles.
    """
    centres = kmeans_restarts(df, (k,), 1, seed)[k][0]
    dim = centres.shape[1]
    weight = np.full(k, 1 / k)
    whole = moments(df)[2]
    cov = whole + ridge * np.eye(dim) if kind == "tied" else np.tile(np.diag(whole) + ridge, (k, 1))
    item_type = dict(df.dtypes)["item"]

    def log_density(x, weight, mean, cov):
        out = np.empty((len(x), k))
        for c in range(k):
            gap = x - mean[c]
            if kind == "tied":
                sol = np.linalg.solve(cov, gap.T).T
                out[:, c] = -0.5 * ((gap * sol).sum(1) + np.linalg.slogdet(cov)[1])
            else:
                out[:, c] = -0.5 * ((gap * gap / cov[c]).sum(1) + np.log(cov[c]).sum())
        return out + np.log(np.maximum(weight, 1e-300)) - 0.5 * dim * np.log(2 * np.pi)

    def soft(x, *state):
        ll = log_density(x, *state)
        top = ll.max(axis=1, keepdims=True)
        norm = top + np.log(np.exp(ll - top).sum(axis=1, keepdims=True))
        return np.exp(ll - norm), float(norm.sum())

    previous = -np.inf
    blocks = _packed(df.select("item", F.col("vec").cast("array<double>").alias("vec")), seed)
    while True:
        state = (weight, centres, cov)

        def partial(parts, state=state):
            n, s, like, rows = np.zeros(k), np.zeros((k, dim)), 0.0, 0
            sq = np.zeros((dim, dim)) if kind == "tied" else np.zeros((k, dim))
            for _, x in parts:
                r, l = soft(x, *state)
                like, rows = like + l, rows + len(x)
                n += r.sum(0)
                s += r.T @ x
                sq += x.T @ x if kind == "tied" else r.T @ (x * x)
            yield [np.concatenate([[like, rows], n, s.ravel(), sq.ravel()])]

        total = _added(blocks.mapPartitions(partial))[0]
        like, rows, n = total[0], total[1], np.maximum(total[2: 2 + k], 1e-10)
        s = total[2 + k: 2 + k + k * dim].reshape(k, dim)
        sq = total[2 + k + k * dim:]
        centres, weight = s / n[:, None], n / rows
        if kind == "tied":
            cov = (sq.reshape(dim, dim) - (centres.T * n) @ centres) / rows + ridge * np.eye(dim)
        else:
            cov = np.maximum(sq.reshape(k, dim) / n[:, None] - centres**2, 0) + ridge
        if abs(like / rows - previous) < tol:
            break
        previous = like / rows
    blocks.unpersist()
    state = (weight, centres, cov)

    def label(batches):
        for pdf in batches:
            if len(pdf):
                yield pd.DataFrame({"item": pdf["item"], "label": soft(B.stack(pdf["vec"]), *state)[0].argmax(axis=1)})

    return df.select("item", "vec").mapInPandas(label, f"item {item_type}, label int")


def gmm(df: DataFrame, k: int, kind: str = "full", seed: int = SEED) -> DataFrame:
    return gmm_full(df, k, seed) if kind == "full" else gmm_shared(df, k, kind, seed)


def bisecting(df: DataFrame, k: int, seed: int = SEED) -> DataFrame:
    """Top-down hierarchical clustering."""
    wide = df.withColumn("features", array_to_vector("vec"))
    model = BisectingKMeans(k=k, seed=seed, minDivisibleClusterSize=1.0).fit(wide)
    return model.transform(wide).select("item", F.col("prediction").alias("label"))


def kmedoids_vectors(df: DataFrame, ks: tuple[int, ...], seed: int = SEED) -> DataFrame:
    """Euclidean k-medoids over all items: ``(k, item, label)``."""
    item_type = dict(df.dtypes)["item"]
    series = df.select(F.col("item").cast("string").alias("ci_name"), F.col("vec").alias("series"))
    found = X.fleet_medoids(series, tuple(("euclidean", k) for k in ks), seed)
    models = {k: np.array([v for _, v in medoids]) for (_, k), medoids in found.items()}
    return assign_centres(df.withColumn("item", F.col("item").cast(item_type)), models)


# ---------------------------------------------------------------- density

def _first_coordinate():
    return F.col("vec")[0]


def neighbour_counts(df: DataFrame, eps: float, target: int = B.BLOCK_ROWS) -> DataFrame:
    """Items within ``eps``, the item itself included."""
    return neighbour_counts_grid(df, (eps,), target).select("item", "neighbours")


def neighbour_counts_grid(df: DataFrame, eps_list: tuple[float, ...], target: int = B.BLOCK_ROWS) -> DataFrame:
    """``(eps, item, neighbours)``: items within each radius, the item itself included, from one search.

    Blocks meet as the largest radius asks; each distance is compared with all radii, and counts, not pairs, leave a block.
    """
    radii = np.sort(np.unique(np.array(eps_list, float)))

    def kernel(left, right, same):
        x, y = B.stack(left["vec"]), B.stack(right["vec"])
        if not len(x) or not len(y):
            return None
        mine, theirs = np.zeros((len(x), len(radii)), np.int64), np.zeros((len(y), len(radii)), np.int64)
        for at in B.strips(len(x), len(y)):
            d = B.euclidean(x[at], y)
            if same:
                d[np.arange(len(d)), np.arange(at.start, at.stop)] = 0.0
            for k, r in enumerate(radii):
                near = d <= r
                mine[at, k] = near.sum(axis=1)
                if not same:
                    theirs[:, k] += near.sum(axis=0)
        out = [pd.DataFrame({"item": left["item"].to_numpy(), "n": list(mine)})]
        if not same:
            out.append(pd.DataFrame({"item": right["item"].to_numpy(), "n": list(theirs)}))
        return pd.concat(out)

    slim = df.select(F.col("item").cast("string").alias("item"), "vec")
    part = B.meet(slim, "item", kernel, "item string, n array<bigint>", _first_coordinate(), float(radii[-1]), target, in_strips=True)
    sums = part.groupBy("item").agg(*[F.sum(F.col("n")[k]).alias(f"n{k}") for k in range(len(radii))])
    each = F.array(*[F.struct(F.lit(float(r)).alias("eps"), F.col(f"n{k}").alias("neighbours")) for k, r in enumerate(radii)])
    return sums.select("item", F.explode(each).alias("e")).select("e.eps", "item", "e.neighbours")


def threshold_forest(df: DataFrame, limit: float, metric: str = "euclidean", coord=None,
                     target: int = B.BLOCK_ROWS) -> DataFrame:
    """Edges that connect items no further apart than ``limit``: one spanning forest per two blocks."""
    def kernel(left, right, same):
        x, y = B.stack(left["vec"]), B.stack(right["vec"])
        if not len(x) or not len(y):
            return None
        return B.spanning_edges(lambda at: B.METRICS[metric](x[at], y) <= limit + 1e-12, left["item"].to_numpy(), right["item"].to_numpy(), same)

    return B.meet(df, "item", kernel, "src string, dst string", coord, limit, target, in_strips=True)


def dbscan(df: DataFrame, eps: float, min_samples: int, target: int = B.BLOCK_ROWS, counts: DataFrame | None = None) -> DataFrame:
    """Density clusters: ``label`` names a cluster by its smallest core item, ``-1`` is noise.

    Border items join the cluster of their nearest core item. ``counts`` are the items' known neighbour counts, if any.
    """
    slim = df.select(F.col("item").cast("string").alias("item"), "vec")
    counted = slim.join(neighbour_counts(df, eps, target) if counts is None else counts, "item")
    marked = cut_lineage(counted.withColumn("is_core", (F.col("neighbours") >= min_samples).cast("int")))
    core = marked.filter("is_core = 1").select("item", "vec")
    groups = components(threshold_forest(core, eps, coord=_first_coordinate(), target=target))
    named = core.select("item").join(groups, F.col("item") == F.col("node"), "left").select(
        "item", F.coalesce("component", "item").alias("label"))

    def nearest_core(left, right, same):
        out = []
        for rows, cols in ((left, right),) if same else ((left, right), (right, left)):
            rows, cols = rows[rows["is_core"] == 0], cols[cols["is_core"] == 1].sort_values("item")
            x, y = B.stack(rows["vec"]), B.stack(cols["vec"])
            for at in B.strips(len(x), len(y)) if len(y) else ():
                d = B.euclidean(x[at], y)
                k = d.argmin(axis=1)
                d = d[np.arange(len(d)), k]
                hit = np.flatnonzero(d <= eps)
                out.append(pd.DataFrame({"item": rows["item"].to_numpy()[at][hit], "core": cols["item"].to_numpy()[k[hit]], "d": d[hit]}))
        return pd.concat(out) if out else None

    near = B.meet(marked.select("item", "vec", "is_core"), "item", nearest_core, "item string, core string, d double",
                  _first_coordinate(), eps, target, in_strips=True)
    border = near.groupBy("item").agg(F.min_by("core", F.struct("d", "core")).alias("core"))
    border = border.join(named.select(F.col("item").alias("core"), "label"), "core").select("item", "label")
    labels = named.unionByName(border)
    return marked.select("item", "neighbours", "is_core").join(labels, "item", "left").fillna("-1", ["label"])


def dbscan_grid(df: DataFrame, eps_list: tuple[float, ...], mins: tuple[int, ...], share: float = 0.05) -> DataFrame:
    """Labelled runs of the grid with more than one cluster and no cluster below ``share`` of the largest."""
    kept = []
    counted = cut_lineage(neighbour_counts_grid(df, eps_list))
    for eps in eps_list:
        counts = counted.where(F.col("eps") == float(eps)).select("item", "neighbours")
        for m in mins:
            labels = dbscan(df, eps, m, counts=counts).select("item", "label")
            row = E.cluster_sizes(labels).first()
            if row and row["n_clusters"] > 1 and row["counts"][0] >= share * row["counts"][-1]:
                kept.append(labels.withColumn("run_id", F.lit(f"DBSCAN_eps{eps}_ms{m}")))
    if not kept:
        return df.sparkSession.createDataFrame([], "item string, label string, run_id string")
    out = kept[0]
    for more in kept[1:]:
        out = out.unionByName(more)
    return out


# ---------------------------------------------------------------- consensus

def signatures(partitions: DataFrame) -> DataFrame:
    """Items with the same labels in every partition merge: ``(item = signature, vec, weight)``.

    ``partitions`` holds ``(partition_id, item, label)``.
    """
    coded = partitions.select("partition_id", "item", F.pmod(F.xxhash64(F.col("label").cast("string")), F.lit(1 << 50)).alias("c"))
    rows = coded.groupBy("item").agg(F.transform(
        F.array_sort(F.collect_list(F.struct("partition_id", "c"))), lambda s: s["c"].cast("double")).alias("vec"))
    return cut_lineage(rows.withColumn("signature", F.sha2(F.array_join(F.col("vec").cast("array<string>"), "|"), 256)))


def coassociation(partitions: DataFrame, share: float = 0.5) -> DataFrame:
    """Per item: mean share of partitions it spends with another item, and how many items reach ``share``.

    Items of one signature behave alike, so only distinct signatures are compared,
    each weighted by its items.
    """
    items = signatures(partitions)
    sig = items.groupBy(F.col("signature").alias("item")).agg(F.first("vec").alias("vec"), F.count("*").alias("w"))

    def kernel(left, right, same):
        a, b = B.stack(left["vec"]), B.stack(right["vec"])
        agree = 1 - B.disagreement(a, b)
        if not agree.size:
            return None
        wl, wr = left["w"].to_numpy(float), right["w"].to_numpy(float)
        close = (agree >= share - 1e-12).astype(float)
        out = [pd.DataFrame({"item": left["item"].to_numpy(), "total": agree @ wr, "close": close @ wr})]
        if not same:
            out.append(pd.DataFrame({"item": right["item"].to_numpy(), "total": agree.T @ wl, "close": close.T @ wl}))
        return pd.concat(out)

    sums = B.meet(sig, "item", kernel, "item string, total double, close double").groupBy(F.col("item").alias("signature")).agg(
        F.sum("total").alias("total"), F.sum("close").alias("close"))
    n = items.agg(F.count("*")).scalar()
    return lookup_join(items.select("item", "signature"), sums, "signature", "inner").withColumn("n", n).select(
        "item", F.try_divide(F.col("total") - 1, F.col("n") - 1).alias("mean_share"),
        (F.col("close") - 1).cast("long").alias("close_items"))


def consensus(partitions: DataFrame, share: float = 0.5, least: int = 5) -> DataFrame:
    """Items linked, directly or through others, by co-association of at least ``share``."""
    n = partitions.select("partition_id").distinct().count()
    if n < least:
        raise ValueError(f"consensus needs {least} partitions, got {n}")
    items = signatures(partitions)
    sig = items.groupBy(F.col("signature").alias("item")).agg(F.first("vec").alias("vec"))
    groups = components(threshold_forest(sig, 1 - share, "disagreement"))
    named = lookup_join(items.select("item", "signature"), groups.withColumnRenamed("node", "signature"), "signature", "left")
    return named.select("item", F.coalesce("component", "signature").alias("label"))


def number_labels(labels: DataFrame) -> DataFrame:
    """Replace cluster names by 0, 1, ... from the largest cluster down; ``-1`` stays."""
    from pyspark.sql import Window

    sizes = labels.filter("label <> '-1'").groupBy("label").agg(F.count("*").alias("c"))
    codes = sizes.select("label", (F.row_number().over(Window.orderBy(F.desc("c"), "label")) - 1).alias("code"))
    return lookup_join(labels, codes, "label", "left").select("item", F.coalesce("code", F.lit(-1)).alias("label"))
