import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from pulsegrid.functions import blocks as B
from pulsegrid.operators import cluster as C, evaluate as E
from pulsegrid.operators.graph import components


def blobs(spark, n=60, centres=((0, 0), (10, 0), (0, 10)), seed=0):
    rng = np.random.default_rng(seed)
    rows = [(f"i{c}_{i}", (np.array(m) + rng.normal(0, 0.5, 2)).tolist(), c) for c, m in enumerate(centres) for i in range(n)]
    return spark.createDataFrame(rows, "item string, vec array<double>, truth int")


def agrees(df, labels):
    pairs = df.join(labels, "item").select("truth", "label").distinct().count()
    return pairs == df.select("truth").distinct().count() == labels.select("label").distinct().count()


def test_every_method_finds_clear_groups(spark):
    df = blobs(spark).persist()
    assert agrees(df, C.kmeans(df, (3,), 5).select("item", "label"))
    assert agrees(df, C.kmedoids_vectors(df, (3,)).select("item", "label"))
    for kind in ("full", "tied", "diag"):
        assert agrees(df, C.gmm(df, 3, kind))
    assert agrees(df, C.bisecting(df, 3))
    assert agrees(df, C.dbscan(df, 1.5, 4).select("item", "label"))


def test_starting_centres_come_from_all_rows(spark):
    df = blobs(spark, 200).persist()
    n, mean, cov = C.moments(df)
    x = np.array([r["vec"] for r in df.collect()])
    assert n == 600 and np.allclose(mean, x.mean(axis=0)) and np.allclose(cov, np.cov(x.T, bias=True))
    starts = C.starting_centres(df, [(3, r) for r in range(8)])
    assert all(len({int(((s - m) ** 2).sum(axis=1).argmin()) for m in ((0, 0), (10, 0), (0, 10))}) == 3 for s in starts.values())
    again = C.starting_centres(df.repartition(7), [(3, r) for r in range(8)])
    assert all(np.allclose(starts[k], again[k]) for k in starts)


def test_rounds_of_kmeans_plan_no_query(spark, monkeypatch):
    """All restarts move over rows that the executors keep as arrays, and settle where a plain loop settles."""
    rng = np.random.default_rng(4)
    x = rng.normal(size=(300, 3))
    df = spark.createDataFrame([(f"i{i}", v.tolist()) for i, v in enumerate(x)], "item string, vec array<double>").persist()
    starts = C.starting_centres(df, [(k, r) for k in (2, 6) for r in range(3)])
    calls, rounds = [], []
    for name in ("mapInArrow", "mapInPandas"):
        monkeypatch.setattr(type(df), name, lambda *a, fn=getattr(type(df), name), **k: calls.append(1) or fn(*a, **k))
    added = C._added
    monkeypatch.setattr(C, "_added", lambda parts: rounds.append(1) or added(parts))
    got = C.kmeans_restarts(df, (2, 6), 3)
    assert len(calls) <= 2 < 8 <= len(rounds)
    for k, (centres, cost) in got.items():
        costs = []
        for run in (run for run in starts if run[0] == k):
            c, step = starts[run], np.inf
            while step > 1e-4 * x.var(axis=0).mean():
                d = ((x[:, None] - c[None]) ** 2).sum(-1)
                new = np.array([x[d.argmin(1) == j].mean(axis=0) if (d.argmin(1) == j).any() else c[j] for j in range(k)])
                step, before, c = ((new - c) ** 2).sum(), c, new
            costs.append((d.min(1).sum(), before))
        best = min(costs, key=lambda t: t[0])
        assert cost == pytest.approx(best[0]) and np.allclose(centres, best[1])


def test_sums_of_many_tasks_are_added_in_stages(spark, monkeypatch):
    parts = spark.sparkContext.parallelize([[np.full(2, i), i] for i in range(9)], 9)
    whole = C._added(parts)
    monkeypatch.setattr(C, "MANY_TASKS", 4)
    assert np.array_equal(C._added(parts)[0], whole[0]) and C._added(parts)[1] == whole[1] == 36


def test_rows_go_out_once_for_each_of_few_blocks(spark):
    """Kernels that work in strips get blocks that grow with the table, so a row's copies do not."""
    df = blobs(spark, 400).select("item", "vec")

    def seen(left, right, same):
        both = left if same else pd.concat([left, right])
        return pd.DataFrame({"item": both["item"], "n": 1})

    for coord in (None, F.col("vec")[0]):
        copies = B.meet(df, "item", seen, "item string, n long", coord, 100.0, target=5, in_strips=True).groupBy("item").count()
        assert copies.count() == 1200 and copies.agg(F.max("count")).first()[0] <= 2 * B.LEAST_BLOCKS


def test_strips_add_up(monkeypatch):
    monkeypatch.setattr(B, "STRIP_CELLS", 40)
    rng = np.random.default_rng(2)
    x, y = rng.normal(size=(23, 4)), rng.normal(size=(17, 4))
    a, b = np.eye(3)[rng.integers(0, 3, 23)], np.eye(2)[rng.integers(0, 2, 17)]
    left, right = (pd.DataFrame({"vec": list(v)}) for v in (x, y))
    d, own = (np.sqrt(((x[:, None] - v[None]) ** 2).sum(-1)) for v in (y, x))
    near, far = E._distance_sums(left, right, False, a, b)
    assert np.allclose(near, d @ b) and np.allclose(far, d.T @ a)
    assert np.allclose(E._distance_sums(left, left, True, a, a)[0], own @ a)


@pytest.mark.parametrize("target", [7, 50, 1000])
def test_blocks_do_not_change_results(spark, target):
    df = blobs(spark, 40).persist()
    x = np.array([r["vec"] for r in df.orderBy("item").collect()])
    d = np.sqrt(((x[:, None] - x[None]) ** 2).sum(-1))
    counts = [r["neighbours"] for r in C.neighbour_counts(df, 0.6, target).orderBy("item").collect()]
    assert counts == (d <= 0.6).sum(1).tolist()
    sil = {r["item"]: r["silhouette"] for r in E.silhouette_items(df.withColumn("label", F.col("truth")), target).collect()}
    truth = np.array([r["truth"] for r in df.orderBy("item").collect()])
    items = [r["item"] for r in df.orderBy("item").collect()]
    for i in range(0, len(x), 11):
        own = d[i][truth == truth[i]].sum() / ((truth == truth[i]).sum() - 1)
        other = min(d[i][truth == t].mean() for t in set(truth) - {truth[i]})
        assert sil[items[i]] == pytest.approx((other - own) / max(own, other))
    labels = C.dbscan(df, 0.6, 4, target).orderBy("item").collect()
    core = (d <= 0.6).sum(1) >= 4
    assert [bool(r["is_core"]) for r in labels] == core.tolist()
    comp = np.arange(len(x))
    for _ in range(len(x)):
        new = np.array([min(comp[j] for j in range(len(x)) if core[j] and d[i, j] <= 0.6) if core[i] else -1 for i in range(len(x))])
        if (new == comp).all():
            break
        comp = new
    for a in range(0, len(x), 5):
        for b in range(0, len(x), 7):
            if core[a] and core[b]:
                assert (labels[a]["label"] == labels[b]["label"]) == (comp[a] == comp[b])


def test_singleton_and_noise(spark):
    df = spark.createDataFrame([("a", [0.0], 0), ("b", [1.0], 0), ("c", [9.0], 1)], "item string, vec array<double>, label int")
    got = {r["item"]: r["silhouette"] for r in E.silhouette_items(df).collect()}
    assert got["c"] == 0.0 and got["a"] == pytest.approx(8 / 9)
    assert E.silhouette(df.withColumn("label", F.lit(1))).first()[0] == -1.0
    assert {r["label"] for r in C.dbscan(df, 0.5, 2).collect()} == {"-1"}
    assert E.centre_scores(df.withColumn("label", F.lit(1))).first()["davies_bouldin"] == -1.0


def test_components_of_a_long_path_and_a_star(spark):
    edges = [(f"p{i:03d}", f"p{i + 1:03d}") for i in range(120)] + [("s000", f"s{i:03d}") for i in range(1, 200)]
    got = components(spark.createDataFrame(edges, "src string, dst string")).collect()
    assert {r["component"] for r in got} == {"p000", "s000"} and len(got) == 121 + 200


def test_consensus_groups_and_minimum(spark):
    rows = [(p, f"x{i}", (i // 10 if p < 4 else i % 2)) for p in range(6) for i in range(30)]
    parts = spark.createDataFrame(rows, "partition_id int, item string, label int")
    out = C.number_labels(C.consensus(parts, 0.6))
    assert out.groupBy("label").count().count() == 3
    with pytest.raises(ValueError):
        C.consensus(parts.filter("partition_id < 3"))


def test_balance_rule_of_the_grid(spark):
    df = blobs(spark, 30)
    runs = C.dbscan_grid(df, (0.01, 1.5), (4,))
    assert {r["run_id"] for r in runs.select("run_id").distinct().collect()} == {"DBSCAN_eps1.5_ms4"}


@pytest.mark.parametrize("target", [7, 1000])
def test_silhouettes_of_many_runs_at_once(spark, target):
    df = blobs(spark, 12)
    place = F.split("item", "_")[1].cast("int")
    runs = {"truth": F.col("truth"), "odd": place % 2, "one": F.lit(0), "alone": F.when(F.col("item") == "i0_3", "x").otherwise("y"),
            "part": F.when(place < 7, F.col("truth"))}
    labels = None
    for name, label in runs.items():
        one = df.select(F.lit(name).alias("run_id"), "item", label.cast("string").alias("label")).where(F.col("label").isNotNull())
        labels = one if labels is None else labels.unionByName(one)
    stray = spark.createDataFrame([("truth", "no vector", "9")], "run_id string, item string, label string")
    got = {r["run_id"]: r["silhouette"] for r in E.silhouette_runs(df.select("item", "vec"), labels.unionByName(stray), target).collect()}
    assert set(got) == set(runs) and got["one"] == -1.0
    for name in ("truth", "odd", "alone", "part"):
        alone = df.select("item", "vec").join(labels.where(F.col("run_id") == name), "item").drop("run_id")
        assert got[name] == pytest.approx(E.silhouette(alone).first()[0])
    assert E.silhouette_runs(df, labels.limit(0)).count() == 0


def test_counts_of_all_radii_are_those_of_each(spark):
    df = blobs(spark, 15)
    grid = C.neighbour_counts_grid(df, (3.0, 0.4, 0.4, 11.0), target=6).collect()
    assert len(grid) == 3 * 45
    x = np.array([r["vec"] for r in df.orderBy("item").collect()])
    names = sorted({r["item"] for r in grid})
    d = np.sqrt(((x[:, None] - x[None]) ** 2).sum(-1))
    for r in grid:
        assert r["neighbours"] == (d[names.index(r["item"])] <= r["eps"]).sum()


@pytest.mark.parametrize("same", [True, False])
def test_edges_within_strips_join_what_all_pairs_join(monkeypatch, same):
    monkeypatch.setattr(B, "STRIP_CELLS", 60)
    rng = np.random.default_rng(4)
    x = rng.uniform(0, 10, (40, 2))
    y = x if same else rng.uniform(0, 10, (30, 2))
    left = np.array([f"l{i:02d}" for i in rng.permutation(len(x))], object)
    right = left if same else np.array([f"k{i:02d}" for i in rng.permutation(len(y))], object)
    near = np.sqrt(((x[:, None] - y[None]) ** 2).sum(-1)) <= 1.3
    got = B.spanning_edges(lambda at: near[at], left, right, same)
    group = {n: n for n in [*left, *right]}
    for _ in group:
        for i, j in zip(*np.nonzero(near)):
            group[left[i]] = group[right[j]] = min(group[left[i]], group[right[j]])
    assert dict(zip(got["src"], got["dst"])) == {n: g for n, g in group.items() if n != g} and len(got) == got["src"].nunique()


def test_linked_rows_meet_in_few_blocks(spark):
    """A row gives an edge for each block it meets; their number does not grow with the rows."""
    edges = C.threshold_forest(blobs(spark, 150).select("item", "vec"), 100.0, coord=F.col("vec")[0], target=3)
    assert edges.groupBy("src").count().agg(F.max("count")).first()[0] <= B.LEAST_BLOCKS


def test_rows_of_one_file_are_dealt_to_all_tasks(spark, monkeypatch):
    found = []

    def parts(df, *_):
        found.append(df.groupBy(F.spark_partition_id()).count().count())
        return {}

    monkeypatch.setattr(C, "_moved", parts)
    C.kmeans_restarts(blobs(spark, 40).coalesce(1), (2,), 1)
    assert found[0] >= 8
