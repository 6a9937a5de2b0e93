"""Clustering, consensus and elastic distance queries."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, functions as F

from pulsegrid.catalog.duck import sql
from pulsegrid.catalog.evaluate import vectors
from pulsegrid.catalog.features import _fleet_base
from pulsegrid.operators import cluster as C, elastic as X, evaluate as E, features as FX, linkage as LK, nearest as N, prepare as P, series as S
from pulsegrid.plans import elastic as EP, features as FP
from pulsegrid.session import settle
from pulsegrid.sources import views as V

EPS, MIN_SAMPLES = 1.2, 8
PARTS = 6
#: Radii that are counted in one search.
GRID = (0.9, 1.0, 1.1, 1.2, 1.3)


def quadrants(s, d) -> DataFrame:
    """Six given partitions of the embeddings: the largest of four coordinates names the label."""
    v = vectors(s, d)

    def label(p):
        four = [F.col("vec")[4 * p + i] for i in range(4)]
        return F.array_position(F.array(*four), F.greatest(*four)).cast("int")

    rows = F.explode(F.array(*[F.struct(F.lit(p).alias("partition_id"), label(p).alias("label")) for p in range(PARTS)]))
    return v.select("item", rows.alias("e")).select("e.partition_id", "item", "e.label")


def _silhouette_runs(s, d):
    """Silhouettes of the six given partitions from one pass over the distances."""
    labels = quadrants(s, d).select(F.concat(F.lit("part_"), "partition_id").alias("run_id"), "item", "label")
    return E.silhouette_runs(vectors(s, d), labels).withColumn("silhouette", F.round("silhouette", 6))


def _coassociation(s, d):
    return C.coassociation(quadrants(s, d)).withColumn("mean_share", F.round("mean_share", 6))


def _consensus_sizes(s, d):
    groups = C.consensus(quadrants(s, d), share=5 / 6)
    sizes = groups.groupBy("label").agg(F.count("*").alias("group_size"))
    return groups.join(sizes, "label").select("item", "group_size")


def _consensus(s, d):
    labels = C.kmeans(vectors(s, d), (2, 3, 4, 5, 6), 5).select(F.col("k").alias("partition_id"), "item", "label")
    return C.number_labels(C.consensus(labels))


def _linkage(s, d):
    """Single-linkage groups at several heights, all cut from one tree."""
    data = settle(vectors(s, d))
    tree = settle(LK.spanning_tree(data))
    cuts = [LK.cut_at_height(data, tree, h).withColumn("height", F.lit(h)) for h in GRID]
    return reduce(DataFrame.unionByName, cuts).groupBy("height", "label").agg(F.count("*").alias("group_size"))


def _reduced(s, d):
    """Embeddings in their first eight principal directions."""
    return P.pca_scores(vectors(s, d), k=8).select("item", F.col("scores").alias("vec"))


def _gmm(s, d):
    data = settle(_reduced(s, d))
    out = None
    for kind in ("full", "tied", "diag"):
        one = C.gmm(data, 3, kind).withColumn("kind", F.lit(kind))
        out = one if out is None else out.unionByName(one)
    return out


def fleet_table(s, d):
    """Per-item features that need no pivot beyond the profiles."""
    b = _fleet_base(s, d).persist()
    out = FX.basic(b)
    for f in (FX.percentiles, FX.diffs, FX.profile, FX.trend_acf):
        out = out.join(f(b), "ci_name", "left")
    return settle(out)


def _time_profile(s, d):
    score, k, labels = FP.time_profile(fleet_table(s, d), restarts=5)
    return labels.withColumns({"k": F.lit(k), "silhouette": F.lit(score)})


def _clean(s, d):
    t = fleet_table(s, d)
    cols = FP.numeric_columns(t)
    full = settle(P.impute_median_mode(t, cols, []))
    live = [r["column_name"] for r in P.null_report(full, cols).filter("missing_values = 0").collect()]
    return full, P.variance_keep(full, live)


def _subspace(s, d):
    table, cols = _clean(s, d)
    found = FP.subspaces(table, cols, restarts=3)
    best = max(found, key=lambda g: found[g][0])
    return found[best][1].withColumns({"feature_group": F.lit(best), "silhouette": F.lit(found[best][0])})


def _sweep(s, d):
    table, cols = _clean(s, d)
    reps = {r: FP.represent(table, cols, r) for r in ("original", "pca", "power")}
    runs, _ = FP.sweep(reps, ks=(2, 3), few=(2, 3), restarts=5, eps=(5.0, 7.0), mins=(5,))
    return E.rank_sum(runs).drop("counts")


def _elastic_pairs(s, d):
    """Nine distances from the stated queries (one supplier in twenty) to all series."""
    series = settle(S.prepare_series(V.supplier_weekly(s, d)))
    return X.query_distances(series, series.where(F.substring_index("ci_name", "-", -1).cast("long") % 20 == 0))


def _elastic_nearest(s, d):
    """The ten nearest series of the stated queries (one supplier in twenty) under nine distances."""
    series = settle(S.prepare_series(V.supplier_weekly(s, d)))
    return N.nearest_neighbours(series, series.where(F.substring_index("ci_name", "-", -1).cast("long") % 20 == 0))


def _elastic_runs(s, d):
    return EP.compare_distances(settle(S.prepare_series(V.supplier_weekly(s, d))))[0]


def _assign(s, d):
    return EP.cluster_fleet(V.supplier_weekly(s, d), ("dtw",))[0]


QUERIES = {
    "coassociation": _coassociation,
    "silhouette_runs": _silhouette_runs,
    "consensus_groups": _consensus_sizes,
    "consensus": _consensus,
    "dbscan_core": lambda s, d: C.neighbour_counts(vectors(s, d), EPS).withColumn(
        "is_core", (F.col("neighbours") >= MIN_SAMPLES).cast("int")),
    "neighbour_grid": lambda s, d: C.neighbour_counts_grid(vectors(s, d), GRID),
    "linkage_cuts": _linkage,
    "dbscan": lambda s, d: C.dbscan(vectors(s, d), EPS, MIN_SAMPLES),
    "kmeans_restarts": lambda s, d: C.kmeans(vectors(s, d), (2, 5, 10)),
    "kmedoids": lambda s, d: C.kmedoids_vectors(vectors(s, d), (2, 3, 4)),
    "gmm": _gmm,
    "bisecting": lambda s, d: C.bisecting(vectors(s, d), 8),
    "time_profile": _time_profile,
    "subspace": _subspace,
    "run_sweep": _sweep,
    "elastic_pairs": _elastic_pairs,
    "elastic_nearest": _elastic_nearest,
    "elastic_runs": _elastic_runs,
    "assign_medoids": _assign,
}

_V = "e AS (SELECT CAST(vec_id AS VARCHAR) AS item, CAST(embedding AS DOUBLE[]) AS vec FROM embeddings)"
_NEAR = f"""near AS MATERIALIZED (SELECT a.item AS i, b.item AS j, list_distance(a.vec, b.vec) AS d FROM e a JOIN e b ON list_distance(a.vec, b.vec) <= {EPS} OR a.item = b.item),
cnt AS (SELECT i AS item, count(*) AS neighbours, CAST(count(*) >= {MIN_SAMPLES} AS INT) AS is_core FROM near GROUP BY 1)"""
_LABELS = "lab AS (SELECT vec_id AS item, " + ", ".join(
    "CASE greatest({0}) {1} END AS l{2}".format(
        ", ".join(f"embedding[{4 * p + i + 1}]" for i in range(4)),
        " ".join(f"WHEN embedding[{4 * p + i + 1}] THEN {i + 1}" for i in range(4)), p) for p in range(PARTS)) + " FROM embeddings)"
_AGREE = "ag AS MATERIALIZED (SELECT a.item AS i, b.item AS j, (" + " + ".join(
    f"CAST(a.l{p} = b.l{p} AS INT)" for p in range(PARTS)) + f") / {PARTS} AS share FROM lab a JOIN lab b ON a.item <> b.item)"

ORACLES = {
    "coassociation": sql("", """SELECT i AS item, round(avg(share), 6) AS mean_share, count(*) FILTER (share >= 0.5 - 1e-9) AS close_items FROM ag GROUP BY 1""", [_LABELS, _AGREE]),
    "consensus_groups": "WITH RECURSIVE " + ",\n".join([_LABELS, _AGREE]) + """,
reach(item, root) AS (SELECT item, item FROM lab UNION SELECT g.j, r.root FROM reach r JOIN ag g ON g.i = r.item AND g.share >= 5 / 6 - 1e-9)
SELECT item, count(*) AS group_size FROM reach GROUP BY 1""",
    "dbscan_core": sql("", "SELECT item, neighbours, is_core FROM cnt", [_V, _NEAR]),
    "neighbour_grid": sql("", f"""SELECT eps, a.item, count(*) AS neighbours
  FROM (SELECT unnest([{", ".join(f"{x}::DOUBLE" for x in GRID)}]) AS eps), e a JOIN e b ON list_distance(a.vec, b.vec) <= eps OR a.item = b.item GROUP BY 1, 2""", [_V]),
    "silhouette_runs": sql("", """SELECT run_id, round(avg(s), 6) AS silhouette FROM (
  SELECT run_id, item, CASE WHEN n_own = 1 THEN 0 WHEN b = a THEN 0 ELSE (b - a) / greatest(a, b) END AS s FROM (
    SELECT run_id, item, max(n) FILTER (other = label) AS n_own, max(CASE WHEN n > 1 THEN t / (n - 1) ELSE 0 END) FILTER (other = label) AS a,
      min(t / n) FILTER (other <> label) AS b
    FROM (SELECT x.run_id, x.item, x.label, y.label AS other, sum(list_distance(ex.vec, ey.vec)) AS t, count(*) AS n
      FROM rl x JOIN rl y ON x.run_id = y.run_id JOIN e ex ON ex.item = x.item JOIN e ey ON ey.item = y.item GROUP BY 1, 2, 3, 4) GROUP BY 1, 2))
GROUP BY 1""", [_V, _LABELS, "rl AS (" + " UNION ALL ".join(
        f"SELECT 'part_{p}' AS run_id, CAST(item AS VARCHAR) AS item, l{p} AS label FROM lab" for p in range(PARTS)) + ")"]),
    "linkage_cuts": "WITH RECURSIVE " + _V + f""",
link AS MATERIALIZED (SELECT a.item AS i, b.item AS j, list_distance(a.vec, b.vec) AS d FROM e a JOIN e b ON list_distance(a.vec, b.vec) <= {max(GRID)} AND a.item <> b.item),
reach(height, item, root) AS (SELECT h, item, item FROM e, (SELECT unnest([{", ".join(f"{x}::DOUBLE" for x in GRID)}]) AS h)
  UNION SELECT r.height, l.j, r.root FROM reach r JOIN link l ON l.i = r.item AND l.d <= r.height)
SELECT height, label, count(*) AS group_size FROM (SELECT height, item, min(root) AS label FROM reach GROUP BY 1, 2) GROUP BY 1, 2""",
    "dbscan": "WITH RECURSIVE " + ",\n".join([_V, _NEAR]) + """,
link AS MATERIALIZED (SELECT n.i, n.j, n.d FROM near n JOIN cnt a ON a.item = n.i AND a.is_core = 1 JOIN cnt b ON b.item = n.j AND b.is_core = 1),
reach(item, root) AS (SELECT item, item FROM cnt WHERE is_core = 1 UNION SELECT l.j, r.root FROM reach r JOIN link l ON l.i = r.item),
named AS (SELECT item, min(root) AS label FROM reach GROUP BY 1),
border AS (SELECT n.i AS item, arg_min(m.label, (n.d, n.j)) AS label FROM near n JOIN cnt c ON c.item = n.i AND c.is_core = 0 JOIN named m ON m.item = n.j GROUP BY 1)
SELECT cnt.item, neighbours, is_core, coalesce(named.label, border.label, '-1') AS label FROM cnt LEFT JOIN named USING (item) LEFT JOIN border ON border.item = cnt.item""",
}
