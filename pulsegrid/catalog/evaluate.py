"""Cluster score queries with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from pulsegrid.catalog.duck import rounded as rnd, sql
from pulsegrid.catalog.util import rounded
from pulsegrid.operators import evaluate as E
from pulsegrid.sources import views as V

PART_COLS = ["p_size", "p_retailprice", "n_lines", "avg_qty", "avg_price", "avg_disc", "avg_tax"]


def vectors(s, d):
    """Embeddings with their given labels."""
    return V.table(s, d, "embeddings").select(
        F.col("vec_id").alias("item"), F.col("embedding").cast("array<double>").alias("vec"), "label")


def part_features(s, d):
    """One row of numeric features per part; parts without sales have nulls."""
    lines = V.table(s, d, "lineitem").groupBy(F.col("l_partkey").alias("p_partkey")).agg(
        F.count("*").alias("n_lines"), *[F.round(F.avg(c), 6).alias(a) for c, a in (
            ("l_quantity", "avg_qty"), ("l_extendedprice", "avg_price"), ("l_discount", "avg_disc"), ("l_tax", "avg_tax"))])
    part = V.table(s, d, "part").select("p_partkey", "p_brand", "p_type", F.col("p_size").cast("double").alias("p_size"), "p_retailprice")
    return part.join(lines, "p_partkey", "left").withColumn("n_lines", F.col("n_lines").cast("double"))


def _labelled_parts(s, d):
    df = part_features(s, d).withColumnRenamed("p_partkey", "item")
    return df, df.select("item", F.col("p_type").alias("label"))


def _means(s, d):
    df, labels = _labelled_parts(s, d)
    return E.cluster_means(df, labels, PART_COLS)


def _importance(scaled):
    def run(s, d):
        df, labels = _labelled_parts(s, d)
        scale = df.agg(*[F.stddev_pop(c).alias(c) for c in PART_COLS]) if scaled else None
        return rounded(E.importance_by_variance(E.cluster_means(df, labels, PART_COLS), PART_COLS, scale), 4)
    return run


def size_pairs(s, d):
    """Distances between the fifty part sizes, each a vector of price and sales means."""
    df = part_features(s, d).groupBy("p_size").agg(
        F.array(F.avg("p_retailprice") / 100, F.avg("avg_qty"), F.avg("avg_disc") * 100, F.avg("avg_tax") * 100).alias("vec"))
    a = df.select(F.col("p_size").cast("int").alias("i"), F.col("vec").alias("va"), F.lit(1).alias("one"))
    everyone = df.agg(F.collect_list(F.struct(F.col("p_size").cast("int").alias("j"), F.col("vec").alias("vb")))).scalar()
    pairs = a.withColumn("o", F.explode(everyone)).filter(F.col("o.j") > F.col("i"))
    labels = df.select(F.col("p_size").cast("int").alias("item"), (F.col("p_size").cast("int") % 3).alias("label"))
    return pairs.select("i", "o.j", E.euclid(F.col("va"), F.col("o.vb")).alias("dist")), labels


def _silhouette_precomputed(s, d):
    pairs, labels = size_pairs(s, d)
    return rounded(E.silhouette_pairs(pairs, labels))


def runs(s, d):
    """A table of runs: one per brand, with scores and cluster sizes taken from the parts."""
    return (
        V.table(s, d, "part").groupBy("p_brand", "p_type").agg(
            F.count("*").alias("c"), F.sum("p_retailprice").alias("price"), F.sum("p_size").alias("size"))
        .groupBy(F.col("p_brand").alias("run_id")).agg(
            F.round(F.sum("size") / F.sum("c") / 50, 3).alias("silhouette"),
            F.round(F.sum("price") / F.sum("c"), 0).alias("calinski_harabasz"),
            (F.sum("c") % 7).cast("double").alias("davies_bouldin"),
            F.array_sort(F.collect_list("c")).alias("counts")))


def k_runs(s, d):
    df = V.table(s, d, "part")
    return df.groupBy(F.col("p_type").alias("distance"), (F.col("p_size") % 5 + 2).alias("k")).agg(
        (F.avg("p_size") / 100).alias("silhouette"), F.avg("p_retailprice").alias("calinski_harabasz"),
        (F.count("*") / 100).alias("davies_bouldin"))


def _mean_series(s, d):
    from pulsegrid.operators import series as S

    packed = S.to_vectors(S.pad_truncate(V.supplier_weekly(s, d)), "event_value")
    labels = packed.select("ci_name", (F.substring("ci_name", 4, 9).cast("int") % 3).alias("cluster"))
    return rounded(E.mean_series(packed, labels))


QUERIES = {
    "silhouette_labels": lambda s, d: rounded(E.silhouette_items(vectors(s, d))),
    "silhouette_mean": lambda s, d: rounded(E.silhouette(vectors(s, d))),
    "silhouette_precomputed": _silhouette_precomputed,
    "silhouette_degenerate": lambda s, d: E.silhouette(vectors(s, d).withColumn("label", F.lit(0))),
    "davies_bouldin": lambda s, d: rounded(E.centre_scores(vectors(s, d)).select("davies_bouldin")),
    "calinski_harabasz": lambda s, d: rounded(E.centre_scores(vectors(s, d)).select("calinski_harabasz")),
    "cluster_means": lambda s, d: rounded(_means(s, d)),
    "feature_importance_var": _importance(False),
    "feature_importance_scaled": _importance(True),
    "mean_series": _mean_series,
    "cluster_sizes": lambda s, d: E.cluster_sizes(vectors(s, d)).select(
        F.array_join(F.col("counts").cast("array<string>"), ",").alias("counts"), "n_clusters"),
    "rank_sum": lambda s, d: E.rank_sum(runs(s, d)).drop("counts"),
    "balanced_best": lambda s, d: E.balanced_best(runs(s, d), 0.05).drop("counts"),
    "best_by_metric": lambda s, d: E.best_by_metric(runs(s, d)),
    "combined_score": lambda s, d: rounded(E.combined_score(k_runs(s, d))),
    "best_distance_k": lambda s, d: rounded(E.best_per_group(E.combined_score(k_runs(s, d)))),
}

_V = "e AS (SELECT vec_id AS item, CAST(embedding AS DOUBLE[]) AS vec, label FROM embeddings)"
_SIL = """sm AS (SELECT a.item, a.label, b.label AS other, sum(list_distance(a.vec, b.vec)) AS t FROM e a JOIN e b ON a.item <> b.item GROUP BY 1, 2, 3),
sz AS (SELECT label, count(*) AS c FROM e GROUP BY 1),
ab AS (SELECT item, sm.label, max(CASE WHEN other = sm.label THEN t / (c - 1) END) AS a, min(CASE WHEN other <> sm.label THEN t / c END) AS b
  FROM sm JOIN sz ON sz.label = sm.other GROUP BY 1, 2),
sil AS (SELECT CAST(item AS VARCHAR) AS item, CAST(label AS VARCHAR) AS label, CASE WHEN a IS NULL THEN 0 ELSE (b - a) / greatest(a, b) END AS s FROM ab)"""
_CENT = """long AS (SELECT item, label, unnest(vec) AS x, generate_subscripts(vec, 1) AS p FROM e),
cen AS (SELECT label, p, avg(x) AS c FROM long GROUP BY 1, 2),
dist AS (SELECT l.item, l.label, sqrt(sum(pow(x - c, 2))) AS d FROM long l JOIN cen USING (label, p) GROUP BY 1, 2),
sc AS (SELECT label, avg(d) AS s, sum(d * d) AS w, count(*) AS n FROM dist GROUP BY 1)"""
_PART = """pf AS (SELECT p.p_partkey AS item, p_brand, p_type, CAST(p_size AS DOUBLE) AS p_size, p_retailprice, CAST(n_lines AS DOUBLE) AS n_lines, avg_qty, avg_price, avg_disc, avg_tax
  FROM part p LEFT JOIN (SELECT l_partkey, count(*) AS n_lines, round(avg(l_quantity), 6) AS avg_qty, round(avg(l_extendedprice), 6) AS avg_price, round(avg(l_discount), 6) AS avg_disc,
    round(avg(l_tax), 6) AS avg_tax FROM lineitem GROUP BY 1) l ON l.l_partkey = p.p_partkey)"""
_SP = """sv AS (SELECT CAST(p_size AS INT) AS i, avg(p_retailprice) / 100 AS a, avg(avg_qty) AS b, avg(avg_disc) * 100 AS c, avg(avg_tax) * 100 AS d FROM pf GROUP BY 1),
e AS (SELECT i AS item, [a, b, c, d] AS vec, i % 3 AS label FROM sv)"""
_RUNS = """runs AS (SELECT p_brand AS run_id, round(sum(sz) / sum(c) / 50, 3) AS silhouette, round(sum(price) / sum(c), 0) AS calinski_harabasz,
  CAST(sum(c) % 7 AS DOUBLE) AS davies_bouldin, list_sort(list(c)) AS counts FROM (SELECT p_brand, p_type, count(*) AS c, sum(p_retailprice) AS price, sum(p_size) AS sz
  FROM part GROUP BY 1, 2) GROUP BY 1)"""
_KRUNS = """kr AS (SELECT p_type AS distance, CAST(p_size % 5 + 2 AS INT) AS k, avg(p_size) / 100 AS silhouette, avg(p_retailprice) AS calinski_harabasz,
  count(*) / 100 AS davies_bouldin FROM part GROUP BY 1, 2),
sc AS (SELECT *, ((silhouette - min(silhouette) OVER w) / (max(silhouette) OVER w - min(silhouette) OVER w + 1e-10)
  + 1 - (davies_bouldin - min(davies_bouldin) OVER w) / (max(davies_bouldin) OVER w - min(davies_bouldin) OVER w + 1e-10)
  + (calinski_harabasz - min(calinski_harabasz) OVER w) / (max(calinski_harabasz) OVER w - min(calinski_harabasz) OVER w + 1e-10)) / 3 AS combined_score
  FROM kr WINDOW w AS (PARTITION BY distance))"""
_AVG_RANK = "(rank() OVER (ORDER BY {c} {o}) + (count(*) OVER (PARTITION BY {c}) - 1) / 2)"
_RK = {n: _AVG_RANK.format(c=c, o=o) for n, c, o in (
    ("rank_silhouette", "silhouette", "DESC"), ("rank_calinski", "calinski_harabasz", "DESC"), ("rank_davies", "davies_bouldin", "ASC"))}


def _imp(scaled: bool) -> str:
    cols = [(c, f"{c} / (SELECT stddev_pop({c}) FROM pf)" if scaled else c) for c in PART_COLS]
    one = " UNION ALL ".join(f"SELECT '{c}' AS feature, var_samp(m) AS importance FROM (SELECT p_type, avg({e}) AS m FROM pf GROUP BY 1)" for c, e in cols)
    return f"SELECT feature, round(importance, 4) AS importance FROM ({one}) ORDER BY importance DESC LIMIT 10"


ORACLES = {
    "silhouette_labels": sql("", "SELECT item, label, round(s, 6) AS silhouette FROM sil", [_V, _SIL]),
    "silhouette_mean": sql("", "SELECT round(avg(s), 6) AS silhouette FROM sil", [_V, _SIL]),
    "silhouette_precomputed": sql("", """SELECT CAST(item AS INT) AS item, CAST(label AS INT) AS label, round(s, 6) AS silhouette FROM sil""", [_PART, _SP, _SIL]),
    "silhouette_degenerate": "SELECT CASE WHEN count(DISTINCT 0) <= 1 THEN CAST(-1 AS DOUBLE) END AS silhouette FROM embeddings",
    "davies_bouldin": sql("", """SELECT round(avg(r), 6) AS davies_bouldin FROM (SELECT a.label, max((a.s + b.s) / cd.d) AS r FROM sc a JOIN sc b ON a.label <> b.label
  JOIN (SELECT x.label AS la, y.label AS lb, sqrt(sum(pow(x.c - y.c, 2))) AS d FROM cen x JOIN cen y ON x.p = y.p AND x.label <> y.label GROUP BY 1, 2) cd
  ON cd.la = a.label AND cd.lb = b.label GROUP BY 1)""", [_V, _CENT]),
    "calinski_harabasz": sql("", """SELECT round((SELECT sum(n * g) FROM sc JOIN (SELECT label, sum(pow(c - m, 2)) AS g FROM cen JOIN (SELECT p, avg(x) AS m FROM long GROUP BY 1) USING (p) GROUP BY 1)
  USING (label)) * (sum(n) - count(*)) / (sum(w) * (count(*) - 1)), 6) AS calinski_harabasz FROM sc""", [_V, _CENT]),
    "cluster_means": sql("", "SELECT p_type AS label, " + ", ".join(f"round(avg({c}), 6) AS {c}" for c in PART_COLS) + " FROM pf GROUP BY 1", [_PART]),
    "feature_importance_var": sql("", _imp(False), [_PART]),
    "feature_importance_scaled": sql("", _imp(True), [_PART]),
    "mean_series": None,
    "cluster_sizes": sql("", """SELECT string_agg(CAST(c AS VARCHAR), ',' ORDER BY c) AS counts, count(*) AS n_clusters FROM (SELECT label, count(*) AS c FROM e GROUP BY 1)""", [_V]),
    "rank_sum": sql("", f"""SELECT * FROM (SELECT * EXCLUDE (counts), rank_silhouette + rank_calinski + rank_davies AS rank_total FROM (
  SELECT *, {', '.join(f'{e} AS {n}' for n, e in _RK.items())} FROM runs)) ORDER BY rank_total, run_id LIMIT 15""", [_RUNS]),
    "balanced_best": sql("", """SELECT * EXCLUDE (counts) FROM runs WHERE len(counts) > 1 AND list_min(counts) >= 0.05 * list_max(counts)
  ORDER BY silhouette DESC, run_id LIMIT 1""", [_RUNS]),
    "best_by_metric": sql("", """SELECT (SELECT run_id FROM runs ORDER BY silhouette DESC, run_id LIMIT 1) AS best_silhouette,
  (SELECT run_id FROM runs ORDER BY calinski_harabasz DESC, run_id LIMIT 1) AS best_calinski_harabasz,
  (SELECT run_id FROM runs ORDER BY davies_bouldin, run_id LIMIT 1) AS best_davies_bouldin""", [_RUNS]),
    "combined_score": sql("", f"SELECT distance, k, {rnd('silhouette, calinski_harabasz, davies_bouldin, combined_score')} FROM sc", [_KRUNS]),
    "best_distance_k": sql("", f"""SELECT distance, k, {rnd('silhouette, calinski_harabasz, davies_bouldin, combined_score')} FROM sc
  QUALIFY row_number() OVER (PARTITION BY distance ORDER BY combined_score DESC, k) = 1""", [_KRUNS]),
}


def _mean_series_sql() -> str:
    from pulsegrid.catalog.windows import _FENCE, _PAD

    return sql("supplier_weekly", """SELECT CAST(substr(ci_name, 4) AS INT) % 3 AS cluster, CAST(pos - 1 AS INT) AS pos, round(avg(event_value), 6) AS mean_value
  FROM padded GROUP BY 1, 2""", [_FENCE, _PAD])


ORACLES["mean_series"] = _mean_series_sql()
